"""Subword encoding and decoding through a table of distinct chunks.

No piece of such a model holds a whitespace marker after another character, so no merge crosses the
boundary before a marker run: a text's segmentation is that of its chunks (a marker run and what
follows), put end to end.  Each slice of texts is cut into chunks, a dictionary gives the distinct
ones and their positions, each distinct chunk is segmented once, and the ids come back by position.
Models for which this doesn't hold are run on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map
from .words import cuts, text_slices, with_text

MARK = "▁"
#: Bytes of text, or of ids, that a worker handles at once, and ids that it decodes at once.
SLICE_BYTES, DECODE_IDS = 2 << 20, 1 << 18
#: Distinct chunks that a worker remembers between slices.
TABLE_CHUNKS = 150_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def splits_at_markers(model: object) -> bool:
    """Whether chunks can be segmented on their own: identity normaliser, no piece across a marker."""
    spec: dict[int, object] = {}
    for number, value in _fields(model.serialized_model_proto()):
        if number == 3:
            spec = dict(_fields(value))
    plain = spec.get(1) == b"identity" and not spec.get(2) and spec.get(3, 1) == 1
    plain = plain and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
    kinds = range(model.vocab_size())
    whole = all(MARK not in model.id_to_piece(i).lstrip(MARK) for i in kinds)
    return bool(plain and whole)


class ChunkEncoder:
    """Ids of whole texts by way of a bounded table of distinct chunks."""

    def __init__(self, model_path: str, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.by_chunk = splits_at_markers(self.model)
        self.most = table_chunks
        self._empty()

    def _empty(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = [0]

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        """Each chunk's row in the table; missing ones are segmented and added."""
        if len(self.row) + len(chunks) > self.most:
            self._empty()
        rows = np.fromiter((self.row.get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [chunks[i] for i in missing]
            # The library puts one marker before what it is given; a chunk's own first marker is that one.
            ids = self.model.encode([c.decode() for c in new], num_threads=1)
            if b"" in new:  # a marker with nothing behind it; the library gives no id for an empty text
                ids[new.index(b"")] = [self.model.piece_to_id(MARK)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for one in ids for i in one), np.int32, int(lengths.sum()))
            start, first = self.ends[-1], len(self.ends) - 1
            while start + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[start : start + len(flat)] = flat
            self.ends.extend((start + np.cumsum(lengths)).tolist())
            for k, c in enumerate(new):
                self.row[c] = first + k
            rows[missing] = first + np.arange(len(new))
        return rows

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each with the end id behind it if one is given."""
        tail = [] if end_id is None else [end_id]
        if not self.by_chunk:
            ids = [one + tail for one in self.model.encode(texts.to_pylist(), num_threads=1)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.concatenate([[0], np.cumsum(lengths)]), np.fromiter((i for x in ids for i in x), np.int32)
        texts = pc.replace_substring(texts, MARK, " ")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        # What follows an empty part belongs to the same marker run: glue such runs together.
        blank = pc.binary_length(parts).to_numpy(zero_copy_only=False) == 0
        last = np.zeros(len(blank), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        if blank.any():
            parts, offsets = self._glue(parts, offsets, blank, last)
        coded = parts.dictionary_encode()
        rows = self._rows(coded.dictionary.cast(pa.large_binary()).to_pylist())[coded.indices.to_numpy()]
        ends = np.asarray(self.ends, np.int64)
        starts, lengths = ends[rows], ends[rows + 1] - ends[rows]
        before = np.concatenate([[0], np.cumsum(lengths)])
        picked = self.flat[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])]
        bounds = before[offsets]
        if end_id is not None:
            picked = np.insert(picked, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return bounds, picked

    @staticmethod
    def _glue(parts: pa.Array, offsets: np.ndarray, blank: np.ndarray, last: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Chunks where parts between single spaces are empty.

        Part k stands for a marker and its text.  A blank part that isn't the last of its text lends
        its marker to the next part.  An empty text (one blank part) has no chunk at all.
        """
        keep = ~blank | last
        words = parts.to_pylist()
        out, run = [], 0
        counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
        alone = np.zeros(len(blank), bool)
        starts = offsets[:-1][np.diff(offsets) == 1]
        alone[starts] = blank[starts]
        for k, w in enumerate(words):
            if keep[k]:
                if not alone[k]:
                    out.append(" " * run + w)
                run = 0
            else:
                run += 1
        counts -= np.concatenate([[0], np.cumsum(alone)])[offsets]
        return pa.array(out, pa.large_string()), counts


def _ids(encoder: ChunkEncoder, texts: pa.Array, end: int | None) -> pa.ListArray:
    bounds, ids = encoder.encode(texts, end)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _texts(model: object, ids: pa.ListArray) -> pa.Array:
    """What the model's decoder gives, some hundred thousand ids at a time."""
    out = [pa.array(model.decode([x or [] for x in ids.slice(a, b - a).to_pylist()], num_threads=1), pa.string()) for a, b in cuts(_lengths(ids), DECODE_IDS)]
    return pa.chunked_array(out, pa.string()).combine_chunks()


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _codec(df: DataFrame, model_path: str, column: str, keep: tuple[str, ...], ids: str | None, decoded: str | None, add_end: bool = True) -> DataFrame:
    """Texts to ids, ids to texts or both, in one pass of one worker, which gets each column once.

    ``column`` has texts if ``ids`` is given, else ids.  Slices of rows are cut by bytes, so that a worker
    holds little besides its batch.
    """
    made = [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())]
    made = [(name, kind) for name, kind in made if name]
    keep = tuple(c for c in keep if c not in (ids, decoded))
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind in made])
    sent, at = with_text(df, column, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model_path)
        end = encoder.model.eos_id() if add_end else None

        def of_texts() -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
            for batch, texts in text_slices(batches, at, SLICE_BYTES):
                yield batch, _ids(encoder, texts, end)

        def of_ids() -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
            for batch in batches:
                for a, b in cuts(_lengths(batch.column(at)) * 4, SLICE_BYTES):
                    yield batch.slice(a, b - a), batch.column(at).slice(a, b - a)

        for batch, lists in of_texts() if ids else of_ids():
            new = ([lists] if ids else []) + ([_texts(encoder.model, lists)] if decoded else [])
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + new, names=out.names)

    return arrow_map(sent, run, out)


def encode(
    df: DataFrame, model_path: str, text: str = "text", into: str = "ids", add_end: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The columns ``keep`` and ``into`` (array<int>), the model's ids of the whole text.

    A null text counts as empty; an empty one has only the end id.  ``model_path`` must be readable
    on every worker.  Rows are independent: repeated rows give repeated results.  A kept column named
    like ``into`` is replaced.
    """
    return _codec(df, model_path, text, keep, into, None, add_end)


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``into``, the text that the model's decoder gives for the ids.

    Null ids count as none.  A kept column named like ``into`` is replaced, as in ``encode``.
    """
    return _codec(df, model_path, ids, keep, None, into)


def round_trip(
    df: DataFrame, model_path: str, text: str = "text", into: tuple[str, str] = ("ids", "decoded"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """``encode``, with an end id, and ``decode`` of what it gives, in one pass over the texts."""
    return _codec(df, model_path, text, keep, *into)
