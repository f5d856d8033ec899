"""Repeated passages: found by window hashes, confirmed across documents, located by automata.

Hashes of all windows go in compressed blocks to parts by hash.  A part finds the windows that occur in
more than one document and the smallest document of each.  Documents are cut into shards of bounded size;
a shard hears which of its windows occurred before.  Runs of such windows are passages; the shard compiles
its passages into one Aho-Corasick automaton over word numbers and streams its documents through it.
An automaton so holds only passages of its own shard, and no document meets passages that it can't hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import planes, unplanes
from .common import Scratch, arrow_map
from .words import hash_words, mix, split_words, text_slices, windows

WINDOW = 13
#: Text bytes of a shard of documents, and windows of a part of the hashes, about.
SHARD_BYTES = 3 << 20
PART_WINDOWS = 1_000_000
#: Windows that a task gathers before it sends blocks.
GATHER = 4_000_000
_NONE = np.iinfo(np.int64).min


def shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)


def _windows(offsets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text number, hash) of every window of n words within one text."""
    h = windows(hashes, n)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + n <= offsets[1:][text]) if len(h) else np.zeros(0, np.int64)
    return at, text[at], h[at]


def _send(df: DataFrame, parts: int, n: int) -> DataFrame:
    """Blocks (part, h, d) of window hashes and the documents that hold them, in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate(x) for x in zip(*have, strict=True))
            part = (h % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            h, d = h[order] // np.uint64(parts), d[order]
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if b > a:
                    cells = planes(h[a:b]), planes(np.diff(d[a:b], prepend=np.int64(0)))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["part", "h", "d"])

        for batch, texts in text_slices(batches, 1):
            offsets, coded = split_words(texts, lower=False)
            _, text, h = _windows(offsets, hash_words(coded.dictionary)[coded.indices.to_numpy()], n)
            if len(h):
                have.append((h, batch.column(0).to_numpy()[text]))
                held += len(h)
            if held > GATHER:
                yield from out()
                have, held = [], 0
        if held:
            yield from out()

    return arrow_map(df, run, "part long, h binary, d binary")


def _recurring(blocks: DataFrame, shards: int, parts: int) -> DataFrame:
    """(shard, h, first): for each shard, hashes of its windows that a smaller document holds."""

    def run(t: pa.Table) -> pa.Table:
        p = np.uint64(t.column("part")[0].as_py())
        h = np.concatenate([unplanes(x, np.uint64) for x in t.column("h").to_pylist()])
        d = np.concatenate([np.cumsum(unplanes(x, np.int64)) for x in t.column("d").to_pylist()])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        first = np.repeat(np.minimum.reduceat(d, starts), sizes)
        later = d > first
        h, first, shard = h[later] * np.uint64(parts) + p, first[later], shard_of(d[later], shards)
        order = np.lexsort([h, shard])
        h, first, shard = h[order], first[order], shard[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
        h, first, shard = h[new], first[new], shard[new]
        edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(h)) if len(h) else np.zeros(1, int)
        cut = list(zip(edges[:-1], edges[1:], strict=True))
        cells = [pa.array([planes(x[a:b]) for a, b in cut], pa.binary()) for x in (h, first)]
        return pa.table([pa.array([int(shard[a]) for a, _ in cut], pa.int64()), *cells], names=["shard", "h", "first"])

    return blocks.groupBy("part").applyInArrow(run, "shard long, h binary, first binary")


def _symbols(codes: np.ndarray, wide: bool) -> str:
    """Word numbers as a string; wide ones take two characters from ranges that don't meet."""
    if wide:
        two = np.stack([codes // 0x8000 + 0x10000, codes % 0x8000 + 0x100], 1).ravel()
        return two.astype("<u4").tobytes().decode("utf-32-le")
    codes = codes + 1
    return (codes + 0x800 * (codes >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


def _locate(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray, hashes: np.ndarray, known: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in passages that a smaller document holds."""
    gone = np.zeros(len(codes), bool)
    at, text, h = _windows(offsets, hashes, n)
    if not len(known) or not len(h):
        return gone
    order = np.argsort(known)
    known, first = known[order], first[order]
    found = np.minimum(np.searchsorted(known, h), len(known) - 1)
    repeats = (known[found] == h) & (first[found] < ids[text])
    at, text, source = at[repeats], text[repeats], first[found[repeats]]
    if not len(at):
        return gone
    # Runs of consecutive windows of one text are a passage.
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))
    end = at[np.append(begin[1:], len(at)) - 1] + n
    newest = np.maximum.reduceat(source, begin)
    wide = bool(codes.max() >= 0x100000)
    width = 1 + wide
    whole = _symbols(codes, wide)
    automaton = ahocorasick.Automaton()
    for a, b, s in zip(at[begin].tolist(), end.tolist(), newest.tolist(), strict=True):
        phrase = whole[a * width : b * width]
        known_as = automaton.get(phrase, None)
        if known_as is None or s < known_as[1]:
            automaton.add_word(phrase, (b - a, s))
    automaton.make_automaton()
    for i in np.flatnonzero(np.diff(offsets) >= n).tolist():
        start, doc = int(offsets[i]), int(ids[i])
        for stop, (size, source) in automaton.iter(whole[start * width : int(offsets[i + 1]) * width]):
            if source < doc:
                word = start + (stop + 1) // width
                gone[word - size : word] = True
    return gone


def cut_repeats(df: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", n: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): documents without what an earlier one holds.

    A word goes if it lies in a window of ``n`` words whose sequence also occurs in a document with a
    smaller id; windows are those of the input.  ``kept`` joins the words that stay by one space,
    ``removed`` lists half-open ranges of word numbers.  Words are compared as they are.  A null text
    counts as empty; texts of fewer than ``n`` words stay whole.  Rows with equal ids never remove from
    each other; a row with a null id stays whole and removes nothing.  An empty table gives no rows.
    """
    scratch = scratch or Scratch(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards, parts = max(1, math.ceil(size / SHARD_BYTES)), max(1, math.ceil(size / 6 / PART_WINDOWS))
    blocks = _send(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), parts, n)
    told = scratch.keep(_recurring(blocks, shards, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column(0), _NONE).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(ids, shards)), b.column(0), b.column(1)], names=["shard", "doc_id", "text"])

    placed = arrow_map(docs, place, "shard long, doc_id long, text string")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept", "removed"]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)], names=names)
        known = [unplanes(x, np.uint64) for x in right.column("h").to_pylist()]
        first = [unplanes(x, np.int64) for x in right.column("first").to_pylist()]
        known, first = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((known, np.uint64), (first, np.int64)))
        doc = left.column("doc_id").combine_chunks()
        ids = pc.fill_null(doc, _NONE).to_numpy()
        texts = pc.fill_null(left.column("text").combine_chunks().cast(pa.large_string()), "")
        offsets, coded = split_words(texts, lower=False)
        codes = coded.indices.to_numpy().astype(np.int64)
        gone = _locate(ids, offsets, codes, hash_words(coded.dictionary)[codes], known, first, n)
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        words = coded.filter(pa.array(~gone)).cast(coded.type.value_type) if gone.any() else coded.cast(coded.type.value_type)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words), pa.scalar(" ", words.type))
        removed = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            marks = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
            removed.append([{"start": int(x), "end": int(y)} for x, y in marks.reshape(-1, 2)])
        words_of = np.diff(offsets)
        columns = [doc, pa.array(words_of), pa.array(words_of - np.diff(kept)), joined.cast(pa.string()), pa.array(removed, span)]
        return pa.table(columns, names=names)

    both = placed.groupBy("shard").cogroup(told.groupBy("shard"))
    return both.applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
