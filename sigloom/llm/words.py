"""Whole texts to word hashes, a batch at a time, without a Python step per word.

Words are the maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Text bytes handled at once; a longer single text forms a slice of its own.
SLICE_BYTES = 4 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def text_slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut to about ``limit`` bytes of the text in column ``at``, and these texts, null ones made empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        for a, b in cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), limit):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


def with_text(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The columns ``keep`` and, behind them unless it is one of them, ``text``; and the place of ``text``."""
    sent = keep if text in keep else (*keep, text)
    return df.select(*sent), sent.index(text)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(offsets of each text's words, all words in order as a dictionary array)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return offsets, words.dictionary_encode()


def hash_words(words: pa.Array) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hash of every word); each distinct word of the batch is hashed once."""
    offsets, coded = split_words(texts, lower)
    return offsets, hash_words(coded.dictionary)[coded.indices.to_numpy()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position that has n words (ends of texts are the caller's)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:size].copy()
    for j in range(1, n):
        h *= _M
        h += hashes[j : j + size]
    return mix(h)
