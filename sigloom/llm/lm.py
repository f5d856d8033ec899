"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Counted in Spark in two passes: distinct tokens, then distinct bigrams.  Tokens are numbered by their
place in a sorted array of 64-bit hashes, so a bigram is one 64-bit key.  Tasks send distinct bigrams
in compressed blocks to parts by context (contexts with many tokens are spread over all parts); each
part keeps a sorted key array with counts and its contexts' sums.  Workers map these files and look up
whole slices of texts at once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import load, planes, save, unplanes
from .common import Scratch, arrow_map
from .words import hash_words, mix, split_words, text_slices, with_text

#: Words hold no space, so no word is taken for the end.
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
TOKENS_A_PART = 500_000
BIGRAMS_A_PART = 1_500_000
#: Tokens that a task gathers before it sends its distinct bigrams.
GATHER = 4_000_000
#: A context with more than this share of the tokens is spread over all parts.
HOT_SHARE = 1 / 2000


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, tokens with an end behind each text, bounds of the texts)."""
    offsets, coded = split_words(texts, lower=True)
    hashes = np.append(hash_words(coded.dictionary), END)
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(hashes) - 1)
    return hashes, codes, offsets + np.arange(len(offsets))


def _previous(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = start
    return before


@dataclass
class Model:
    """Where the arrays lie and what doesn't grow with the corpus."""

    folder: str
    tokens: int = 0
    types: int = 0
    token_files: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    bits: int = 0
    bigrams: int = 0
    bigram_files: list[str] = field(default_factory=list)
    continued_files: list[str] = field(default_factory=list)
    hot: list[int] = field(default_factory=list)
    hot_sums: dict[int, tuple] = field(default_factory=dict)
    discounts: tuple = (0.5, 1.0, 1.5)
    low_discounts: tuple = (0.5, 1.0, 1.5)
    low_counts: tuple = (0, 0, 0)


class Reader:
    """A model opened on a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.tokens = [load(model.folder, x) for x in model.token_files]
        self.bigrams = [load(model.folder, x) for x in model.bigram_files]
        self.continued = [load(model.folder, x) for x in model.continued_files]
        self.starts = np.array(model.starts + [model.types], np.int64)
        self.hot = np.array(sorted(model.hot), np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, continuation count) of token hashes."""
        ids, counts, continued = (np.full(len(hashes), v, np.int64) for v in (-1, 0, 0))
        part = (hashes >> np.uint64(64 - self.m.bits)).astype(np.int64) if self.m.bits else np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        edges = np.searchsorted(part[order], np.arange(len(self.tokens) + 1))
        for p, a in enumerate(self.tokens):
            at = order[edges[p] : edges[p + 1]]
            if len(at) and len(a["hash"]):
                found = np.minimum(np.searchsorted(a["hash"], hashes[at]), len(a["hash"]) - 1)
                same = a["hash"][found] == hashes[at]
                ids[at[same]] = found[same] + self.starts[p]
                counts[at[same]] = a["count"][found[same]]
                if self.continued:
                    continued[at[same]] = self.continued[p]["count"][found[same]]
        return ids, counts, continued

    def part(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return part_of(v, w, self.hot, len(self.bigrams))

    def sums(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bigram count, context count, weight left over by the context) for ids (-1: unknown)."""
        counts, of_context, left = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v))
        d1, d2, d3 = self.m.discounts
        key = (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint32)
        part = self.part(v, w)
        order = np.lexsort([key, part])
        order = order[v[order] >= 0]
        edges = np.searchsorted(part[order], np.arange(len(self.bigrams) + 1))
        for p, a in enumerate(self.bigrams):
            at = order[edges[p] : edges[p + 1]]
            if not len(at):
                continue
            if len(a["key"]):
                found = np.minimum(np.searchsorted(a["key"], key[at]), len(a["key"]) - 1)
                same = (a["key"][found] == key[at]) & (w[at] >= 0)
                counts[at[same]] = a["count"][found[same]]
            if len(a["context"]):
                found = np.minimum(np.searchsorted(a["context"], v[at]), len(a["context"]) - 1)
                same = a["context"][found] == v[at]
                f = found[same]
                of_context[at[same]] = a["total"][f]
                left[at[same]] = d1 * a["n1"][f] + d2 * a["n2"][f] + d3 * a["n3"][f]
        for h, (total, n1, n2, n3) in self.m.hot_sums.items():
            of_context[v == h] = total
            left[v == h] = d1 * n1 + d2 * n2 + d3 * n3
        return counts, of_context, left

    def log_probabilities(self, v: np.ndarray, w: np.ndarray, continued: np.ndarray) -> np.ndarray:
        """log10 of the interpolated probability of each token w after v."""
        counts, total, left = self.sums(v, w)
        low = _discounted(continued, self.m.low_discounts) / max(1, self.m.bigrams)
        spare = sum(d * n for d, n in zip(self.m.low_discounts, self.m.low_counts, strict=True)) / max(1, self.m.bigrams)
        low = low + (spare if self.m.bigrams else 1.0) / (self.m.types + 1)
        known = total > 0
        total = np.maximum(total, 1)
        return np.log10(np.where(known, _discounted(counts, self.m.discounts) / total + left / total * low, low))


def _discounted(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(n - np.choose(np.clip(n, 0, 3), [0.0, *d]), 0)


def part_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """A bigram's part: by context, or by both words where the context is hot."""
    both = np.isin(v, hot)
    with np.errstate(over="ignore"):
        h = mix(v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(both, w, 0).astype(np.uint64) + np.uint64(1))
    return (h % np.uint64(parts)).astype(np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many items occur 1, 2, 3 and 4 times.

    Where too few occur to tell, absolute discounts of 0.5, 1 and 1.5 stand in.
    """
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k, max(0.05 * k, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def _count_tokens(df: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, held = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
            u, inverse = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, n).astype(np.int64))], names=["h", "n"])

        for _, texts in text_slices(batches, 0):
            hashes, codes, _ = _tokens(texts)
            have.append((hashes, np.bincount(codes, minlength=len(hashes))))
            held += len(hashes)
            if held > GATHER // 2:
                yield out()
                have, held = [], 0
        if have:
            yield out()

    return arrow_map(df.select(text), run, "h long, n long")


def train(df: DataFrame, spark: SparkSession, text: str = "text", scratch: Scratch | None = None) -> Model:
    """Fit on every whole text (null: empty) of ``df``.

    The vocabulary may have up to 2**32 - 2 distinct tokens.  An empty table gives a uniform model.
    """
    scratch = scratch or Scratch(spark)
    folder = f"{scratch.root}/model"
    model = Model(folder)
    seen = _count_tokens(df, text).groupBy("h").agg(F.sum("n").alias("n"))
    seen = scratch.keep(seen)
    size = seen.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    model.types, model.tokens = size["types"], size["tokens"]
    if model.types > 2**32 - 2:
        raise ValueError(f"{model.types} distinct tokens: ids have 32 bits")
    model.bits = bits = max(0, math.ceil(math.log2(max(1, model.types / TOKENS_A_PART))))

    def store_tokens(t: pa.Table) -> pa.Table:
        h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(h)
        told = save(folder, hash=h[order], count=n[order].astype(np.uint32 if n.max() < 2**32 else np.uint64))
        return pa.table({"part": t.column("part").slice(0, 1), "told": [told], "size": pa.array([len(h)], pa.int64())})

    by_top = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    files = scratch.keep(seen.withColumn("part", by_top).groupBy("part").applyInArrow(store_tokens, "part long, told string, size long"))
    got = {r["part"]: r for r in files.collect()}
    sizes = [got[p]["size"] if p in got else 0 for p in range(2**bits)]
    nothing = None
    if any(not s for s in sizes):
        nothing = save(folder, hash=np.zeros(0, np.uint64), count=np.zeros(0, np.uint32))
    model.token_files = [got[p]["told"] if p in got else nothing for p in range(2**bits)]
    model.starts = [0, *np.cumsum(sizes)[:-1].tolist()]
    if not model.tokens:
        return model
    # At most 1 / HOT_SHARE tokens can be this frequent.
    most = [int(r["h"]) for r in seen.where(F.col("n") > model.tokens * HOT_SHARE).select("h").collect()]
    reader = Reader(model)
    hot = reader.ids(np.array(most, np.int64).view(np.uint64))[0]
    start_id = model.types
    model.hot = sorted([int(x) for x in hot] + [start_id])
    scratch.drop(seen)
    parts = max(1, math.ceil(model.tokens / BIGRAMS_A_PART))
    rows = _send_bigrams(df, text, model, parts)

    def merge(t: pa.Table) -> pa.Table:
        keys, counts = [], []
        for dv, w, n in zip(*(t.column(c).to_pylist() for c in ("dv", "w", "n")), strict=True):
            v = np.cumsum(unplanes(dv, np.uint32).astype(np.uint64))
            keys.append((v << np.uint64(32)) | unplanes(w, np.uint32))
            counts.append(unplanes(n, np.uint32))
        key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        v, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)]
        spread = np.isin(v[at], hot_ids)
        told = save(
            folder,
            key=key,
            count=n.astype(np.uint32 if n.max() < 2**32 else np.uint64) if n.max() > 255 else n.astype(np.uint8),
            context=v[at][~spread].astype(np.uint32),
            **{name: s[~spread].astype(np.uint32 if s.max() < 2**32 else np.uint64) for name, s in zip(("total", "n1", "n2", "n3"), sums, strict=True)},
        )
        shared = {int(c): [int(s[i]) for s in sums] for i, c in zip(np.flatnonzero(spread), v[at][spread], strict=True)}
        u, m = np.unique(w, return_counts=True)
        cut = np.searchsorted(u, starts)
        cut = np.append(cut, len(u))
        out = [(p, planes(u[a:b].astype(np.uint32)), planes(m[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        tell = [None] * len(out)
        tell[0] = json.dumps({"part": t.column("part")[0].as_py(), "told": told, "hot": shared, "of": [int((n == k).sum()) for k in (1, 2, 3, 4)], "size": len(key)})
        names = ["part", "w", "n", "tell"]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()), pa.array(tell, pa.string())], names=names)

    hot_ids, starts = np.array(model.hot, np.int64), np.array(model.starts, np.int64)
    ended = scratch.keep(rows.groupBy("part").applyInArrow(merge, "part long, w binary, n binary, tell string"))
    told = [json.loads(r["tell"]) for r in ended.where("tell IS NOT NULL").select("tell").collect()]
    by = {x["part"]: x["told"] for x in told}
    if len(by) < parts:
        z = np.zeros(0, np.uint32)
        nothing = save(folder, key=np.zeros(0, np.uint64), count=z, context=z, total=z, n1=z, n2=z, n3=z)
    model.bigram_files = [by.get(p, nothing) for p in range(parts)]
    model.bigrams = sum(x["size"] for x in told)
    model.discounts = discounts([sum(x["of"][k] for x in told) for k in range(4)])
    for x in told:
        for h, sums in x["hot"].items():
            had = model.hot_sums.get(int(h), (0, 0, 0, 0))
            model.hot_sums[int(h)] = tuple(a + b for a, b in zip(had, sums, strict=True))

    ends = np.append(starts[1:], model.types)

    def continue_(t: pa.Table) -> pa.Table:
        p = t.column("part")[0].as_py()
        total = np.zeros(ends[p] - starts[p], np.int64)
        for w, n in zip(t.column("w").to_pylist(), t.column("n").to_pylist(), strict=True):
            total[unplanes(w, np.uint32).astype(np.int64) - starts[p]] += unplanes(n, np.uint32)
        told = save(folder, count=total.astype(np.uint32 if total.max() < 2**32 else np.uint64))
        of = [int((total == k).sum()) for k in (1, 2, 3, 4)] + [int((total >= 3).sum())]
        return pa.table({"part": pa.array([p], pa.int64()), "told": [told], "of": pa.array([of], pa.list_(pa.int64()))})

    low = ended.select("part", "w", "n").groupBy("part").applyInArrow(continue_, "part long, told string, of array<long>")
    low = {r["part"]: r for r in scratch.keep(low).collect()}
    nothing = save(folder, count=np.zeros(0, np.uint32))
    model.continued_files = [low[p]["told"] if p in low else nothing for p in range(2**bits)]
    of = [sum(r["of"][k] for r in low.values()) for k in range(5)]
    model.low_discounts, model.low_counts = discounts(of[:4]), (of[0], of[1], of[4])
    scratch.drop(ended)
    return model


def _send_bigrams(df: DataFrame, text: str, model: Model, parts: int) -> DataFrame:
    """Blocks of distinct bigrams with counts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        have, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(have)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key))).astype(np.uint32)
            key = key[first]
            v, w = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            part = part_of(v.astype(np.int64), w.astype(np.int64), reader.hot, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[edges[p] : edges[p + 1]]
                if len(at):
                    cells = [planes(np.diff(v[at], prepend=np.uint32(0))), planes(w[at]), planes(n[at])]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["part", "dv", "w", "n"])

        for _, texts in text_slices(batches, 0):
            hashes, codes, bounds = _tokens(texts)
            w = reader.ids(hashes)[0][codes]
            v = _previous(w, bounds, model.types)
            have.append((v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))
            held += len(w)
            if held > GATHER:
                yield from out()
                have, held = [], 0
        if held:
            yield from out()

    return arrow_map(df.select(text), run, "part long, dv binary, w binary, n binary")


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, base_score (add-one unigrams) and score.

    Scores are log10 probabilities of the whole text and its end; a null text counts as empty.  Rows
    are independent; other columns are ignored, and kept ones named like the new ones are replaced.
    """
    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    keep = tuple(c for c in keep if c not in dict(kinds))
    sent, at = with_text(df, text, keep)
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, k) for n, k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch, texts in text_slices(batches, at):
            hashes, codes, bounds = _tokens(texts)
            ids, counts, continued = reader.ids(hashes)
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))
            w = ids[codes]
            each = reader.log_probabilities(_previous(w, bounds, model.types), w, continued[codes])
            first = bounds[:-1]
            columns = [np.diff(bounds), np.add.reduceat((w >= 0).astype(np.int64), first), np.add.reduceat(base[codes], first), np.add.reduceat(each, first)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns)], names=out.names)

    return arrow_map(sent, run, out)
