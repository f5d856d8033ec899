"""Near-duplicate documents by b-bit MinHash over word shingles, confirmed on full shingle sets.

Every document gets the minima of its shingles under many hash functions.  Bands of minima give
candidates; of each minimum only the low bits are kept, packed into a signature, and the share of equal
packed values, corrected for chance collisions, estimates the similarity before the exact check.

Equal shingle sets are one class from the start.  Within a bucket a hub is compared with all members, so
a large group of near copies takes one link a member; what lies in one component then needs no more pairs.
Members of different components are finally compared with each other, block by block, so no link
between components is lost to the hubs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, in_blocks, link_buckets
from .words import mix, text_slices, windows, with_text, word_hashes

WORDS = 5
SIMILARITY = 0.75
#: A pair of similarity 0.75 misses all 32 bands of 4 minima once in 190,000 times.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum.
BITS = 4
#: Estimates this much below the wanted similarity are still checked: over six standard deviations.
MARGIN = 0.25
#: Bytes of shingle sets that a group of the last comparison holds, about.
PART_BYTES = 8 << 20

_MULTIPLIERS = (np.random.default_rng(20240501).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text; A-Z count as a-z.

    A text of fewer than n words has its whole sequence as the one shingle, one without words none.
    """
    offsets, hashes = word_hashes(texts, lower=True)
    h = windows(hashes, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            out.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """(set, hash function): least value of each non-empty set under each function."""
    out = np.empty((len(sets), len(_MULTIPLIERS)), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= block):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start:stop]])[:-1]]).astype(np.int64)
        for k, m in enumerate(_MULTIPLIERS):
            out[start:stop, k] = np.minimum.reduceat(flat * m, at)
        start = stop
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    cells = least.reshape(len(least), BANDS, ROWS)
    h = np.full((len(least), BANDS), np.uint64(0)) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return h


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 64 // BITS of them in each word."""
    per = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(len(least), BANDS * ROWS // per, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def estimate(a: str, b: str):
    """Similarity from two packed signatures: the share of equal values, less chance collisions."""
    count = BANDS * ROWS
    ones = sum(1 << k for k in range(0, 64, BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for k in range(count * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        spread = x
        for s in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(spread.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(count) - chance) / (1 - chance)


def signatures(df: DataFrame, text: str, keep: tuple[str, ...], n: int) -> DataFrame:
    """``keep``, n_shingles, the set's 128-bit digest, band keys and packed low bits (null if empty)."""
    more = [("n_shingles", "long"), ("d1", "long"), ("d2", "long"), ("bands", "array<long>"), ("bits", "array<long>")]
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T._parse_datatype_string(k)) for c, k in more])
    sent, at = with_text(df, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, at, 2 << 20):
            sets = shingle_sets(texts, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            least = minima([sets[i] for i in full])
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)

            def lists(rows: np.ndarray) -> pa.Array:
                rows = rows.view(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes > 0)]) * rows.shape[1]
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()))

            columns = [pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists(band_keys(least)), lists(packed(least))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=out.names)

    return arrow_map(sent, run, out)


def _sets(df: DataFrame, n: int) -> DataFrame:
    """(rep, hashes): the full shingle set of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, 1, 2 << 20):
            sets = pa.array([s.tobytes() for s in shingle_sets(texts, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["rep", "hashes"])

    return arrow_map(df.select("rep", "text"), run, "rep long, hashes binary")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are that similar."""
    few, many = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(few) < percent * len(many):
        return False
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose estimates come near the wanted similarity, and whose full sets are at least that similar."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = ((np.frombuffer(v.as_py(), np.uint64) for v in batch.column(c)) for c in (2, 3))
            good = [_alike(x, y, percent) for x, y in zip(*full, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (sets.select(F.col("rep").alias(c), F.col("hashes").alias(f"x_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    both = pairs.join(y, "b").join(x, "a").where(estimate("bits_a", "bits_b") >= similarity - MARGIN)
    return arrow_map(both.select("a", "b", "x_a", "x_b"), run, "a long, b long")


def _between(side: DataFrame, traits: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components.

    Buckets are cut into blocks, and every two blocks of a bucket meet.  Members that the estimate pairs
    with none of another component go first; the others meet with full sets, and a meeting tells
    only links that join what its other links haven't joined yet.
    """
    percent = round(similarity * 100)
    cut = in_blocks(side).join(traits, "rep")
    x, y = cut.alias("x"), cut.alias("y")
    meet = " AND ".join(f"x.{c} = y.{c}" for c in ("key", "i", "j")) + " AND (x.i = x.j OR x.own <> y.own) AND x.root <> y.root"
    some = scratch.keep(x.join(y, F.expr(meet) & (estimate("x.bits", "y.bits") >= similarity - MARGIN), "left_semi"))
    size = some.agg(F.coalesce(F.sum(F.col("n_shingles") * 8), F.lit(0)).alias("n")).first()["n"]
    part = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, math.ceil(size / PART_BYTES))))
    some = some.join(sets.select("rep", "hashes"), "rep").select(part.alias("part"), "key", "i", "j", "own", "rep", "root", "bits", "hashes")
    chance, ones = 1 / (1 << BITS), np.uint64(sum(1 << k for k in range(0, 64, BITS)))

    def meeting(rep: np.ndarray, root: np.ndarray, own: np.ndarray, low: np.ndarray, full: list[np.ndarray], same: bool) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) for x in full])
        _, group = np.unique(root, return_inverse=True)
        for a in range(len(rep)):
            apart = group != group[a]
            apart[: a + 1] = False
            if not same:
                apart &= own != own[a]
            apart &= 100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])
            near = np.flatnonzero(apart)
            x = low[near] ^ low[a]
            spread = x.copy()
            for s in range(1, BITS):
                spread |= x >> np.uint64(s)
            differ = np.bitwise_count(spread & ones).sum(1)
            for b in near[(1 - differ / (BANDS * ROWS) - chance) / (1 - chance) >= similarity - MARGIN]:
                if group[b] != group[a] and _alike(full[a], full[b], percent):
                    yield int(min(rep[a], rep[b])), int(max(rep[a], rep[b]))
                    group[group == group[b]] = group[a]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        key, i, j, own, rep, root = (t.column(c).to_numpy() for c in ("key", "i", "j", "own", "rep", "root"))
        low = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
        full = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        links = set()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            links.update(meeting(rep[a:b], root[a:b], own[a:b], low[a:b], full[a:b], i[a] == j[a]))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return some.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def groups(
    df: DataFrame,
    spark: SparkSession,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    n: int = WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, component) of every row.

    Documents are linked if their sets of distinct ``n``-word shingles have a Jaccard similarity of at
    least ``similarity``; component_id is the smallest id reachable over links, kept marks that
    document.  A document without words is linked with nothing.  ``row`` is a digest of the text, null for a
    null one: rows that repeat an id are judged each by its own text, and one id alone links nothing; so one id
    may lie in two components, which ``component`` tells apart.
    A row with a null id gets no component and is kept.  An empty table gives no rows.
    """
    scratch = scratch or Scratch(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    docs = docs.withColumn("row", F.when(F.col("text").isNotNull(), F.col("row")))
    marks = scratch.keep(signatures(docs, "text", ("id", "row"), n))
    classes = marks.where("n_shingles > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.min_by("row", "id").alias("own"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()))
    own = F.expr("id = least AND row = own")
    told = marks.join(classes, ["d1", "d2"], "left").select("id", "row", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), *(F.when(own, F.col(c)).alias(c) for c in ("bands", "bits")))
    classed = scratch.keep(told)
    scratch.drop(marks)
    reps = scratch.keep(classed.where("bands IS NOT NULL").select("rep", "n_shingles", "bands", "bits").dropDuplicates(["rep"]))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = scratch.keep(keys.join(shared.select("key"), "key").select("key", "rep"))
    involved = members.select("rep").distinct().join(classes.select("rep", F.col("least").alias("id"), F.col("own").alias("row")), "rep")
    texts = docs.join(involved, ["id", "row"])
    texts = _sets(texts.dropDuplicates(["rep"]) if _repeats(classed) else texts, n)
    sets = scratch.keep(texts.join(reps.select("rep", "bits"), "rep"))
    roots = link_buckets(
        members,
        lambda pairs: confirmed(pairs, sets, similarity),
        lambda side: _between(side, reps.select("rep", "n_shingles", "bits"), sets, similarity, scratch),
        scratch,
    ).withColumnRenamed("node", "rep")
    # The smallest id of each component over all its classes.
    least = classes.select("rep", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = least.join(component, "root").select("rep", "component_id", "root")
    out = classed.select("id", "row", "n_shingles", "rep").join(of_class, "rep", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        "row",
        F.col("root").alias("component"),
    )


def _repeats(rows: DataFrame) -> bool:
    """Whether some row occurs twice (then one of each is enough)."""
    return bool(rows.where("rep IS NOT NULL").groupBy("id", "row").count().where("count > 1").limit(1).count())
