"""Approximate nearest neighbours by additive quantisation.

A vector of unit length is written as the sum of one entry from each of several full-dimensional
codebooks, each fitted to what the ones before leave over.  Beam search picks the entries.  The index
keeps the entry numbers and the length of the sum; a query scores them by one table of inner products
for each codebook, and the best of a shard are ranked again by the exact cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import distinct, packed, shards, two_rounds, usable

#: Rows at most that the codebooks are fitted on (every row is indexed).
TRAIN_ROWS = 8_192
SHARD_ROWS = 16_384
CODEBOOKS, ENTRIES, BEAM = 16, 256, 4
#: Of each shard, candidates ranked exactly: this many, or this share if that is more.
RERANK, RERANK_SHARE = 256, 0.03


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.exp2(np.frexp(np.abs(m).max(1))[1])[:, None]  # exact; squares can't overflow
    return m / np.sqrt((m * m).sum(1))[:, None]


def train(sample: np.ndarray, codebooks: int = CODEBOOKS, entries: int = ENTRIES, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Codebooks (codebook, entry, dimension), each by k-means on the residuals so far."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32).copy()
    entries = min(entries, len(left))
    books = []
    for _ in range(codebooks):
        book = left[rng.choice(len(left), entries, replace=False)].copy()
        for _ in range(rounds):
            nearest = (2 * left @ book.T - (book * book).sum(1)).argmax(1)
            sums = np.zeros_like(book)
            np.add.at(sums, nearest, left)
            counts = np.bincount(nearest, minlength=entries)
            full = counts > 0
            book[full] = sums[full] / counts[full, None]
        nearest = (2 * left @ book.T - (book * book).sum(1)).argmax(1)
        left -= book[nearest]
        books.append(book)
    return np.stack(books)


def encode(m: np.ndarray, books: np.ndarray, beam: int = BEAM, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(entry numbers, length of the sum) of each row; beam search over the codebooks in turn."""
    count, entries, dim = books.shape
    codes, norms = np.empty((len(m), count), np.uint8), np.empty(len(m), np.float32)
    squares = (books * books).sum(2)
    for start in range(0, len(m), block):
        x = m[start : start + block].astype(np.float32)
        n = len(x)
        left = x[:, None, :]
        error = (x * x).sum(1)[:, None]
        chosen = np.zeros((n, 1, 0), np.uint8)
        for b in range(count):
            width = left.shape[1]
            cost = error[:, :, None] - 2 * (left.reshape(-1, dim) @ books[b].T).reshape(n, width, entries) + squares[b]
            cost = cost.reshape(n, -1)
            take = min(beam, cost.shape[1])
            top = np.argpartition(cost, take - 1, 1)[:, :take]
            error = np.take_along_axis(cost, top, 1)
            parent, entry = top // entries, top % entries
            left = np.take_along_axis(left, parent[:, :, None], 1) - books[b][entry]
            chosen = np.concatenate([np.take_along_axis(chosen, parent[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
        best = error.argmin(1)
        codes[start : start + n] = chosen[np.arange(n), best]
        norms[start : start + n] = np.sqrt(((x - left[np.arange(n), best]) ** 2).sum(1))
    return codes, np.maximum(norms, 1e-6)


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; a row's value doesn't depend on the rows beside it."""
    q = q / np.exp2(np.frexp(np.abs(q).max())[1])
    rows = rows / np.exp2(np.frexp(np.abs(rows).max(1))[1])[:, None]
    return (rows * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((rows * rows).sum(1)))


def _find(k: int, models: dict[int, np.ndarray], rerank: int, share: float):
    def find(part, ids, m, bounds):
        rows, of_row, owner, codes, norms = part
        books = models[rows.shape[1]]
        tables = np.einsum("qd,bed->qbe", unit(m).astype(np.float32), books)
        take = min(len(rows), max(rerank, int(share * len(rows))))
        qs, vs, ss = [], [], []
        for w in range(len(m)):
            rough = tables[w, 0][codes[:, 0]]
            for b in range(1, len(books)):
                rough = rough + tables[w, b][codes[:, b]]
            rough /= norms
            near = np.argpartition(-rough, take - 1)[:take] if take < len(rows) else np.arange(len(rows))
            exact = _exact(m[w], rows[near])
            good = exact >= bounds[w]
            near, exact = near[good], exact[good]
            if len(near) > k + 1:
                good = exact >= np.partition(exact, -k - 1)[-k - 1]
                near, exact = near[good], exact[good]
            v = np.concatenate([of_row[owner[r] : owner[r + 1]] for r in near] or [np.empty(0, np.int64)])
            s = np.repeat(exact, owner[near + 1] - owner[near])
            own = v != ids[w]
            v, s = v[own], s[own]
            top = np.lexsort([v, -s])[:k]
            qs.append(np.full(len(top), ids[w]))
            vs.append(v[top])
            ss.append(s[top])
        return np.concatenate(qs), np.concatenate(vs), np.concatenate(ss)

    return find


def fit(rows: DataFrame, train_rows: int) -> dict[int, np.ndarray]:
    """Codebooks for each dimension, from a bounded sample: the rows least by the hash of their id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("v").toArrow().column("v").to_pylist()
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    return {d: train(unit(np.array(vs, float))) for d, vs in by.items()}


def nearest(
    df: DataFrame,
    spark: SparkSession,
    k: int = 5,
    every: int = 50,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    train_rows: int = TRAIN_ROWS,
    shard_rows: int = SHARD_ROWS,
    rerank: int = RERANK,
    share: float = RERANK_SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest cosines among those found.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own.
    Codebooks are fitted on at most ``train_rows`` rows; every row is encoded and scored.  Scores are
    exact cosines of the original vectors.  Ties go to the smaller id.  Vectors that are null, empty
    or zero or hold null or non-finite components take no part, nor do rows with a null id.  Only
    vectors of one dimension meet; a dimension that the sample misses is ranked exactly.  If an id
    repeats, the least of its vectors counts.  An empty table gives no rows.
    """
    scratch = Scratch(spark)
    rows, n = shards(usable(df, vec_id, embedding, nonzero=True), shard_rows)
    models = fit(rows, train_rows)

    def build(ids: np.ndarray, m: np.ndarray):
        rows, of_row, owner = distinct(ids, m, k + 1)
        books = models.get(m.shape[1])
        if books is None:
            books = np.zeros((1, 1, m.shape[1]), np.float32)
        return rows, of_row, owner, *encode(unit(rows), books)

    def find(part, ids, m, bounds):
        known = m.shape[1] in models
        by = models if known else {m.shape[1]: np.zeros((1, 1, m.shape[1]), np.float32)}
        return _find(k, by, rerank, share if known else 1.0)(part, ids, m, bounds)

    index = scratch.keep(packed(rows, build))
    queries = rows.where(F.col("vec_id") % every == 0)
    return two_rounds(rows, queries, n, index, find, k, "double", scratch)
