"""Exact top-k inner products by branch and bound over ball trees, one tree for each shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import distinct, packed, shards, two_rounds, usable

SHARD_ROWS = 16_384
LEAF_ROWS = 128
#: float64 sums of integers are exact below this.
_EXACT = 2.0**53


def ball_tree(m: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row order, bounds, children, centres, radii); node 0 is the root, leaves have child -1.

    Halves are cut at the median along the line between two far points, by position, so equal rows
    split as well.
    """
    order = np.arange(len(m))
    bounds, children = [(0, len(m))], [-1]
    centres, radii = [], []
    at = 0
    while at < len(bounds):
        lo, hi = bounds[at]
        rows = m[order[lo:hi]]
        centre = rows.mean(0)
        far = np.sqrt(((rows - centre) ** 2).sum(1))
        centres.append(centre)
        radii.append(far.max())
        if hi - lo > leaf and far.max() > 0:
            a = rows[far.argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            side = rows @ (b - a)
            cut = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(side, cut)]
            children[at] = len(bounds)
            bounds += [(lo, lo + cut), (lo + cut, hi)]
            children += [-1, -1]
        at += 1
    return order, np.array(bounds), np.array(children), np.array(centres), np.array(radii)


def _integers(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); float64, whose values are whole numbers."""
    return np.floor(scale * m)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits stay at the nearest 64-bit value."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    limit = 2**63 - 1
    return np.array([[max(-limit - 1, min(limit, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole[1]] for p in whole[0]], np.int64)


def _find(k: int, scale: float):
    def find(part, ids, m, bounds):
        rows, of_row, owner, (order, spans, children, centres, radii) = part
        q = _integers(m, scale)
        norm = np.sqrt((q * q).sum(1))
        # Bounds are rounded; this much more keeps them bounds.
        slack = 1e-9
        kth = bounds.copy()
        best_s = np.full((len(q), k), np.iinfo(np.int64).min)
        best_v = np.full((len(q), k), np.iinfo(np.int64).max)
        got = np.zeros(len(q), int)

        def upper(node: int, who: np.ndarray) -> np.ndarray:
            reach = norm[who] * radii[node]
            return q[who] @ centres[node] + reach + slack * (norm[who] * np.sqrt((centres[node] ** 2).sum()) + reach) + slack

        def leaf(node: int, who: np.ndarray) -> None:
            at = order[slice(*spans[node])]
            scores = _products(q[who], rows[at])
            for j, w in enumerate(who):
                s = scores[j]
                near = np.flatnonzero(s >= kth[w])
                if len(near) > k:
                    near = near[s[near] >= np.partition(s[near], -k - 1)[-k - 1]]
                v = np.concatenate([of_row[owner[r] : owner[r + 1]] for r in at[near]] or [np.empty(0, np.int64)])
                c = np.repeat(s[near], owner[at[near] + 1] - owner[at[near]])
                own = v != ids[w]
                v, c = np.concatenate([best_v[w, : got[w]], v[own]]), np.concatenate([best_s[w, : got[w]], c[own]])
                top = np.lexsort([v, -c])[:k]
                got[w] = len(top)
                best_v[w, : got[w]], best_s[w, : got[w]] = v[top], c[top]
                if got[w] == k:
                    kth[w] = max(kth[w], best_s[w, k - 1])

        def descend(node: int, who: np.ndarray, reach: np.ndarray) -> None:
            live = reach >= kth[who]
            who = who[live]
            if not len(who):
                return
            if children[node] < 0:
                leaf(node, who)
                return
            a = children[node]
            up_a, up_b = upper(a, who), upper(a + 1, who)
            first = up_a >= up_b
            # Each query takes its child of the higher bound first; what that finds tightens the other visit.
            for child, picked, up in ((a, first, up_a), (a + 1, ~first, up_b), (a + 1, first, up_b), (a, ~first, up_a)):
                if picked.any():
                    descend(child, who[picked], up[picked])

        everyone = np.arange(len(q))
        descend(0, everyone, upper(0, everyone))
        have = np.arange(k) < got[:, None]
        return np.repeat(ids, got), best_v[have], best_s[have]

    return find


def top_k(
    df: DataFrame,
    spark: SparkSession,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own.
    Ties go to the smaller id; with fewer candidates all are returned.  Vectors that are null or
    empty or hold null or non-finite components take no part, nor do rows with a null id.  Only
    vectors of one dimension meet.  If an id repeats, the least of its vectors counts.  An empty
    table gives no rows; other columns are ignored.  Products beyond 64 bits rank as the nearest 64-bit
    number, which the score then is; components below 2**31 / scale never come near that.
    """
    scratch = Scratch(spark)
    rows, n = shards(usable(df, vec_id, embedding, nonzero=False), shard_rows)

    def build(ids: np.ndarray, m: np.ndarray):
        rows, of_row, owner = distinct(ids, _integers(m, scale), k + 1)
        return rows, of_row, owner, ball_tree(rows)

    index = scratch.keep(packed(rows, build))
    queries = rows.where(F.col("vec_id") % every == 0)
    return two_rounds(rows, queries, n, index, _find(k, scale), k, "long", scratch)
