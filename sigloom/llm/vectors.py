"""Vector tables cut into shards of bounded size, and the pairing of query blocks with shards."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shards whose queries make one block (a query in fifty rows), and queries that are searched at once.
TOGETHER, AT_ONCE = 50, 512


def usable(df: DataFrame, vec_id: str, embedding: str, nonzero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is whole and finite.

    Rows with a null id, and null or empty vectors or ones that hold null or non-finite (for
    ``nonzero`` also only zero) components take no part.
    """
    v = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & (F.exists("v", lambda x: x != 0) if nonzero else F.lit(True))
    )


def shards(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Rows with a shard number (by id hash, one range for each dimension), and shards a dimension."""
    n = max(1, math.ceil(rows.count() / shard_rows))
    number = F.size("v").cast("long") * n + F.pmod(F.xxhash64("vec_id"), F.lit(n))
    return rows.withColumn("shard", number), n


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a shard in order of id; of rows with one id the least vector stays."""
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy()
    lists = table.column("v").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        order = np.lexsort([*m.T[::-1], ids])
        ids, m = ids[order], m[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, m = ids[first], m[first]
    return ids, m


def distinct(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, their k least ids, bounds of these): more ids of one vector never rank."""
    u, inverse = np.unique(m, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.lexsort([ids, inverse])
    inverse = inverse[order]
    starts = np.searchsorted(inverse, np.arange(len(u) + 1))
    few = np.arange(len(inverse)) - starts[inverse] < k
    return u, ids[order][few], np.searchsorted(inverse[few], np.arange(len(u) + 1))


def packed(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """(shard, part): what ``build`` makes of each shard's ids and matrix, as one binary value."""

    def run(table: pa.Table) -> pa.Table:
        part = pickle.dumps(build(*arrays(table)), protocol=5)
        return pa.table({"shard": table.column("shard").slice(0, 1), "part": pa.array([part], pa.binary())})

    return rows.groupBy("shard").applyInArrow(run, "shard long, part binary")


def search(
    index: DataFrame,
    queries: DataFrame,
    per_dimension: int,
    find: Callable[[object, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    home: bool,
    score: str,
) -> DataFrame:
    """Run ``find(part, ids, matrix, bounds)`` for queries against shards.

    ``home`` pairs each query with its own shard only, otherwise with every other shard of its dimension.
    Queries come with a bound: a score that the k-th result is known to reach.  Queries of many shards make
    one block, about as many as a shard has rows: so a shard goes to a block for each ``TOGETHER`` shards, not to
    one for each, and what is sent is mostly queries.
    """
    n = per_dimension
    blocks_of = 1 if home else -(-n // TOGETHER)
    first = lambda c: F.floor(F.col(c) / n) * n
    if home:
        parts = index.withColumn("block", F.col("shard"))
        blocks = queries.withColumns({"block": F.col("shard"), "home": F.col("shard")})
    else:
        parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_of - 1))))
        blocks = queries.withColumnRenamed("shard", "home").withColumn("block", F.floor(F.pmod("home", F.lit(n)) / TOGETHER).cast("int"))
        blocks = blocks.withColumn("shard", F.explode(F.sequence(first("home"), first("home") + n - 1))).where("home <> shard")

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kind = pa.int64() if score == "long" else pa.float64()
        out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=names)]
        if part.num_rows and block.num_rows:
            bounds = dict(zip(block.column("vec_id").to_pylist(), block.column("bound").to_pylist(), strict=True))
            ids, m = arrays(block)
            at = np.array([-math.inf if bounds[i] is None else bounds[i] for i in ids.tolist()], float)
            made = pickle.loads(part.column("part")[0].as_py())
            for a in range(0, len(ids), AT_ONCE):
                q, v, s = find(made, ids[a : a + AT_ONCE], m[a : a + AT_ONCE], at[a : a + AT_ONCE])
                out.append(pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)], names=names))
        return pa.concat_tables(out)

    both = parts.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block"))
    return both.applyInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k first: highest score, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def two_rounds(rows: DataFrame, queries: DataFrame, n: int, index: DataFrame, find, k: int, score: str, scratch) -> DataFrame:
    """Search home shards first; the k-th scores found there bound the search of all others."""
    queries = queries.select("vec_id", "v", "shard")
    near = scratch.keep(search(index, queries.withColumn("bound", F.lit(None).cast("double")), n, find, True, score))
    if n == 1:
        return best(near, k)
    kth = best(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    far = search(index, queries.join(kth, "vec_id", "left"), n, find, False, score)
    return best(near.unionByName(far), k)
