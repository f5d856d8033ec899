"""Scratch tables, connected components and bucket linking shared by the corpus operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to a Python worker, about; one longer text is a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of two longs or so that a task writes, and that a broadcast may hold (3 MB).
TASK_ROWS = BROADCAST_ROWS = 200_000
#: Members of a bucket that meet at once when those of different components are compared.
BLOCK = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (single-machine tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sigloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go as soon as the query has ended."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def arrow_map(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes: texts by the ten thousand take more than a worker should hold.

    The limit is a setting of the session that counts when the plan runs, so a larger one is lowered for good.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH, "64m").lower().removesuffix("b")
    size = int(now.rstrip("kmgt")) << "_kmgt".index(now[-1] if now[-1] in "kmgt" else "_") * 10
    if not 0 < size <= BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written once to the shared folder; reading them again needs no earlier stage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The table, written; where at most ``rows`` small rows are known to come, by no more tasks than these need."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        if rows is not None:
            df = df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.remove(df._scratch)

    def remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def crc_mod(column: str, n: int):
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def spare(name: str, taken: Iterable[str]) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "▁"
    return name


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if ``rows``, which bounds its rows of two longs, is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _renamed(x: Column) -> Column:
    """Another long for each long: xorshift, a bijection, so that order along a path doesn't last."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Contraction: each node takes the least name among itself and its neighbours, edges are renamed by it, and
    the rest goes on under new names, whose order is another, so a round leaves a fraction of the nodes of
    paths as well as of stars.  Minima are pre-aggregated and come back by joins, so a node with any
    number of neighbours never meets in one task.  Self-loops and null ends are ignored; an empty
    table gives an empty table.
    """
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    names = None
    size = bound = now.count()
    while size:
        ends = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = ends.groupBy("x").agg(F.min("y").alias("m")).select("x", _renamed(F.least("x", "m")).alias("m"))
        step = scratch.keep(least, 2 * size)
        side = lambda c: small(step.select(F.col("x").alias(c), F.col("m").alias(f"{c}_")), 2 * size)
        left = now.join(side("u"), "u").join(side("v"), "v").where("u_ <> v_")
        after = scratch.keep(left.select(F.greatest("u_", "v_").alias("u"), F.least("u_", "v_").alias("v")).distinct(), size)
        if names is None:
            names = step.select(F.col("x").alias("node"), F.col("m").alias("name"))
        else:
            more = small(step.select(F.col("x").alias("name"), F.col("m").alias("next")), 2 * size)
            # A name without edges is the last one of its component, under whatever names come next.
            names = names.join(more, "name", "left").select("node", F.coalesce("next", _renamed(F.col("name"))).alias("name"))
            names = scratch.keep(names, 2 * bound)
        scratch.drop(now)
        now, size = after, after.count()
    if names is None:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    least = small(names.groupBy("name").agg(F.min("node").alias("root")), 2 * bound)
    return scratch.keep(names.join(least, "name").select("node", "root"), 2 * bound)


def _followed(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, root) after components of roots have been joined; ``joined`` has (root, to)."""
    further = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = roots.join(further, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(joined.join(roots.select("node"), "node", "left_anti"))


def _apart(at: DataFrame) -> DataFrame:
    """Rows of the buckets whose members lie in several components, and ``n_members``, their number."""
    by = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_members")).where("low < high")
    return at.join(by.select("key", "n_members"), "key")


def link_buckets(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    last: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    rounds: int = 1,
    traits: tuple[str, ...] = (),
    close: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """(node, root) of the components of confirmed links between members of one bucket.

    ``members`` is (key, rep, traits); ``confirm`` keeps those of the pairs (a, b) that are links, and
    ``close``, of two prefixes of trait columns, tells which are worth it.  Hubs first: a bucket's least member
    is compared with all others, one pair a member.  Buckets that then lie in one component are done;
    the others take another hub, by a hash, in each further round.  What is still apart is compared
    by ``last``, which gets (key, rep, traits, root, n_members), and returns links, so
    that no link that joins two components is missed.
    """

    def worth(of_hub: DataFrame) -> DataFrame:
        near = close("", "hub_") if close else F.lit(True)
        return of_hub.where(near).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()

    own = ["key", "rep", *traits]
    low = members.groupBy("key").agg(F.min("rep").alias("hub"), *(F.min_by(c, "rep").alias(f"hub_{c}") for c in traits))
    pairs = worth(members.join(low, "key").where("rep <> hub"))
    roots = components(scratch.keep(confirm(pairs)), scratch)
    at = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*own, F.coalesce("root", "rep").alias("root"))
    live = scratch.keep(_apart(scratch.keep(at)))
    for turn in range(1, rounds + 1):
        if turn < rounds:
            order = F.xxhash64("rep", F.lit(turn))
            hubs = live.groupBy("key").agg(F.min_by("rep", order).alias("hub"), F.min_by("root", order).alias("hub_root"), *(F.min_by(c, order).alias(f"hub_{c}") for c in traits))
            links = confirm(worth(live.join(hubs, "key").where("root <> hub_root")))
        else:
            links = last(live)
        links = scratch.keep(links)
        if not links.limit(1).count():
            continue
        # Links between components, by their roots; then every node follows its root.
        root = lambda c: live.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_")).distinct()  # noqa: E731, B023
        between = links.join(root("a"), "a").join(root("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
        joined = components(between, scratch)
        roots = scratch.keep(_followed(roots, joined))
        if turn < rounds:
            moved = live.drop("n_members").join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            live = scratch.keep(_apart(moved.select(*own, F.coalesce("to", "root").alias("root"))))
    return roots


def in_blocks(side: DataFrame) -> DataFrame:
    """Rows with ``n_members``, those of their bucket, as (.., own, i, j): each two blocks of a bucket meet in one group.

    A bucket of at most BLOCK members is one block.
    """
    cut = F.ceil(F.col("n_members") / BLOCK)
    some = side.withColumn("own", F.pmod(F.xxhash64("rep"), cut)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    return some.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with", "n_members")
