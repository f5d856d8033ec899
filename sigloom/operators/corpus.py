"""Corpus checks: uniqueness, references, leakage, pairs, roles, first-occurrence deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep
from .ordered import with_rank, with_running


class Violation(Exception):
    """A table that has to be empty isn't."""


def expect_empty(df: DataFrame, reason: str, show: int = 3) -> None:
    found = df.limit(show).collect()
    if found:
        raise Violation(f"{reason}: {[r.asDict() for r in found]}")


def gates(tables: dict[str, DataFrame]) -> DataFrame:
    """(gate, violations, status) of tables that have to be empty, each counted where it lies."""
    told = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("gate"), F.count("*").alias("violations"))
        told = one if told is None else told.unionByName(one)
    return told.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def expect_equal(a: DataFrame, b: DataFrame, reason: str) -> None:
    """Same rows, as often, in any order: how stored artifacts are verified against recomputation."""
    expect_empty(a.exceptAll(b), f"{reason}, missing")
    expect_empty(b.exceptAll(a), f"{reason}, extra")


def duplicates(df: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, n): key values of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def record_hash(*columns: str) -> Column:
    """A digest of a record's fields, nulls told from empty ones."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def manifest(df: DataFrame, id_: str, columns: tuple[str, ...], buckets: int = 256) -> DataFrame:
    """One row (records, distinct_ids, manifest_sha256): a digest that any changed, added or lost record changes.

    Records are dealt to buckets by a hash of their ids; a bucket's digest is over its records' digests
    in order, the table's over the buckets'.  So no task reads more than its buckets' digests.
    """
    told = df.select(F.col(id_).cast("string").alias("id"), record_hash(id_, *columns).alias("h")).withColumn("bucket", F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % buckets)
    by = told.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("ids"), F.lit(0)).alias("distinct_ids"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["h"])), ","), 256).alias("manifest_sha256"),
    )


def dangling(df: DataFrame, dimension: DataFrame, key: str, ref: str | None = None) -> DataFrame:
    """Rows that refer to no row of the dimension."""
    return df.join(dimension, df[key] == dimension[ref or key], "left_anti")


def disagreements(df: DataFrame, dimension: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose columns differ from those of the row that they refer to."""
    other = dimension.select(key, *(F.col(c).alias(f"ref_{c}") for c in columns))
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"ref_{c}"))
    return df.join(other, key).where(differ)


def unused(dimension: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return dimension.join(df, key, "left_anti")


def leaks(df: DataFrame, family: str, split: str) -> DataFrame:
    """(family, splits): families whose rows lie in more than one split."""
    return df.groupBy(family).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def bad_pairs(df: DataFrame, match: str, label: str, labels: tuple[str, str], signature: tuple[str, ...]) -> DataFrame:
    """(match, n, labels, signatures): groups that aren't two rows of both labels and one signature."""
    by = df.groupBy(match).agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(label)).alias("labels"),
        F.count_distinct(F.struct(*signature)).alias("signatures"),
    )
    want = F.array(*[F.lit(x) for x in sorted(labels)])
    return by.where((F.col("n") != 2) | (F.col("labels") != want) | (F.col("signatures") != 1))


def guards(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows that break a rule, with the names of all rules broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def first_occurrences(df: DataFrame, ordinal: str, key_a: str, key_b: str) -> DataFrame:
    """(ordinal, key_a, key_b, kept, conflict, kinds): single-pass deduplication on two keys.

    In order of ``ordinal`` (unique), a row is dropped if it shares either key with an earlier row that
    was *kept*; a row that collides only with dropped rows stays.  Done in rounds: a row that comes first
    among the undecided ones of both its keys is kept, and the undecided rows that share a key with it are
    dropped.  No group of rows is gathered; rounds are as many as the longest chain of such decisions.
    """
    rows = keep(df.select(F.col(ordinal).cast("long").alias("ordinal"), F.col(key_a).alias("key_a"), F.col(key_b).alias("key_b")))
    open_, stays = rows, []
    while True:
        low_a = open_.groupBy("key_a").agg(F.min("ordinal").alias("low_a"))
        low_b = open_.groupBy("key_b").agg(F.min("ordinal").alias("low_b"))
        first = open_.join(low_a, "key_a").join(low_b, "key_b").where("ordinal = low_a AND ordinal = low_b")
        first = keep(first.select("ordinal", "key_a", "key_b"))
        if not first.limit(1).count():
            break
        stays.append(first)
        open_ = keep(open_.join(first.select("key_a"), "key_a", "left_anti").join(first.select("key_b"), "key_b", "left_anti"))
    kept = rows.limit(0)
    for part in stays:
        kept = kept.unionByName(part)
    by_a = kept.select("key_a", F.col("ordinal").alias("at_a"))
    by_b = kept.select("key_b", F.col("ordinal").alias("at_b"))
    told = rows.join(by_a, "key_a", "left").join(by_b, "key_b", "left")
    before_a, before_b = (F.when(F.col(c) < F.col("ordinal"), F.col(c)) for c in ("at_a", "at_b"))
    stay = F.coalesce(F.col("at_a") == F.col("ordinal"), F.lit(False))
    kinds = F.concat_ws("+", F.when(before_a.isNotNull(), "TEXT"), F.when(before_b.isNotNull(), "TOKENS"))
    return told.select(
        "ordinal", "key_a", "key_b", stay.alias("kept"),
        F.when(~stay, F.least(before_a, before_b)).alias("conflict"),
        F.when(~stay, kinds).alias("kinds"),
    )


def cross_role_conflicts(audit: DataFrame, select: DataFrame, ordinal: str, key_a: str, key_b: str) -> DataFrame:
    """(ordinal, conflict, kinds): audit rows that share a key with a kept row of the other role."""
    def hits(key: str, kind: str) -> DataFrame:
        other = select.groupBy(key).agg(F.min(ordinal).alias("conflict"))
        return audit.select(ordinal, key).join(other, key).select(ordinal, "conflict", F.lit(kind).alias("kind"))

    both = hits(key_a, "TEXT").unionByName(hits(key_b, "TOKENS"))
    return both.groupBy(ordinal).agg(F.min("conflict").alias("conflict"), F.concat_ws("+", F.sort_array(F.collect_set("kind"))).alias("kinds"))


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, shared): distinct values of a key that both tables hold."""
    return a.select(key).intersect(b.select(key)).agg(F.lit(key).alias("key"), F.count("*").alias("shared"))


def first_n(df: DataFrame, role: str, order: str, n: int) -> DataFrame:
    """The first n rows of each role."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(role).orderBy(order))).where(F.col("rank") <= n)


def shard_plan(df: DataFrame, order: str, size: int) -> DataFrame:
    """The rows with a dense index from 0 and their shard of consecutive indices."""
    return with_rank(df, (), [order], "index").withColumn("shard", F.floor(F.col("index") / size))


def gaps(ranges: DataFrame) -> DataFrame:
    """(end, next): places where merged shard ranges [start, end) leave a gap or overlap."""
    # The furthest start before, in the order from the last range to the first, is the next one's.
    told = with_running(ranges.select("start", "end"), (), [F.desc("start")], {}, {"next": -F.col("start")})
    return told.select("end", (-F.col("next")).alias("next")).where("next IS NOT NULL AND next <> end")


def size_rule(n: Column) -> Column:
    """How many rows a corpus of n may use: 2000, 1000, or none (descriptive only)."""
    return F.when(n >= 2000, 2000).when(n >= 1000, 1000).otherwise(0)


def holdout(df: DataFrame, family: str, length: str, order: str, fit: int = 2) -> DataFrame:
    """FIT for the first rows of each (family, length), EVAL for the next one."""
    rank = F.row_number().over(Window.partitionBy(family, length).orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") <= fit + 1).withColumn("part", F.when(F.col("rank") <= fit, "FIT").otherwise("EVAL")).drop("rank")


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every combination of two small dimensions, numbered."""
    both = a.crossJoin(b)
    return both.withColumn("cell", F.row_number().over(Window.orderBy(*both.columns)) - 1)


def incomplete(expected: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, problem): cells of the grid without a row, and rows outside the grid."""
    a, b = expected.select(*keys).distinct(), rows.select(*keys).distinct()
    missing = a.join(b, [*keys], "left_anti").withColumn("problem", F.lit("MISSING"))
    return missing.unionByName(b.join(a, [*keys], "left_anti").withColumn("problem", F.lit("EXTRA")))
