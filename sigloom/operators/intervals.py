"""Half-open integer intervals: construction, merging, overlap, coverage, scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the bins that turn an overlap join into an equi-join.
BIN = 4096


def of_tokens(tokens: DataFrame, n: int, windows: str = "windows", pos: str = "pos") -> DataFrame:
    """The windows of n tokens that hold each token: [max(0, i - n + 1), min(i + 1, windows))."""
    return tokens.withColumns({"start": F.greatest(F.lit(0), F.col(pos) - n + 1), "end": F.least(F.col(pos) + 1, F.col(windows))})


def merged(df: DataFrame, keys: tuple[str, ...], touching: bool = True, kinds: str | None = None) -> DataFrame:
    """(keys, start, end[, kinds]): unions of intervals; empty ones are dropped.

    ``touching`` merges intervals that only meet; without it they stay apart.  ``kinds`` gathers that
    column's distinct values, sorted.
    """
    some = df.where("end > start")
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") > F.col("reach") if touching else F.col("start") >= F.col("reach")
    marked = some.withColumn("reach", before).withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int"))
    island = F.sum("fresh").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    by = marked.withColumn("island", island).groupBy(*keys, "island")
    more = [F.sort_array(F.collect_set(kinds)).alias("kinds")] if kinds else []
    return by.agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("island")


def union_size(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, covered): how many integers the intervals cover."""
    return merged(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def overlaps(a: DataFrame, b: DataFrame, keys: tuple[str, ...], width: int = BIN) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap; b's columns get the prefix ``b_``.

    Both sides are cut into bins, so the join is on keys and bin; a pair is told in the bin where the
    overlap starts, that is once.  Neither side is broadcast: the planner's sizes don't count what a
    generator multiplies, so they are far too small for exploded tables.
    """
    bins = lambda df: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    left = a.where("end > start")
    left = left.withColumn("bin_", bins(left))
    right = b.where("end > start")
    right = right.withColumn("bin_", bins(right))
    right = right.select(*keys, "bin_", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    meet = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    once = F.col("bin_") == F.floor(F.greatest("start", "b_start") / width)
    return left.join(right.hint("merge"), [*keys, "bin_"]).where(meet & once).drop("bin_")


def conflicts(df: DataFrame, keys: tuple[str, ...], id_: str = "id") -> DataFrame:
    """Every pair of overlapping candidates once, smaller id first."""
    return overlaps(df, df, keys).where(F.col(id_) < F.col(f"b_{id_}"))


def covered_windows(spans: DataFrame, tokens: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, id, start, end): merged windows that the tokens of each character span touch.

    ``spans`` has keys, id, start, end in characters; ``tokens`` keys, pos, start, end and windows.
    """
    hit = overlaps(spans, tokens, keys).select(*keys, "id", F.col("b_pos").alias("pos"), F.col("b_windows").alias("windows"))
    return merged(of_tokens(hit, n), (*keys, "id"))


def eligible_coverage(coverage: DataFrame, eligible: DataFrame, keys: tuple[str, ...], id_: str = "id") -> DataFrame:
    """Coverage without ineligible windows, merged again.  ``eligible`` has keys and pos; like in ``overlaps``, it is not broadcast."""
    each = coverage.select(*keys, id_, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    kept = each.join(eligible.select(*keys, "pos").distinct().hint("merge"), [*keys, "pos"], "left_semi")
    return merged(kept.select(*keys, id_, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), (*keys, id_))


def independent_count(df: DataFrame, keys: tuple[str, ...], least: int = 4) -> DataFrame:
    """(keys, candidates, independent, status): the most candidates that don't overlap, earliest end first."""
    row = F.struct(F.col("end").cast("long").alias("end"), F.col("start").cast("long").alias("start"))
    by = df.groupBy(*keys).agg(F.count("*").alias("candidates"), F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("at"))
    take = F.aggregate("rows", zero, lambda acc, r: F.when(r["start"] >= acc["at"], F.struct((acc["n"] + 1).alias("n"), r["end"].alias("at"))).otherwise(acc))
    out = by.select(*keys, "candidates", take["n"].alias("independent"))
    return out.withColumn("status", F.when(F.col("independent") >= least, "READY").otherwise("SCARCE"))
