"""Calibration of scores to a fixed false-positive rate, and its application.

Scores are grouped by any columns (detector, length, regime); every step is a grouped aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binomial import interval
from ..operators.ordered import with_running

#: Scale factors that make MAD and interquartile range estimate a normal deviation.
MAD_SCALE, IQR_SCALE = 1.482602218505602, 1.3489795003921634
#: Target rates this small need that many negatives.
SMALL_RATE, SMALL_RATE_ROWS = 0.001, 10_000


def quantile_disc(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the inverse-CDF quantile, an observed value; the least one for q = 0."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(name))


def quantile_linear(value: Column | str, q: float) -> Column:
    """The linearly interpolated quantile (type 7)."""
    return F.percentile(value, F.lit(q))


def robust(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """(keys, n, centre, scale, status): median, and scaled MAD or else interquartile range."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {score})")
    first = df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(score).alias("centre"), (q(0.75) - q(0.25)).alias("iqr"))
    joined = df.join(first, [*keys]) if keys else df.crossJoin(F.broadcast(first))  # without keys: one row
    second = joined.groupBy(*keys, "n", "centre", "iqr").agg(F.median(F.abs(F.col(score) - F.col("centre"))).alias("mad"))
    scale = F.coalesce(F.nullif(F.col("mad") * MAD_SCALE, F.lit(0.0)), F.nullif(F.col("iqr") / IQR_SCALE, F.lit(0.0)))
    return second.select(*keys, "n", "centre", scale.alias("scale"), F.when(scale.isNull(), "NO_SPREAD").otherwise("OK").alias("status"))


def thresholds(negatives: DataFrame, keys: Sequence[str], score: str, rates: Sequence[float], strict: bool = True) -> DataFrame:
    """(keys, target, n, threshold, false_positives, achieved): least observed score that keeps the rate.

    A negative is positive above the threshold (``strict``) or from it on.  Scores are counted once per
    distinct value, so the ordered pass runs over distinct scores.
    """
    by = negatives.groupBy(*keys, score).agg(F.count("*").alias("same"))
    sizes = by.groupBy(*keys).agg(F.sum("same").alias("n"))
    above = with_running(by, keys, [F.desc(score)], {"over": F.col("same")})
    told = above.join(sizes, [*keys]) if keys else above.crossJoin(F.broadcast(sizes))  # without keys: one row
    told = told if strict else told.withColumn("over", F.col("over") + F.col("same"))
    each = told.withColumn("target", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).where(F.col("over") <= F.col("target") * F.col("n"))
    best = each.groupBy(*keys, "target", "n").agg(F.min(F.struct(F.col(score).alias("threshold"), F.col("over").alias("false_positives"))).alias("b"))
    return best.select(*keys, "target", "n", "b.*").withColumn("achieved", F.col("false_positives") / F.col("n"))


def resolution(n: Column, target: Column) -> Column:
    """Whether n negatives can tell so small a rate."""
    least = F.when(target <= SMALL_RATE, F.greatest(F.ceil(1 / target), F.lit(SMALL_RATE_ROWS))).otherwise(F.ceil(1 / target))
    return F.when(n >= least, "OK").otherwise("TOO_FEW_NEGATIVES")


def with_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    """The table with the exact 95 % interval of k of n; each distinct (k, n) is worked out once."""
    once = df.select(k, n).distinct().withColumn("ci", interval(k, n)).select(k, n, F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"))
    return df.join(once, [k, n], "left")


def calibrate(negatives: DataFrame, keys: Sequence[str], score: str, rates: Sequence[float], strict: bool = True) -> DataFrame:
    """Centre, scale and, for each target rate, threshold, achieved rate, interval and resolution."""
    cut = with_interval(thresholds(negatives, keys, score, rates, strict), "false_positives", "n")
    spread = robust(negatives, keys, score).drop("n")
    both = cut.join(spread, [*keys]) if keys else cut.crossJoin(F.broadcast(spread))  # without keys: one row
    return both.withColumn("resolution", resolution(F.col("n"), F.col("target")))


def decide(scores: DataFrame, calibration: DataFrame, keys: Sequence[str], score: str, strict: bool = True) -> DataFrame:
    """Every score against every target: margin in units of scale, and the decision."""
    cut = calibration.select(*keys, "target", "threshold", "scale")
    both = scores.join(cut, [*keys]) if keys else scores.crossJoin(F.broadcast(cut))  # without keys: a row a target
    over = F.col(score) > F.col("threshold") if strict else F.col(score) >= F.col("threshold")
    return both.withColumns({"positive": over, "margin": (F.col(score) - F.col("threshold")) / F.col("scale")})


def baseline(decisions: DataFrame, keys: Sequence[str], floor: float = 0.8) -> DataFrame:
    """(keys, target, n, detected, rate, ci_low, ci_high, status) over positives."""
    by = decisions.groupBy(*keys, "target").agg(F.count("*").alias("n"), F.count_if("positive").alias("detected"))
    told = with_interval(by.withColumn("rate", F.col("detected") / F.col("n")), "detected", "n")
    return told.withColumn("status", F.when(F.col("rate") >= floor, "PASS").otherwise("FAIL"))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, low, q25, q50, q75, high, mean, cv) with interpolated quartiles."""
    q = lambda p: quantile_linear(value, p)
    mean = F.avg(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"),
        F.max(value).alias("high"), mean.alias("mean"), F.when(mean != 0, F.stddev_pop(value) / mean).otherwise(0.0).alias("cv"),
    )


def iqr_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Overlap of two ranges over the narrower one; where that has no width, 1 if it lies inside, else 0."""
    shared = F.least(high_a, high_b) - F.greatest(low_a, low_b)
    narrow = F.least(high_a - low_a, high_b - low_b)
    return F.when(narrow > 0, F.greatest(F.lit(0.0), shared) / narrow).otherwise((shared >= 0).cast("double"))


def minimal_bins(counts: Sequence[tuple[float, int]], most_cv: float = 0.05) -> list[float]:
    """Upper bounds of the fewest runs of values whose coefficient of variation stays small.

    ``counts`` are (value, rows), one for each distinct value: a small table.  Of equal numbers of runs
    the one with the smallest bounds wins.
    """
    counts = sorted(counts)
    best: list[tuple[int, list[float]] | None] = [(0, [])]
    for end in range(1, len(counts) + 1):
        found = None
        n = total = squares = 0.0
        for start in range(end - 1, -1, -1):
            value, rows = counts[start]
            n, total, squares = n + rows, total + rows * value, squares + rows * value * value
            mean = total / n
            cv = math.sqrt(max(0.0, squares / n - mean * mean)) / mean if mean else 0.0
            if cv <= most_cv and best[start] is not None:
                option = (best[start][0] + 1, best[start][1] + [counts[end - 1][0]])
                found = option if found is None or option < found else found
        best.append(found)
    return best[-1][1] if best[-1] else []


def regime_decision(df: DataFrame, group: str, tokens: str, eligible: str, most_cv: float = 0.05, most_overlap: float = 0.10) -> DataFrame:
    """One row (groups, worst_cv, worst_overlap, mode): whether nominal lengths tell groups apart, or bins of eligible windows must.

    Nominal if tokens and eligible windows of each group scatter little, and the quartile ranges of
    eligible windows of any two groups hardly overlap.
    """
    by = distribution(df, [group], eligible).select(group, "q25", "q75", "cv").join(distribution(df, [group], tokens).select(group, F.col("cv").alias("token_cv")), group)
    other = by.select(F.col(group).alias("g_"), F.col("q25").alias("a"), F.col("q75").alias("b"))
    cross = by.join(other, F.col(group) < F.col("g_"), "left")  # groups are few
    overlap = F.least(F.lit(1.0), iqr_overlap(F.col("q25"), F.col("q75"), F.col("a"), F.col("b")))
    told = cross.agg(
        F.count_distinct(group).alias("groups"), F.max(F.greatest("cv", "token_cv")).alias("worst_cv"), F.coalesce(F.max(F.when(F.col("g_").isNotNull(), overlap)), F.lit(0.0)).alias("worst_overlap")
    )
    nominal = (F.col("worst_cv") <= most_cv) & (F.col("worst_overlap") <= most_overlap)
    return told.withColumn("mode", F.when(nominal, "NOMINAL_TARGET_LENGTH").otherwise("ELIGIBLE_OBSERVATION_BINS"))


def frozen_opportunity(counts: DataFrame, keys: Sequence[str], columns: Sequence[str], valid: str, least: int = 1000, most_cv: float = 0.05) -> DataFrame:
    """(keys, counted, n, low, q25, q50, q75, high, mean, cv, length_passes, resolution_passes) of several counts a document."""
    long = counts.select(*keys, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("counted", "x"))
    told = distribution(long, [*keys, "counted"], "x")
    passes = F.max(F.when(F.col("counted") == valid, F.col("cv") <= most_cv)).over(Window.partitionBy(*keys)) if keys else F.max(F.when(F.col("counted") == valid, F.col("cv") <= most_cv)).over(Window.partitionBy(F.lit(1)))
    return told.withColumns({"length_passes": passes, "resolution_passes": F.col("n") >= least})


def registry_problems(registry: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem): regimes that a threshold registry lacks, has besides, or has twice."""
    have = registry.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(have, [*keys], "full_outer")
    problem = F.when(F.col("n").isNull(), "MISSING").when(F.col("wanted").isNull(), "UNEXPECTED").when(F.col("n") > 1, "REPEATED")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def regime(value: Column, bounds: Sequence[float]) -> Column:
    """Number of the first bin whose upper bound isn't below the value."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def audit(registry: DataFrame, rows: DataFrame, keys: Sequence[str], score: str, least: int = 1000) -> DataFrame:
    """Frozen thresholds on fresh negatives: rate from the threshold on, exact interval, enough rows."""
    both = rows.join(registry.select(*keys, "target", "threshold"), [*keys])
    by = both.groupBy(*keys, "target", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col(score) >= F.col("threshold")).alias("false_positives"))
    told = with_interval(by.withColumn("rate", F.col("false_positives") / F.col("n")), "false_positives", "n")
    return told.withColumn("status", F.when(F.col("n") >= least, "OK").otherwise("TOO_FEW_ROWS"))
