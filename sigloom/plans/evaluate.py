"""Evaluation of outcome rows: rates, areas, fits, strata, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import with_rank, with_running
from .calibrate import with_interval


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """(keys, positives, negatives, auc): chance that a positive scores higher, ties half.

    Counts by distinct score come first; a running sum over these gives the negatives below.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    out = with_running(by, keys, [score], {"below": F.col("q")}).groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), wins.alias("wins"))
    n = F.col("positives") * F.col("negatives")
    return out.withColumn("auc", F.when(n > 0, F.col("wins") / n)).drop("wins")


def status(expected: Column, analysed: Column, failed: Column) -> Column:
    """How complete a cell is; failed rows stay in what is expected."""
    return (
        F.when(analysed == 0, "NO_ANALYSABLE_ROWS")
        .when(failed > 0, "INCOMPLETE_FAILURE_ROWS")
        .when(analysed < expected, "INCOMPLETE_MISSING_ROWS")
        .otherwise("COMPLETE")
    )


def cells(outcomes: DataFrame, failures: DataFrame, keys: Sequence[str], metrics: dict[str, Column], populations: dict[str, Column]) -> DataFrame:
    """(keys, population, expected, analysed, failed, metric..., status), all populations in one pass.

    Metrics average over analysed rows of the population; failures count as expected.
    """
    aggs = []
    for name, inside in populations.items():
        cell = [F.count_if(inside).alias("analysed"), *[F.avg(F.when(inside, m)).alias(k) for k, m in metrics.items()]]
        aggs.append(F.struct(F.lit(name).alias("population"), *cell))
    by = outcomes.groupBy(*keys).agg(F.array(*aggs).alias("cells"))
    each = by.select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")
    lost = failures.groupBy(*keys).agg(F.count("*").alias("failed"))
    both = each.join(lost, [*keys], "left").fillna(0, ["failed"]).withColumn("expected", F.col("analysed") + F.col("failed"))
    return both.withColumn("status", status(F.col("expected"), F.col("analysed"), F.col("failed")))


def coverage_efficiency(df: DataFrame, keys: Sequence[str], replaced: str, valid: str, edits: str, tokens: str) -> DataFrame:
    """(keys, n, efficiency, status): mean share of windows replaced for each share of tokens edited.

    A cell with a row without edits has no figure, and says so.
    """
    each = F.when((F.col(edits) > 0) & (F.col(valid) > 0) & (F.col(tokens) > 0), (F.col(replaced) / F.col(valid)) / (F.col(edits) / F.col(tokens)))
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(edits) == 0).alias("none"), F.avg(each).alias("mean"))
    bad = F.col("none") > 0
    return by.select(*keys, "n", F.when(~bad, F.col("mean")).alias("efficiency"), F.when(bad, "ZERO_TOKEN_EDIT_DENOMINATOR").otherwise("COMPLETE").alias("status"))


def reason_counts(df: DataFrame, reasons: str, known: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, reason, n) of an array of reasons, those that never occur with 0."""
    spark = df.sparkSession
    each = df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(r,) for r in known], "reason string")
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(all_)) if keys else all_  # a small catalogue
    return grid.join(each, [*keys, "reason"], "left").fillna(0, ["n"])


def complete(df: DataFrame, dimension: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """Every value of a dimension, those without rows filled."""
    return dimension.select(key).distinct().join(df, key, "left").fillna(fill)


def leave_one_out_fit(df: DataFrame, source: str, y: str, predictors: Sequence[str]) -> DataFrame:
    """(predictor, n, rmse, selected): lines fitted without each source, tested on it.

    Sums by source are enough: a source's own are subtracted from the total.  Without variance the slope
    is 0.  The predictor of the lowest error is selected (each one if they tie).
    """
    long = df.select(source, F.col(y).cast("double").alias("y"), F.explode(F.create_map(*[c for p in predictors for c in (F.lit(p), F.col(p).cast("double"))])).alias("predictor", "x"))
    x, v = F.col("x"), F.col("y")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(v), "sxx": F.sum(x * x), "sxy": F.sum(x * v)}
    by = long.groupBy("predictor", source).agg(*[e.alias(k) for k, e in sums.items()])
    all_ = by.groupBy("predictor").agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    rest = by.join(F.broadcast(all_), "predictor")  # a row a predictor
    n, sx, sy, sxx, sxy = (F.col(f"t_{k}") - F.col(k) for k in sums)
    spread = n * sxx - sx * sx
    slope = F.when(spread > 1e-12, (n * sxy - sx * sy) / spread).otherwise(0.0)
    fits = rest.where(n > 0).select("predictor", source, slope.alias("slope"), ((sy - slope * sx) / n).alias("level"))
    error = F.col("y") - F.col("level") - F.col("slope") * F.col("x")
    out = long.join(fits, ["predictor", source]).groupBy("predictor").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return out.withColumn("selected", F.col("rmse") <= F.min("rmse").over(Window.partitionBy()) + 1e-12)


def centred_correlation(df: DataFrame, source: str, x: str, y: str) -> DataFrame:
    """(n, correlation) of values less their source's means; 0 without variance."""
    means = df.groupBy(source).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    c = df.join(means, source).select((F.col(x) - F.col("mx")).alias("a"), (F.col(y) - F.col("my")).alias("b"))
    return c.agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb")).select(
        "n", F.when((F.col("aa") > 1e-18) & (F.col("bb") > 1e-18), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("correlation")
    )


#: Edges of edit doses; the last bin holds its upper edge.
DOSES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def dose_bin(dose: Column, edges: Sequence[float] = DOSES) -> Column:
    out = F.lit(len(edges) - 2)
    for k in range(len(edges) - 3, -1, -1):
        out = F.when(dose < edges[k + 1], k).otherwise(out)
    return F.when((dose >= edges[0]) & (dose <= edges[-1]), out)


def dose_response(df: DataFrame, dose: str, effect: str, edges: Sequence[float] = DOSES) -> DataFrame:
    """(bin, low, high, n, mean, falls): mean effect by dose, empty bins as well; falls marks a decrease.

    Bin -1 counts rows whose dose is null or outside the edges.
    """
    spark = df.sparkSession
    bins = spark.range(-1, len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    low, high = (F.get(F.array(*[F.lit(e) for e in x]), F.col("bin")) for x in (edges[:-1], edges[1:]))
    by = df.withColumn("bin", F.coalesce(dose_bin(F.col(dose), edges), F.lit(-1))).groupBy("bin").agg(F.count("*").alias("n"), F.avg(effect).alias("mean"))
    told = bins.join(by, "bin", "left").fillna(0, ["n"]).withColumns({"low": low, "high": high})
    within = F.when(F.col("bin") >= 0, F.col("mean"))
    last = F.last(within, ignorenulls=True).over(Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # a row a bin
    return told.withColumn("falls", F.coalesce(F.col("mean") < last, F.lit(False)))


def mean_of_means(df: DataFrame, outer: Sequence[str], source: str, value: str) -> DataFrame:
    """(outer, sources, mean, sd, iqr): sources weigh alike, whatever their number of rows."""
    by = df.groupBy(*outer, source).agg(F.avg(value).alias("m"))
    return by.groupBy(*outer).agg(F.count("*").alias("sources"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), (F.percentile("m", F.lit(0.75)) - F.percentile("m", F.lit(0.25))).alias("iqr"))


def paired(df: DataFrame, keys: Sequence[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, a, b, difference) of rows that match in all keys but the arm."""
    by = df.groupBy(*keys).pivot(arm, [a, b]).agg(F.avg(value))
    return by.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).withColumn("difference", F.col(f"`{a}`") - F.col(f"`{b}`"))


def difference_in_differences(df: DataFrame, source: str, label: str, arm: str, labels: tuple[str, str], arms: tuple[str, str], value: str) -> DataFrame:
    """(source, effect): (treated - baseline) of the first label, less that of the second."""
    avg = lambda x, y: F.avg(F.when((F.col(label) == x) & (F.col(arm) == y), F.col(value)))
    effect = (avg(labels[0], arms[0]) - avg(labels[0], arms[1])) - (avg(labels[1], arms[0]) - avg(labels[1], arms[1]))
    return df.groupBy(source).agg(effect.alias("effect")).where("effect IS NOT NULL")


def battery(df: DataFrame, strata: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """(stratum, group, n, metric...) for each of several stratifications, in one pass."""
    named = df.select(*strata, *[m.alias(k) for k, m in metrics.items()])
    grouped = named.groupingSets([[F.col(s)] for s in strata], *[F.col(s) for s in strata])
    marks = [F.grouping(s).alias(f"g_{s}") for s in strata]
    out = grouped.agg(F.count("*").alias("n"), *[F.avg(k).alias(f"mean_{k}") for k in metrics], *marks)
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in strata:
        mine = F.col(f"g_{s}") == 0
        which, value = F.when(mine, F.lit(s)).otherwise(which), F.when(mine, F.col(s).cast("string")).otherwise(value)
    return out.select(which.alias("stratum"), value.alias("value"), "n", *[f"mean_{k}" for k in metrics])


def depth_covariance(df: DataFrame, values: str) -> DataFrame:
    """(i, j, n, covariance) of the elements of an array column; 0 where there is one row."""
    each = df.select(F.col(values).alias("v"), F.posexplode(values).alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y"))
    return each.groupBy("i", "j").agg(F.count("*").alias("n"), F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("covariance"))


def transitions(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """(keys, n, both, lost, gained, neither): decisions before and after."""
    a, b = F.col(before), F.col(after)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"), F.count_if(~a & ~b).alias("neither"))


def control(df: DataFrame, keys: Sequence[str], before: str, after: str, score_before: str, score_after: str, excluded: Column) -> DataFrame:
    """(keys, n, excluded, false_to_true, rate, ci_low, ci_high, mean_shift, median_shift) of controls, which should not change.

    Excluded rows are counted, and take no further part.
    """
    out = F.coalesce(excluded, F.lit(False))
    inside = lambda c: F.when(~out, c)
    shift = inside(F.col(score_after) - F.col(score_before))
    by = df.groupBy(*keys).agg(
        F.count_if(~out).alias("n"), F.count_if(out).alias("excluded"), F.count_if(~out & ~F.col(before) & F.col(after)).alias("false_to_true"),
        F.avg(shift).alias("mean_shift"), F.median(shift).alias("median_shift"),
    )
    return with_interval(by.withColumn("rate", F.col("false_to_true") / F.col("n")), "false_to_true", "n")


def detectability(df: DataFrame, keys: Sequence[str], score: str, positive: str, rates: Sequence[float], floor: float = 0.8) -> DataFrame:
    """(keys, target, threshold, auc, n, detected, rate, ci_low, ci_high, status): thresholds from the negatives, held against the positives."""
    from .calibrate import baseline, thresholds

    cut = thresholds(df.where(~F.col(positive)), keys, score, rates).select(*keys, "target", "threshold")
    told = df.where(positive).join(cut, [*keys]).withColumn("positive", F.col(score) > F.col("threshold"))
    return baseline(told, keys, floor).join(cut, [*keys, "target"]).join(auc(df, keys, score, positive).select(*keys, "auc"), [*keys])


def quartiles(df: DataFrame, label: str, order: Sequence[str], name: str = "quartile") -> DataFrame:
    """The rows with min(3, 4 * index // count) by label: remainders lie differently than in ntile(4)."""
    ranked = with_rank(df, (label,), order, "index_")
    sizes = df.groupBy(F.col(label).alias("label_")).agg(F.count("*").alias("size_"))
    both = ranked.join(sizes, F.col(label).eqNullSafe(F.col("label_")))
    return both.withColumn(name, F.least(F.lit(3), F.floor(F.col("index_") * 4 / F.col("size_"))).cast("int")).drop("index_", "size_", "label_")


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, id_: str) -> DataFrame:
    """(keys, n, displaced, same_first, spearman) of two rankings, highest first, ties by id."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"ra": F.row_number().over(w.orderBy(F.desc(a), id_)), "rb": F.row_number().over(w.orderBy(F.desc(b), id_))})
    d = F.col("ra") - F.col("rb")
    by = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.abs(d)).alias("displaced"), F.bool_or((F.col("ra") == 1) & (F.col("rb") == 1)).alias("same_first"), F.sum(d * d).alias("dd"))
    n = F.col("n").cast("double")
    return by.withColumn("spearman", F.when(F.col("n") >= 2, 1 - 6 * F.col("dd") / (n * (n * n - 1)))).drop("dd")


def kth_largest(df: DataFrame, keys: Sequence[str], value: str, rate: float) -> DataFrame:
    """(keys, n, threshold): the (floor(rate * n) + 1)-th largest value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("same"))
    sizes = counts.groupBy(*keys).agg(F.sum("same").alias("n"))
    above = with_running(counts, keys, [F.desc(value)], {"above": F.col("same")}).join(sizes, [*keys])
    at = F.floor(F.lit(rate) * F.col("n"))
    return above.where((F.col("above") <= at) & (at < F.col("above") + F.col("same"))).select(*keys, "n", F.col(value).alias("threshold"))


def pareto(df: DataFrame, keys: Sequence[str], gain: str, cost: str) -> DataFrame:
    """Rows that no other row of the group beats: at least the gain for at most the cost, one of them strictly."""
    w = Window.partitionBy(*keys).orderBy(cost)
    cheaper = F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    by_cost = df.groupBy(*keys, cost).agg(F.max(gain).alias("top")).withColumn("before", cheaper)
    front = by_cost.where("before IS NULL OR top > before").drop("before")
    return df.join(front, [*keys, cost]).where(F.col(gain) == F.col("top")).drop("top")


def saturation(df: DataFrame, keys: Sequence[str], budget: str, gain: str, cost: str, least: float = 0.01) -> DataFrame:
    """(keys, saturated): two budgets in a row that gain less than ``least`` at a higher cost."""
    w = Window.partitionBy(*keys).orderBy(budget)
    flat = (F.col(gain) - F.lag(gain).over(w) < least) & (F.col(cost) > F.lag(cost).over(w))
    told = df.withColumn("flat", F.coalesce(flat, F.lit(False)))
    twice = told.withColumn("twice", F.col("flat") & F.coalesce(F.lag("flat").over(w), F.lit(False)))
    return twice.groupBy(*keys).agg(F.bool_or("twice").alias("saturated"))
