"""Reports on finished outcome rows: costs, replays, replications, audits."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .calibrate import with_interval

# How much of a text may visibly change, by tier.
TIERS = {
    "STRICT": {"word": 0.03, "char": 0.015, "ratio": (0.97, 1.03)},
    "RELAXED": {"word": 0.05, "char": 0.03, "ratio": None},
}


def visible_cost(tier: str, word_rate: Column, char_rate: Column, length_ratio: Column) -> Column:
    """What limits of a tier an edit exceeds; none means it is within."""
    limit = TIERS[tier]
    reasons = [F.when(word_rate > limit["word"], F.lit("WORDS")), F.when(char_rate > limit["char"], F.lit("CHARACTERS"))]
    if limit["ratio"]:
        reasons.append(F.when(~length_ratio.between(*limit["ratio"]), F.lit("LENGTH")))
    return F.array_compact(F.array(*reasons))


def replayed(text: Column, ops: Column) -> Column:
    """A text with operations (start, end, replacement) applied: sorted, not overlapping, code points of the input.

    For checking a stored trace against its stored output.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))
    step = lambda acc, op: F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, op["start"] - acc["at"]), op["replacement"]).alias("out"),
        op["end"].cast("int").alias("at"),
    )
    done = F.aggregate(ops, zero, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def broken_traces(df: DataFrame, text: str, ops: str, output: str) -> DataFrame:
    """Rows whose operations don't give the stored output."""
    return df.where(~replayed(F.col(text), F.col(ops)).eqNullSafe(F.col(output)))


def rule_usage(df: DataFrame, rules: str, arm: str) -> DataFrame:
    """(arm, rule, traces, uses) from an array of rule names in each trace."""
    numbered = df.withColumn("trace_", F.monotonically_increasing_id())  # below the generator: one number a trace
    each = numbered.select(arm, "trace_", F.explode(rules).alias("rule"))
    by = each.groupBy(arm, "rule", "trace_").agg(F.count("*").alias("n"))
    return by.groupBy(arm, "rule").agg(F.count("*").alias("traces"), F.sum("n").alias("uses"))


def differential(df: DataFrame, pair: str, tokenizer: str, distance: str, count_a: str, count_b: str) -> DataFrame:
    """(pair, tokenizers, least, most, changed_by_all, metrics_differ, directions_differ): one edit, several tokenizers."""
    d, way = F.col(distance), F.signum(F.col(count_b) - F.col(count_a))
    by = df.groupBy(pair).agg(
        F.count_distinct(tokenizer).alias("tokenizers"), F.min(d).alias("least"), F.max(d).alias("most"), F.min(way).alias("w0"), F.max(way).alias("w1")
    )
    return by.where("tokenizers >= 2").select(
        pair, "tokenizers", "least", "most", (F.col("least") > 0).alias("changed_by_all"), (F.col("least") != F.col("most")).alias("metrics_differ"), (F.col("w0") != F.col("w1")).alias("directions_differ")
    )


@arrow_udf(T.BooleanType())
def _normal(text: pa.Array) -> pa.Array:
    return pa.array([t is None or unicodedata.is_normalized("NFC", t) for t in text.to_pylist()], pa.bool_())


def representation_reasons(before: Column, after: Column) -> Column:
    """Why a pair of texts can't tell how tokenizers differ: not in composed form, or other invisible or combining characters."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("([\\p{Cf}\\p{Co}\\p{Mn}\\p{Me}])"), 1))
    return F.array_compact(F.array(
        F.when(~(_normal(before) & _normal(after)), F.lit("NOT_NFC")),
        F.when(marks(before) != marks(after), F.lit("MARKS_CHANGED")),
    ))


def replication(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, first, second, delta, problem): cells of two runs side by side."""
    one = a.select(*keys, F.col(value).alias("first"), F.lit(True).alias("in_a"))
    two = b.select(*keys, F.col(value).alias("second"), F.lit(True).alias("in_b"))
    both = one.join(two, [*keys], "full_outer")
    problem = F.when(F.col("in_b").isNull(), "ONLY_FIRST").when(F.col("in_a").isNull(), "ONLY_SECOND")
    return both.select(*keys, "first", "second", (F.col("second") - F.col("first")).alias("delta"), problem.alias("problem"))


def transfer(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: means, medians, agreement of signs and correlation of two effects a row."""
    corr = F.corr(a, b)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(F.signum(a) == F.signum(b)).alias("agree"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.median(a).alias("median_a"), F.median(b).alias("median_b"), F.when(~F.isnan(corr), corr).alias("correlation"),
    )


def transfer_spread(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: median absolute deviations of both effects, and of their difference, from their medians."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(b) - F.col(a)).alias("d"))
    middle = both.agg(*[F.median(c).alias(f"m{c}") for c in "abd"])
    apart = both.crossJoin(F.broadcast(middle))  # one row
    return apart.agg(*[F.median(F.abs(F.col(c) - F.col(f"m{c}"))).alias(name) for c, name in zip("abd", ("mad_a", "mad_b", "mad_difference"), strict=True)])


def scarcity(rows: DataFrame, source: str, reachable: Sequence[tuple[str, str]], ceiling: str | None = None) -> DataFrame:
    """One row (sources, repeated, decision): the first named budget that some source can't reach, else whether costs forbid it.

    ``reachable`` has (name, boolean column), the smallest budget first; a source may stand only once.
    """
    told = rows.agg(
        F.count("*").alias("sources"), (F.count("*") - F.count_distinct(source)).alias("repeated"),
        *[F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(f"all_{k}") for k, (_, c) in enumerate(reachable)],
        F.bool_or(F.coalesce(F.col(ceiling), F.lit(False)) if ceiling else F.lit(False)).alias("dear"),
    )
    decision = F.when(F.col("dear"), "COST_CEILING").otherwise("NO_SCARCITY")
    for k in range(len(reachable) - 1, -1, -1):
        decision = F.when(~F.col(f"all_{k}"), f"SCARCE_{reachable[k][0]}").otherwise(decision)
    return told.select("sources", "repeated", F.when(F.col("sources") == 0, "NO_ROWS").when(F.col("repeated") > 0, "REPEATED_SOURCES").otherwise(decision).alias("decision"))


def matched_cost(arm: DataFrame, random_rows: DataFrame, keys: Sequence[str], value: str, least: int = 8) -> DataFrame:
    """(keys, value, controls, control_mean, advantage): a row against at least so many controls of equal keys."""
    by = random_rows.groupBy(*keys).agg(F.count("*").alias("controls"), F.avg(value).alias("control_mean")).where(F.col("controls") >= least)
    return arm.select(*keys, value).join(by, [*keys]).withColumn("advantage", F.col(value) - F.col("control_mean"))


def post_selection(df: DataFrame, label: str, gain: str, drop: str) -> DataFrame:
    """(label, pairs, gained, gained_and_dropped, mean_drop, correlation) over matched pairs."""
    up = F.col(gain) > 0
    corr = F.corr(gain, drop)
    return df.groupBy(label).agg(
        F.count("*").alias("pairs"), F.count_if(up).alias("gained"), F.count_if(up & (F.col(drop) > 0)).alias("gained_and_dropped"),
        F.avg(F.when(up, F.col(drop))).alias("mean_drop"), F.when(~F.isnan(corr), corr).alias("correlation"),
    )


def favourable(df: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """(keys, n, good, rate, ci_low, ci_high): shares of favourable verdicts with exact intervals."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(verdict).alias("good"))
    return with_interval(by.withColumn("rate", F.col("good") / F.col("n")), "good", "n")


def stress_matrix(rules: DataFrame, kinds: DataFrame, contexts: DataFrame, rule: str = "rule", kind: str = "kind") -> DataFrame:
    """(rule, kind, safe, overlap, violations) for every combination of two small dimensions, zeros included."""
    by = contexts.groupBy(rule, kind).agg(F.count_if(~F.col("overlaps")).alias("safe"), F.count_if("overlaps").alias("overlap"), F.count_if("violated").alias("violations"))
    grid = rules.select(rule).distinct().crossJoin(kinds.select(kind).distinct())  # both are catalogues
    return grid.join(by, [rule, kind], "left").fillna(0)


def readiness(rules: DataFrame, audits: DataFrame, fixtures: DataFrame, rule: str = "rule", least: int = 5) -> DataFrame:
    """(rule, fixtures, audit, status): READY needs enough fixtures and a passed audit."""
    n = fixtures.groupBy(rule).agg(F.count("*").alias("fixtures"))
    both = rules.select(rule).join(n, rule, "left").join(audits.select(rule, F.col("status").alias("audit")), rule, "left").fillna(0, ["fixtures"])
    status = F.when(F.col("fixtures") < least, "TOO_FEW_FIXTURES").when(F.col("audit").isNull(), "NOT_AUDITED").when(F.col("audit") != "READY", F.col("audit")).otherwise("READY")
    return both.withColumn("status", status)


def mechanism(diffs: DataFrame, edits: DataFrame, n: int, keep: Sequence[str] = ("pair",)) -> DataFrame:
    """(keep, predicted, changed, outside): whether one substitution changes just the windows that hold it.

    ``edits`` has keep and pos, the token replaced; predicted windows are [pos - n + 1, pos].
    """
    both = diffs.join(edits.select(*keep, F.col("pos").alias("edit")), [*keep])
    inside = F.col("pos").between(F.col("edit") - n + 1, F.col("edit"))
    off = F.col("state") != "PRESERVED"
    return both.groupBy(*keep).agg(F.count_if(inside).alias("predicted"), F.count_if(off).alias("changed"), F.count_if(off != inside).alias("outside"))


def suffix_check(diffs: DataFrame, edits: DataFrame, shift: int, keep: Sequence[str] = ("pair",)) -> DataFrame:
    """(keep, behind, preserved, shifted): whether windows that begin at or behind an insertion or deletion all stay, so far further on."""
    both = diffs.join(edits.select(*keep, F.col("pos").alias("edit")), [*keep]).where(F.col("pos") >= F.col("edit"))
    stays = F.col("state") == "PRESERVED"
    return both.groupBy(*keep).agg(F.count("*").alias("behind"), F.count_if(stays).alias("preserved"), F.count_if(stays & (F.col("to") == F.col("pos") + shift)).alias("shifted"))


def paired_gate(df: DataFrame, source: str, budget: str, gain: str, ok: str, specific: str) -> DataFrame:
    """One row: INCOMPLETE, K2 (a failed row, a loss, or a median gain of 0 or less), K1 (no specific win) or PASS."""
    by = df.groupBy(budget).agg(
        F.count("*").alias("rows"), F.count_distinct(source).alias("sources"), F.count_if(~F.coalesce(F.col(ok), F.lit(False)) | F.col(gain).isNull() | (F.col(gain) < 0)).alias("bad"),
        F.median(gain).alias("median"), F.count_if(specific).alias("wins"),
    )
    all_ = df.agg(F.count_distinct(source).alias("all"))
    told = by.join(F.broadcast(all_)).agg(  # one row
        F.count("*").alias("budgets"), F.bool_and((F.col("rows") == F.col("all")) & (F.col("sources") == F.col("all"))).alias("complete"),
        F.sum("bad").alias("bad"), F.min(F.coalesce("median", F.lit(0.0))).alias("least"), F.min("wins").alias("wins"),
    )
    return told.select(
        F.when((F.col("budgets") == 0) | ~F.col("complete"), "INCOMPLETE").when((F.col("bad") > 0) | (F.col("least") <= 0), "K2").when(F.col("wins") == 0, "K1").otherwise("PASS").alias("verdict")
    )


#: Development experiments and what each builds on.
STEPS = {
    "windows": (), "scores": ("windows",), "calibration": ("scores",), "detectability": ("calibration",), "pairs": ("windows",), "survival": ("pairs",),
    "predictors": ("survival", "scores"), "dose": ("survival", "scores"), "spacing": ("dose",), "batteries": ("detectability", "survival"), "controls": ("calibration", "pairs"),
}


def registry(spark: SparkSession, steps: dict[str, tuple[str, ...]] = STEPS) -> DataFrame:
    """(step, needs, level): a static table of steps in order of dependency; cycles and unknown needs are refused."""
    level: dict[str, int] = {}
    while len(level) < len(steps):
        ready = [s for s, needs in steps.items() if s not in level and all(n in level for n in needs)]
        if not ready:
            raise ValueError(f"steps that can't be ordered: {sorted(set(steps) - set(level))}")
        now = 1 + max(level.values(), default=-1)
        level |= dict.fromkeys(ready, now)
    return spark.createDataFrame([(s, list(needs), level[s]) for s, needs in steps.items()], "step string, needs array<string>, level int")
