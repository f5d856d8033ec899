"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Raking scales the cells' weights to each
marginal's targets in turn until all three agree.  A document's sampling probability is its cell's
calibrated weight over the cell's tokens, scaled to the wanted number of tokens.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spare

AXES = ("source", "lang", "topic")
#: Targets, unless given: shares of tokens to these powers, so that small groups gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens to draw.
SHARE = 0.6
ROUNDS, TOLERANCE = 200, 1e-9
#: Up to so many cells the driver rakes their sums itself; more are raked where they lie, by the same steps.
DRIVER_CELLS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by layout and length, where a table has no topic of its own."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(text.contains(" | "), "table").when(size < 400, "note").when(size < 4000, "article").otherwise("essay")


def tempered(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """(axis, target): shares of the axis's groups, tokens to a power."""
    by = cells.groupBy(axis).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = by.select(axis, F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("raised"))
    whole = raised.agg(F.sum("raised").alias("whole"))
    return raised.join(F.broadcast(whole)).select(axis, (F.col("raised") / F.col("whole")).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with ``weight``: shares that meet every target as far as the cells allow.

    A group without cells can't get its share; a cell whose group has no target gets nothing.  Cells
    and targets stay distributed; a round pre-aggregates by group and joins the factors back.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"]
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    now = scratch.keep(cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total))))
    for _ in range(rounds):
        step = now
        for axis, target in targets.items():
            got = step.groupBy(axis).agg(F.sum("weight").alias("got"))
            factor = got.join(target, axis).select(axis, F.when(F.col("got") > 0, F.col("target") / F.col("got")).otherwise(0.0).alias("factor"))
            step = step.join(factor, axis).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        moved = now.select(*targets, F.col("weight").alias("was"))
        after = scratch.keep(step.join(moved, list(targets)).withColumn("moved", F.abs(F.col("weight") - F.col("was"))).drop("was"))
        most = after.agg(F.max("moved").alias("m")).first()["m"]
        scratch.drop(now)
        now = after.drop("moved")
        now._scratch = after._scratch
        if most is None or most < tolerance:
            break
    off = 0.0
    for axis, target in targets.items():
        got = now.groupBy(axis).agg(F.sum("weight").alias("got")).join(target, axis, "full_outer")
        off = max(off, got.agg(F.max(F.abs(F.coalesce("got", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))).alias("m")).first()["m"] or 0.0)
    _told(off)
    return now


def _told(off: float) -> None:
    if off > 1e-6:
        warnings.warn(f"the cells can't meet the targets: some group's share is off by {off:.2g}", stacklevel=3)


def probabilities(cells: DataFrame, wanted: float) -> DataFrame:
    """The cells with ``p``: min(1, scale * weight / tokens), the scale such that ``wanted`` tokens are drawn.

    Cells that reach 1 give all they have; the others are scaled up for what these lack.
    """
    ratio = F.col("weight") / F.col("tokens")
    scale = wanted
    while True:
        full = F.col("tokens") <= F.col("weight") * F.lit(scale)
        got = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not got["rest"]:
            break
        better = max(scale, (wanted - got["full"]) / got["rest"])
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    return cells.withColumn("p", F.least(F.lit(1.0), ratio * F.lit(scale)))


def solve(rows: list, targets: dict[str, dict[str, float]], powers: dict[str, float], share: float) -> list[tuple]:
    """(source, lang, topic, p) for a small table of cells: ``rake`` and ``probabilities`` on arrays."""
    rows = [r for r in rows if r["tokens"] > 0]
    tokens = np.array([r["tokens"] for r in rows], float)
    wanted = share * tokens.sum()
    weight = tokens / tokens.sum() if len(rows) else tokens
    axes = []
    for axis in AXES:
        names, code = np.unique(np.array([r[axis] for r in rows], object), return_inverse=True)
        given = targets.get(axis)
        if given:
            goal = np.array([given.get(n, 0.0) for n in names]) / sum(given.values())
        else:
            raised = np.bincount(code, tokens, len(names)) ** powers[axis]
            goal = raised / raised.sum() if len(names) else raised
        axes.append((code, goal))
    for _ in range(ROUNDS if len(rows) else 0):
        was = weight
        for code, goal in axes:
            got = np.bincount(code, weight, len(goal))
            weight = weight * np.divide(goal, got, out=np.zeros_like(goal), where=got > 0)[code]
        if np.abs(weight - was).max() < TOLERANCE:
            break
    _told(max((float(np.abs(np.bincount(code, weight, len(goal)) - goal).max()) for code, goal in axes if len(rows)), default=0.0))
    scale = wanted
    while True:
        full = tokens <= weight * scale
        rest = weight[~full].sum()
        better = max(scale, (wanted - tokens[full].sum()) / rest) if rest else scale
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    p = np.minimum(1.0, weight / tokens * scale)
    return [(*(r[a] for a in AXES), float(x)) for r, x in zip(rows, p, strict=True) if x > 0]


def draw(doc_id: str, salt: str) -> Column:
    """A number in [0, 1) fixed by the id: 32 bits of a hash of its text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(doc_id).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(
    df: DataFrame,
    spark: SparkSession,
    doc_id: str = "doc_id",
    text: str = "text",
    source: Column | None = None,
    lang: Column | None = None,
    topics: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    powers: dict[str, float] = POWERS,
    share: float = SHARE,
    salt: str = "mix",
    scratch: Scratch | None = None,
    into: tuple[str, str, str] = ("▁tokens", "▁p", "▁drawn"),
) -> DataFrame:
    """The table with words, sampling probability and its outcome, named by ``into``; columns of these names are replaced.

    ``targets`` gives shares by axis and group (scaled to sum 1); axes without any get tempered shares.
    Groups that are null are a group of their own, named ''.  A document without words has probability
    0.  The draw depends on the id alone (null: as the text ''), so repeated rows share their fate.
    An empty table gives no rows.  Targets that the cells can't meet are met as far as they can be, with
    a warning.
    """
    scratch = scratch or Scratch(spark)
    tokens, p_, drawn_ = into
    axis = {a: spare(f"▁{a}", [*df.columns, *into]) for a in AXES}
    group = {
        "source": F.col("source") if source is None else source,
        "lang": F.col("lang") if lang is None else lang,
        "topic": topic(F.col(text)) if topics is None else topics,
    }
    marked = df.withColumns({axis[a]: F.coalesce(c.cast("string"), F.lit("")) for a, c in group.items()} | {tokens: n_words(F.col(text))})
    cells = marked.groupBy(*(F.col(axis[a]).alias(a) for a in AXES)).agg(F.sum(tokens).alias("tokens"))
    cells = scratch.keep(cells)
    few = cells.limit(DRIVER_CELLS + 1).collect()
    if len(few) <= DRIVER_CELLS:
        calibrated = spark.createDataFrame(solve(few, targets or {}, powers, share), ", ".join(f"{a} string" for a in AXES) + ", p double")
    else:
        calibrated = scratch.keep(_solve_distributed(cells, spark, targets or {}, powers, share, scratch))
    out = marked.drop(p_).join(calibrated.select(*(F.col(a).alias(axis[a]) for a in AXES), F.col("p").alias(p_)), list(axis.values()), "left")
    p = F.when(F.col(tokens) > 0, F.coalesce(p_, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn(p_, p)
    return out.withColumn(drawn_, F.coalesce(draw(doc_id, salt), draw_of_null(salt)) < F.col(p_)).drop(*axis.values())


def _solve_distributed(cells: DataFrame, spark: SparkSession, targets: dict[str, dict[str, float]], powers: dict[str, float], share: float, scratch: Scratch) -> DataFrame:
    goals = {}
    for axis in AXES:
        if axis in targets:
            whole = sum(targets[axis].values())
            goals[axis] = spark.createDataFrame([(k, v / whole) for k, v in targets[axis].items()], f"{axis} string, target double")
        else:
            goals[axis] = scratch.keep(tempered(cells, axis, powers[axis]))
    raked = rake(cells, goals, scratch)
    wanted = share * (cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    return probabilities(raked.where("weight > 0"), wanted).select(*AXES, "p")


def draw_of_null(salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.lit(salt)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
