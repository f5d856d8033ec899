"""Document scores from window bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_weights(depth: int) -> list[float]:
    """Weights falling from 10 to 1 over depth, scaled to sum to the depth."""
    raw = [10.0] if depth == 1 else [10 - 9 * k / (depth - 1) for k in range(depth)]
    out = [w * depth / math.fsum(raw) for w in raw]
    out[0] += depth - math.fsum(out)
    return out


def mean_scores(windows: DataFrame, depth: int, weights: list[float] | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, valid, score, weighted_score, failure): mean bit over valid windows, plain and weighted.

    Sums of bits are integers by depth; division comes last.  A document without valid windows fails
    with a reason and has no score.
    """
    weights = weights or linear_weights(depth)
    sums = [F.sum(F.when(F.col("valid"), F.col("g")[d])).alias(f"s{d}") for d in range(depth)]
    by = windows.groupBy(doc).agg(F.count_if("valid").alias("valid"), *sums)
    n = F.col("valid") * F.lit(depth)
    plain = sum((F.col(f"s{d}") for d in range(1, depth)), F.col("s0"))
    weighted = sum((F.col(f"s{d}") * F.lit(weights[d]) for d in range(1, depth)), F.col("s0") * F.lit(weights[0]))
    some = F.col("valid") > 0
    return by.select(
        doc,
        "valid",
        F.when(some, plain / n).alias("score"),
        F.when(some, F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted / n))).alias("weighted_score"),
        F.when(~some, F.lit("ZERO_VALID_WINDOWS")).alias("failure"),
    )


def depth_means(windows: DataFrame, depth: int) -> DataFrame:
    """(depth, valid, mean_bit) over all valid windows."""
    each = windows.where("valid").select(F.posexplode("g").alias("depth", "bit"))
    return each.groupBy("depth").agg(F.count("*").alias("valid"), F.avg("bit").alias("mean_bit"))


def _sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def checkpoint_problems(checkpoint: dict) -> list[str]:
    """What is wrong with a stored model {base_rate, beta, delta, depth}: none if it can be used."""
    out = []
    fields = {"base_rate", "beta", "delta", "depth"}
    if set(checkpoint) != fields:
        return [f"FIELDS:{','.join(sorted(set(checkpoint) ^ fields))}"]
    depth, beta, delta = checkpoint["depth"], checkpoint["beta"], checkpoint["delta"]
    if not isinstance(depth, int) or isinstance(depth, bool) or depth < 1:
        return ["DEPTH"]
    if not 0 < checkpoint["base_rate"] < 1:
        out.append("BASE_RATE")
    if len(beta) != depth or not all(math.isfinite(x) for x in beta):
        out.append("BETA")
    if len(delta) != depth or any(len(row) != depth for row in delta):
        out.append("DELTA_SHAPE")
    elif any(x for i, row in enumerate(delta) for x in row[i:]) or not all(math.isfinite(x) for row in delta for x in row):
        out.append("DELTA_NOT_LOWER")
    return out


def load_checkpoint(path: str) -> dict:
    """A stored model, refused if anything is wrong with it."""
    import json

    with open(path) as f:
        out = json.load(f)
    if problems := checkpoint_problems(out):
        raise ValueError(f"model can't be used: {problems}")
    return out


def training_readiness(samples: DataFrame, role: str, label: str, source: str, least: int = 1000) -> DataFrame:
    """(role, positives, negatives, sources, shared_sources, status): whether roles hold enough of both labels and share no source."""
    by = samples.groupBy(role).agg(F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives"), F.count_distinct(source).alias("sources"))
    roles = samples.groupBy(source).agg(F.count_distinct(role).alias("roles")).where("roles > 1")
    shared = samples.join(roles, source).groupBy(role).agg(F.count_distinct(source).alias("shared_sources"))
    told = by.join(shared, role, "left").fillna(0, ["shared_sources"])
    few = F.least("positives", "negatives") < least
    return told.withColumn("status", F.when(F.col("shared_sources") > 0, "SHARED_SOURCES").when(few, "TOO_FEW_SAMPLES").otherwise("READY"))


def posteriors(windows: DataFrame, base_rate: float, beta: list[float], delta: list[list[float]], doc: str = "doc_id") -> DataFrame:
    """(doc, valid, posterior): probability of the signal given all valid windows' bits.

    Layer l's chance that the window had a choice of two is a logistic function of beta[l] and the bits
    of the layers above; its likelihood ratio adds to the prior's log-odds.
    """
    if any(len(row) != len(beta) or any(row[i:]) for i, row in enumerate(delta)) or len(delta) != len(beta):
        raise ValueError("delta must be strictly lower triangular, one row a layer")
    prior = min(1 - 1e-5, max(1e-5, base_rate))
    gain = F.lit(0.0)
    for layer, b in enumerate(beta):
        logit = F.lit(float(b))
        for k in range(layer):
            logit = logit + F.lit(float(delta[layer][k])) * F.col("g")[k]
        two = _sigmoid(logit)
        likelihood = 0.5 * ((F.col("g")[layer] + 0.5) * two + (1 - two))
        gain = gain + F.log(F.greatest(F.lit(1e-30), likelihood)) - F.lit(math.log(0.5))
    by = windows.groupBy(doc).agg(F.count_if("valid").alias("valid"), F.sum(F.when(F.col("valid"), gain)).alias("gain"))
    odds = F.lit(math.log(prior) - math.log1p(-prior)) + F.col("gain")
    return by.select(doc, "valid", F.when(F.col("valid") > 0, _sigmoid(odds)).alias("posterior"))


def evidence(scores: DataFrame, windows: DataFrame, detector: str, adapter: str, depth: int, weights: list[float], doc: str = "doc_id") -> DataFrame:
    """One record a document: what was scored by what, how many windows counted, the raw score, and digests of both.

    The digest of the bits is over all windows in order, so that a record can be held against a
    recomputation; uncalibrated, so no decision.
    """
    bits = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "valid", "g"))), lambda w: F.concat(w["valid"].cast("int").cast("string"), F.array_join(w["g"].cast("array<string>"), ""))))
    batches = windows.groupBy(doc).agg(F.count("*").alias("windows"), F.sha2(bits, 256).alias("batch_sha256"))
    config = F.sha2(F.lit(f"{detector}|{adapter}|{depth}|" + ",".join(f"{w:.12g}" for w in weights)), 256)
    kept = scores.select(doc, "valid", F.col("score").alias("raw_score"), "failure").join(batches, doc)
    return kept.withColumns({"detector": F.lit(detector), "adapter": F.lit(adapter), "depth": F.lit(depth), "direction": F.lit("HIGHER_IS_MORE_SIGNAL"), "config_sha256": config})


#: Which detector may read which adapter's bits.
COMPATIBILITY = {
    ("mixed", "mean"): "SUPPORTED",
    ("mixed", "weighted_mean"): "SUPPORTED",
    ("table", "mean"): "SUPPORTED",
    ("table", "weighted_mean"): "SUPPORTED",
    ("mixed", "bayesian"): "UNVERIFIED",
    ("table", "bayesian"): "UNVERIFIED",
}


def compatibility(adapter: str, detector: str, ready: bool = False) -> str:
    """SUPPORTED, UNVERIFIED (a trained model that isn't marked ready) or UNSUPPORTED."""
    found = COMPATIBILITY.get((adapter, detector), "UNSUPPORTED")
    return "SUPPORTED" if found == "UNVERIFIED" and ready else found
