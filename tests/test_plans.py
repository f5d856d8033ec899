"""Calibration, evaluation, inference, sources, streaming."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions import binomial
from sigloom.plans import calibrate, evaluate, infer
from sigloom.sources import files


def test_exact_interval_and_test():
    assert binomial.clopper_pearson(4, 4) == (pytest.approx(0.3976, abs=1e-4), 1.0)
    low, high = binomial.clopper_pearson(5, 100)
    assert high == pytest.approx(0.11283491110546334, abs=1e-9)
    assert binomial.clopper_pearson(1, 100)[1] == pytest.approx(0.05445938539208044, abs=1e-9)
    assert binomial.clopper_pearson(15_000, 300_000)[0] == pytest.approx(0.04922279, abs=1e-8)
    for n in (1, 7, 40):
        for k in range(n):
            want = sum(math.comb(n, i) * 0.3**i * 0.7 ** (n - i) for i in range(k + 1))
            assert binomial.lower_tail(k, n, 0.3) == pytest.approx(want, rel=1e-11)
    assert binomial.two_sided(0, 0) == 1.0 and binomial.two_sided(0, 5) == pytest.approx(2 / 32)


@pytest.mark.parametrize("strict", [True, False])
def test_thresholds_by_search(spark, strict):
    rng = random.Random(4)
    xs = [rng.randrange(30) / 10 for _ in range(200)]
    df = spark.createDataFrame([(1, x) for x in xs], "k int, x double")
    got = {r.target: r for r in calibrate.thresholds(df, ("k",), "x", (0.05, 0.2), strict).collect()}
    for target, r in got.items():
        over = lambda t: sum(x > t if strict else x >= t for x in xs)
        fit = [t for t in xs if over(t) <= target * len(xs)]
        assert r.threshold == min(fit) and r.false_positives == over(min(fit))


def test_calibration_and_decisions(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(100)], "k string, x double")
    c = calibrate.calibrate(df, ("k",), "x", (0.05,)).first()
    assert c.threshold == 94 and c.false_positives == 5 and c.centre == 49.5 and c.resolution == "OK"
    assert c.ci_high == pytest.approx(0.11283491110546334, abs=1e-9)
    told = calibrate.decide(df, calibrate.calibrate(df, ("k",), "x", (0.05,)), ("k",), "x")
    assert told.where("positive").count() == 5
    flat = spark.createDataFrame([("a", 1.0)] * 5, "k string, x double")
    assert calibrate.robust(flat, ("k",), "x").first().status == "NO_SPREAD"


def test_bins_and_regimes(spark):
    assert calibrate.minimal_bins([(100, 5), (101, 5), (200, 5), (202, 1)]) == [101, 202]
    df = spark.range(5).select(calibrate.regime(F.col("id"), (1, 3)).alias("r"))
    assert [r.r for r in df.collect()] == [0, 0, 1, 1, 2]


def test_area_counts_ties_half(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5) / 2, rng.random() < 0.4) for _ in range(80)]
    got = evaluate.auc(spark.createDataFrame([(1, *r) for r in rows], "k int, x double, p boolean"), ("k",), "x", "p").first().auc
    pos, neg = [x for x, p in rows if p], [x for x, p in rows if not p]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_leave_one_out_by_refits(spark):
    rng = random.Random(7)
    rows = [(s, x, 2 * x + rng.random()) for s in range(5) for x in (rng.random() for _ in range(6))]
    got = evaluate.leave_one_out_fit(spark.createDataFrame(rows, "s int, x double, y double"), "s", "y", ("x",)).first().rmse
    total = 0.0
    for s in range(5):
        fit, test = [r for r in rows if r[0] != s], [r for r in rows if r[0] == s]
        mx, my = (sum(r[k] for r in fit) / len(fit) for k in (1, 2))
        slope = sum((r[1] - mx) * (r[2] - my) for r in fit) / sum((r[1] - mx) ** 2 for r in fit)
        total += sum((r[2] - my - slope * (r[1] - mx)) ** 2 for r in test)
    assert got == pytest.approx(math.sqrt(total / len(rows)))


def test_failures_stay_in_the_denominator(spark):
    ok = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double")
    bad = spark.createDataFrame([("a", "X")], "k string, reason string")
    r = evaluate.cells(ok, bad, ("k",), {"mean": F.col("x")}, {"ALL": F.lit(True), "NONE": F.lit(False)}).collect()
    by = {x.population: x for x in r}
    assert (by["ALL"].expected, by["ALL"].mean, by["ALL"].status) == (3, 2.0, "INCOMPLETE_FAILURE_ROWS")
    assert by["NONE"].status == "NO_ANALYSABLE_ROWS"


def test_empty_dose_bins_are_told(spark):
    df = spark.createDataFrame([(0.05, 3.0), (0.3, 1.0), (1.0, 2.0), (1.5, 9.0), (None, 7.0)], "d double, y double")
    got = evaluate.dose_response(df, "d", "y").orderBy("bin").collect()
    assert [(r.n, r["mean"], r.falls) for r in got] == [(2, 8.0, False), (1, 3.0, False), (0, None, False), (1, 1.0, True), (0, None, False), (1, 2.0, False)]


def test_holm_with_a_fixed_family(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    got = {r.p: r.p_holm for r in infer.holm(df, "p", 5).collect()}
    assert got == {0.01: pytest.approx(0.05), 0.03: pytest.approx(0.12), 0.04: pytest.approx(0.12)}


def test_sign_next_to_nought_is_free_of_the_order_of_rows(spark, tmp_path):
    from fractions import Fraction

    from sigloom import queries

    rng, rows = random.Random(3), []
    for k in range(60):
        # Means of 0.05 but for what a double can't hold.
        some = [rng.randrange(11) for _ in range(40 + k)]
        cents = some + [10 - c for c in some]
        rows += [("A" if k % 2 else "N", k, c / 100) for c in rng.sample(cents, len(cents))]
    signs = [sum(Fraction(x) - Fraction(0.05) for _, s, x in rows if s == k) for k in range(60)]
    want = {(f, sum(x > 0 for x in signs[i::2]), sum(x < 0 for x in signs[i::2])) for i, f in enumerate("NA")}
    for i, some in enumerate((rows, sorted(rows, key=lambda r: r[2]), sorted(rows, key=lambda r: -r[2]))):
        spark.createDataFrame(some, "l_returnflag string, l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert {(r.l_returnflag, r.up, r.down) for r in queries.sign_test(spark, f"{tmp_path}/{i}").collect()} == want


def test_means_by_parts(spark):
    rng = random.Random(4)
    sets = [[rng.uniform(-3, 3) * 10.0 ** rng.randrange(-6, 6) for _ in range(50)] for _ in range(8)] + [[0.05], [-7.0, None], [None], [math.inf, 1.0], [math.nan], [1e300, 2.0]]
    df = spark.createDataFrame([(k, x) for k, xs in enumerate(sets) for x in xs], "k int, x double")
    got = {r.k: r.d for r in df.groupBy("k").agg(infer.mean_less("x", 0.05).alias("d")).collect()}
    for k, xs in enumerate(sets[:8]):
        assert got[k] == pytest.approx(math.fsum([*xs, *[-0.05] * 50]) / 50, rel=1e-9)
    assert (got[8], got[9], got[10], got[11], got[13]) == (0.0, -7.05, None, math.inf, 5e299) and math.isnan(got[12])


def test_generator_is_the_published_one():
    rng = infer.SplitMix64(0)
    assert [rng.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]


def test_resampling_is_repeatable_and_sane(spark):
    df = spark.createDataFrame([("a", s, 1.0 + s / 10) for s in range(8)], "k string, s int, x double")
    a, b = (infer.bootstrap_mean(df, ("k",), (), "x", 100).first() for _ in range(2))
    assert a == b and a.low <= a["mean"] <= a.high
    assert infer.sign_flip(df, ("k",), "x", 200).first().p < 0.05
    assert infer.sign_test(df, ("k",), "x").first().p == pytest.approx(2 / 256)
    assert infer.bootstrap_clusters(df, "s", "x", 50).first().sources == 8
    r = infer.bootstrap_sources(df, ("k",), "x", 400, seed=5).first()
    rng, x = random.Random(5), [1.0 + s / 10 for s in range(8)]
    means = sorted(math.fsum(rng.choices(x, k=8)) / 8 for _ in range(400))
    assert (r.low, r.high) == (pytest.approx(means[9]), pytest.approx(means[390]))


def test_blocks_of_draws_equal_the_generator(monkeypatch):
    import numpy as np

    bounds = np.array([3, 8, 1, 2**40, 5])
    rng = [infer.SplitMix64(s) for s in (7, 2**64 - 1)]
    want = [[g.below(int(b)) for b in bounds] for g in rng]
    assert infer.draws(np.array([7, 2**64 - 1], np.uint64), bounds).tolist() == want
    # Bounds that refuse half of all outputs.
    large = np.array([2**63 + 1] * 6, np.uint64)
    g = infer.SplitMix64(3)
    g.next()
    assert infer.draws(np.array([3], np.uint64), large, 2)[0].tolist() == [g.below(2**63 + 1) for _ in range(6)]


def test_strict_json(spark, tmp_path):
    lines = ['{"a":1,"b":"x"}', '{"a":1,"a":2,"b":"x"}', '{"a":1}', '{"b":"x","a":1}', "nope", "[1]"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    got = {r.raw: r.problem for r in files.read_json(spark, str(tmp_path / "x.json"), schema, must_be_canonical=True).collect()}
    assert [got[x] for x in lines] == [None, "DUPLICATE_KEY", "FIELDS_DIFFER", "NOT_CANONICAL", "NOT_JSON", "NOT_AN_OBJECT"]
    assert files.canonical_json({"b": -0.0, "a": {2, 1}}) == '{"a":[1,2],"b":0.0}'
    with pytest.raises(ValueError):
        files.canonical_json(float("nan"))
    assert json.loads(files.canonical_json({"x": (1, 2)})) == {"x": [1, 2]}


def test_sinks_pins_and_ledger(spark, tmp_path):
    files.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        files.pins(spark, [("a", "r", "1"), ("a", "r", "2")])
    pinned = files.pins(spark, [("a", "r", "1"), ("b", "r", "2")])
    assert [r.source_id for r in files.drifted(pinned, spark.createDataFrame([("a", "1")], "source_id string, revision string")).collect()] == ["b"]
    events = spark.createDataFrame([(1, 1, "AUTHORIZED"), (1, 2, "STARTED"), (2, 1, "STARTED"), (1, 3, "COMPLETED"), (1, 4, "STARTED")], "run int, seq int, state string")
    assert sorted((r.run, r.seq) for r in files.broken_ledger(events).collect()) == [(1, 4), (2, 1)]
    assert files.environment(spark, 7).first().seed == 7


def test_seed_expression_matches_the_driver_side(spark):
    from sigloom.functions.text import seed64, seed_payload

    got = spark.createDataFrame([("d1",), ('q"\\',)], "id string").select("id", seed64(seed_payload(5, F.lit("shard"), F.col("id"))).alias("s")).collect()
    assert all(int(r.s) == files.derive_seed(5, ["shard", r.id]) for r in got)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    from sigloom.operators.windows import Signal
    from sigloom.streaming.scores import score_batch, score_stream

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 11}" for j in range(20))) for k in range(6)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    signal, out = Signal(n=3), str(tmp_path / "out")
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    score_stream(spark, stream, signal, lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(spark.read.parquet(out).collect()) == sorted(score_batch(spark, docs, signal).collect())


def test_reports(spark):
    from sigloom.plans import reports

    df = spark.createDataFrame([("abcdef", [(1, 2, "XY"), (4, 6, "")], "aXYcd"), ("", [], ""), ("ab", [(0, 1, "b")], "wrong")], "t string, ops array<struct<start:int,end:int,replacement:string>>, out string")
    assert [r.t for r in reports.broken_traces(df, "t", "ops", "out").collect()] == ["ab"]
    rows = lambda *r: spark.createDataFrame(r, "s string, b int, g double, ok boolean, win boolean")
    gate = lambda df: reports.paired_gate(df, "s", "b", "g", "ok", "win").first().verdict
    assert gate(rows(("x", 4, 1.0, True, True), ("x", 6, 1.0, True, True))) == "PASS"
    assert gate(rows(("x", 4, 1.0, True, False), ("x", 6, 1.0, True, True))) == "K1"
    assert gate(rows(("x", 4, 0.0, True, True), ("x", 6, 1.0, True, True))) == "K2"
    assert gate(rows(("x", 4, 1.0, True, True), ("y", 6, 1.0, True, True))) == "INCOMPLETE"
    use = reports.rule_usage(spark.createDataFrame([("a", ["r", "r", "q"]), ("a", ["r"])], "arm string, rules array<string>"), "rules", "arm")
    assert {(r.rule, r.traces, r.uses) for r in use.collect()} == {("r", 2, 3), ("q", 1, 1)}
    with pytest.raises(ValueError):
        reports.registry(spark, {"a": ("b",), "b": ("a",)})
    rules, kinds = spark.createDataFrame([("r",)], "rule string"), spark.createDataFrame([("k",), ("l",)], "kind string")
    seen = spark.createDataFrame([("r", "k", True, False)], "rule string, kind string, overlaps boolean, violated boolean")
    assert {(r.kind, r.overlap) for r in reports.stress_matrix(rules, kinds, seen).collect()} == {("k", 1), ("l", 0)}
    ready = reports.readiness(rules, spark.createDataFrame([("r", "READY")], "rule string, status string"), spark.createDataFrame([("r",)] * 5, "rule string"))
    assert ready.first().status == "READY"


def test_running_sums_and_ranks(spark):
    from sigloom.operators.ordered import with_rank, with_running

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(9)) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(3)
    for keys in ((), ("k",)):
        got = with_running(df, keys, ["at"], {"s": F.col("x")}, {"m": F.col("x")}).collect()
        for r in got:
            before = [x for k, at, x in rows if at < r["at"] and (not keys or k == r.k)]
            assert (r.s, r.m) == (sum(before), max(before, default=None))
        assert sorted(r.rank for r in with_rank(df, keys, [F.desc("at")]).collect() if r.k == "a" or not keys) == list(range(len([x for x in rows if not keys or x[0] == "a"])))
    assert with_rank(df.limit(0), (), ["at"]).count() == 0
