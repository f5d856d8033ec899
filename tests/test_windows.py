import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import score, windows

TOKENS = [10, 20, 30, 40, 20, 30, 50]
TABLE = (0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 0, 0, 0, 0, 1)


def rows(spark, signal, *docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<long>")
    return windows.signal_windows(df, spark, signal).orderBy("doc_id", "pos").collect()


def test_golden_vector_of_mixed_bits(spark):
    signal = windows.Signal(n=3, keys=(7, 11, 13), history=4)
    assert signal.start == 2105788953907569235
    got = rows(spark, signal, TOKENS)
    assert [r.keys for r in got][0] == [6327938853751861990, -5109004398280069222, 7619268049413516788]
    assert [r.g for r in got] == [[0, 1, 1], [1, 0, 1], [1, 1, 1], [0, 0, 1], [0, 1, 0]]
    assert [r.context_ok for r in got] == [True, True, True, True, False]


def test_golden_vector_of_table_bits_and_end_masks(spark):
    for eos, mask in ((50, [1, 1, 1, 1, 0]), (40, [1, 0, 0, 0, 0]), (999, [1, 1, 1, 1, 1])):
        got = rows(spark, windows.Signal(n=3, keys=(7, 11, 13), history=4, table=TABLE, eos=eos), TOKENS)
        assert [r.g for r in got] == [[0, 1, 0], [1, 0, 1], [1, 0, 0], [1, 0, 0], [0, 1, 1]]
        assert [r.eos_ok for r in got] == [bool(m) for m in mask]


def test_short_and_empty_sequences_have_no_windows(spark):
    assert rows(spark, windows.Signal(n=5), [], [1, 2, 3, 4]) == []
    df = spark.createDataFrame([(1, [1, 2]), (2, [])], "doc_id long, tokens array<long>")
    assert [r.n for r in df.select(windows.n_windows(F.col("tokens"), 5).alias("n")).collect()] == [0, 0]


def test_context_mask_is_a_bounded_history(spark):
    rng = random.Random(5)
    docs = [[rng.randrange(3) for _ in range(rng.randrange(2, 30))] for _ in range(60)]
    signal = windows.Signal(n=3, keys=(7,), history=4)
    got = rows(spark, signal, *docs)
    for i, tokens in enumerate(docs):
        seen, want = [], []
        for k in range(len(tokens) - 2):
            ctx = tuple(tokens[k : k + 2])
            want.append(ctx not in seen[-4:])
            seen.append(ctx)
        assert [r.context_ok for r in got if r.doc_id == i] == want


def test_arithmetic_mode_is_restored(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    rows(spark, windows.Signal(n=3), TOKENS)
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_scores_and_failures(spark):
    df = spark.createDataFrame([(1, [1, 0], True), (1, [1, 1], True), (1, [0, 0], False), (2, [1, 1], False)], "doc_id long, g array<int>, valid boolean")
    got = {r.doc_id: r for r in score.mean_scores(df, 2).collect()}
    w = score.linear_weights(2)
    assert got[1].score == 0.75 and got[1].weighted_score == pytest.approx((2 * w[0] + w[1]) / 4)
    assert got[2].score is None and got[2].failure == "ZERO_VALID_WINDOWS"
    assert sum(score.linear_weights(30)) == pytest.approx(30) and score.linear_weights(1) == [1.0]


def test_posterior_by_hand(spark):
    import math

    df = spark.createDataFrame([(1, [1, 0, 1], True), (1, [0, 1, 1], True)], "doc_id long, g array<int>, valid boolean")
    beta, delta, base = [-1.0, -0.5, 0.25], [[0.0] * 3, [0.4, 0.0, 0.0], [-0.3, 0.2, 0.0]], 0.35
    odds = math.log(base / (1 - base))
    for g in ([1, 0, 1], [0, 1, 1]):
        for k in range(3):
            two = 1 / (1 + math.exp(-(beta[k] + sum(delta[k][j] * g[j] for j in range(k)))))
            odds += math.log(0.5 * ((g[k] + 0.5) * two + 1 - two)) - math.log(0.5)
    assert score.posteriors(df, base, beta, delta).first().posterior == pytest.approx(1 / (1 + math.exp(-odds)))
    with pytest.raises(ValueError):
        score.posteriors(df, base, beta, [[1.0, 0, 0], [0, 0, 0], [0, 0, 0]])
    assert score.compatibility("mixed", "bayesian", ready=True) == "SUPPORTED" and score.compatibility("x", "mean") == "UNSUPPORTED"
