import random

import numpy as np
import pytest

from sigloom.operators import align, windows


def slow(a, b):
    n, m = len(a), len(b)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    ops, ties, i, j = "", 0, n, m
    while i or j:
        if i and j:
            c = [d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1]
            ties += c.count(d[i][j]) - 1
            k = c.index(d[i][j])
        else:
            k = 1 if i else 2
        ops += ("M" if i and j and a[i - 1] == b[j - 1] else "S", "D", "I")[k]
        i, j = i - (k != 2), j - (k != 1)
    return d[n][m], ties, ops[::-1]


def same(got, a, b):
    assert (got["distance"], got["ties"], got["ops"]) == slow(a, b), (a, b)
    i = j = 0
    for op in got["ops"]:
        if op in "MS":
            assert got["placed"][i] == j and got["matched"][i] == (j if op == "M" else -1)
        elif op == "D":
            assert got["placed"][i] == got["matched"][i] == -1
        i, j = i + (op != "I"), j + (op != "D")


@pytest.mark.parametrize("cells", [0, 30, 10**6])
def test_against_a_full_table(cells):
    rng = random.Random(3)
    for k in range(600):
        a = [rng.randrange(2 + k % 3) for _ in range(rng.randrange(14))]
        b = [rng.randrange(2 + k % 3) for _ in range(rng.randrange(14))]
        same(align.align(np.array(a, np.int64), np.array(b, np.int64), cells), a, b)


@pytest.mark.parametrize("cells", [1, 200, 1500, 10**6])
def test_bands_kept_in_parts(cells):
    rng = random.Random(4)
    for size in [0, 1, 2, 5] + [rng.randrange(120) for _ in range(25)]:
        a = [rng.randrange(4) for _ in range(size)]
        b = [x for x in a if rng.random() < 0.8] + [7] * rng.randrange(20)
        same(align.align(np.array(a, np.int64), np.array(b, np.int64), cells), a, b)


def test_long_pairs_have_results_in_every_pair_query(spark):
    """Their band is beyond MAX_CELLS: 22,001 rows of 881 cells."""
    a = [k % 5000 for k in range(22_000)]
    b = [x for k, x in enumerate(a) if k % 50]
    pairs = align.aligned(spark.createDataFrame([(1, a, b)], "pair long, a array<long>, b array<long>")).cache()
    al = pairs.first().al
    assert al.distance == len(a) - len(b) == 440 and al.ops == "".join("M" if k % 50 else "D" for k in range(len(a)))
    assert align.conserved_runs(pairs).count() == 440
    signal = windows.Signal(n=2, keys=(7,), history=4)
    root, final = (windows.signal_windows(pairs, spark, signal, tokens=c, doc="pair") for c in "ab")
    diffs = align.window_diffs(pairs, 2)
    assert align.diff_summary(diffs).first().preserved == len(a) - 1 - (2 * 440 - 1)
    assert align.survival(diffs, root, final).count() == 1 and align.bit_drift(diffs, root, final).count() == 1
    told = align.residual_geometry(diffs, root, final).first()
    assert told.preserved > 0.9 * told.root_valid > 0 and told.destruction_fraction < 0.1


def test_maps_runs_diffs_and_survival(spark):
    pairs = spark.createDataFrame([(1, [1, 2, 3, 4, 5], [1, 2, 9, 4, 5]), (2, [], []), (3, [7, 8, 9], [7, 8, 9])], "pair long, a array<long>, b array<long>")
    al = align.aligned(pairs).cache()
    got = {r.pair: r.al for r in al.collect()}
    assert got[1].distance == 1 and got[1].matched == [0, 1, None, 3, 4] and got[1].placed == [0, 1, 2, 3, 4]
    runs = sorted(tuple(r) for r in align.conserved_runs(al).collect())
    assert runs == [(1, 0, 2, 0, 2), (1, 3, 5, 3, 5), (3, 0, 3, 0, 3)]
    diffs = align.window_diffs(al, 2)
    assert [(r.pos, r.to, r.state) for r in diffs.where("pair = 1").orderBy("pos").collect()] == [(0, 0, "PRESERVED"), (1, 1, "REPLACED"), (2, 2, "REPLACED"), (3, 3, "PRESERVED")]
    summary = {r.pair: r for r in align.diff_summary(diffs).collect()}
    assert summary[1].replacement_ratio == 0.5 and summary[3].preserved_ratio == 1.0
    signal = windows.Signal(n=2, keys=(7,), history=4)
    root, final = (windows.signal_windows(pairs, spark, signal, tokens=c, doc="pair") for c in "ab")
    lived = {r.pair: r for r in align.survival(diffs, root, final).collect()}
    assert lived[1].survived == 2 and lived[1].unmapped == 2 and lived[1].changed == 0 and lived[3].ratio == 1.0
    geometry = {r.pair: r for r in align.strict_gate(align.residual_geometry(diffs, root, final)).collect()}
    assert geometry[1].survival_fraction + geometry[1].destruction_fraction == 1 and geometry[1].eligible
    assert align.bit_drift(diffs, root, final).count() == 2


def test_residual_geometry_invariants(spark):
    rng = random.Random(24)
    rows = []
    for k in range(60):
        a = [rng.randrange(1, 9) for _ in range(rng.randrange(13))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(1, 9)] * rng.randrange(2)
        rows.append((k, a, b))
    pairs = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")
    signal = windows.Signal(n=3, keys=(7,), history=5, eos=9999)
    root, final = (windows.signal_windows(pairs, spark, signal, tokens=c, doc="pair") for c in "ab")
    diffs = align.window_diffs(align.aligned(pairs), 3)
    for r in align.residual_geometry(diffs, root, final).collect():
        assert 0 <= r.survival_fraction <= 1 and 0 <= r.inherited_fraction <= 1
        assert r.preserved <= min(r.root_valid, r.final_valid)
        assert not r.final_valid or r.inherited_fraction + r.new_fraction == pytest.approx(1)


def slow_ambiguous(a, b):
    """Tokens by all best alignments, told one by one."""
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            ways = ([1 + d[i + 1][j]] if i < n else []) + ([1 + d[i][j + 1]] if j < m else []) + ([(a[i] != b[j]) + d[i + 1][j + 1]] if i < n and j < m else [])
            d[i][j] = min(ways, default=0)
    fates = [set() for _ in a]

    def walk(i, j):
        if i < n and d[i][j] == 1 + d[i + 1][j]:
            fates[i].add(None)
            walk(i + 1, j)
        if j < m and d[i][j] == 1 + d[i][j + 1]:
            walk(i, j + 1)
        if i < n and j < m and d[i][j] == (a[i] != b[j]) + d[i + 1][j + 1]:
            fates[i].add(j if a[i] == b[j] else None)
            walk(i + 1, j + 1)

    walk(0, 0)
    return [len(f) > 1 and f != {None} for f in fates]


def test_ambiguous_tokens_by_all_alignments():
    rng = random.Random(6)
    for k in range(400):
        a = [rng.randrange(2 + k % 3) for _ in range(rng.randrange(8))]
        b = [rng.randrange(2 + k % 3) for _ in range(rng.randrange(8))]
        assert align.ambiguous(np.array(a, np.int64), np.array(b, np.int64)).tolist() == slow_ambiguous(a, b), (a, b)


def test_maps_back_validation_and_word_distance(spark):
    from pyspark.sql import functions as F

    pairs = align.aligned(spark.createDataFrame([(1, [1, 2, 3, 4], [1, 9, 4, 4]), (2, [], [7])], "pair long, a array<long>, b array<long>")).cache()
    got = {r.pair: r for r in align.inverse_maps(pairs).collect()}
    for r in got.values():
        assert [i for i in r.matched_back] == [r.al.matched.index(j) if j in r.al.matched else None for j in range(len(r.b))]
        assert [i for i in r.placed_back] == [r.al.placed.index(j) if j in r.al.placed else None for j in range(len(r.b))]
    assert align.invalid_alignments(pairs).count() == 0
    bad = pairs.withColumn("al", F.col("al").withField("distance", F.col("al.distance") + 1).withField("ties", F.lit(9)))
    assert [sorted(r.wrong) for r in align.invalid_alignments(bad).collect()] == [["distance", "ties"]] * 2
    texts = spark.createDataFrame([("it's one two", "it’s two"), ("", "a b"), (None, ""), ("x y z", "x z y")], "a string, b string")
    want = [slow((x or "").replace("’", "'").split(), (y or "").split())[0] for x, y in (("it's one two", "it’s two"), ("", "a b"), (None, ""), ("x y z", "x z y"))]
    assert [r.d for r in texts.select(align.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [2, 2, 0, 2] and len(want) == 4


def test_gate_reasons_and_counterfactuals(spark):
    from pyspark.sql import functions as F

    g = spark.createDataFrame([(0.5, 3), (1.0, 0)], "denominator_ratio double, repetition_delta long")
    all_ = align.strict_gate(g, span_violations=F.lit(2), invariants_hold=F.lit(False), fidelity_holds=F.lit(None).cast("boolean")).first().reasons
    assert all_ == sorted(all_) and len(all_) == 5
    assert [r.eligible for r in align.strict_gate(g).collect()] == [False, True]
    signal = windows.Signal(n=3, keys=(7,), history=4)
    text = " ".join(f"w{k}" for k in range(12))
    rows = [(1, text, text), (2, text, text.replace("w5", "zz")), (3, text, text.replace("w5", "zz")), (4, "short", "short"), (5, "a a b c d", "a b c d")]
    got = {r.pair: r for r in align.counterfactuals(spark.createDataFrame(rows, "pair long, source_text string, output_text string"), spark, signal).collect()}
    assert (got[1].survived, got[1].ratio) == (10, 1.0) and got[2][1:] == got[3][1:]
    assert (got[2].eligible, got[2].survived, got[2].unmapped, got[2].token_distance, got[2].char_distance) == (10, 7, 3, 1, 2)
    assert got[4].status == "NO_ELIGIBLE_OBSERVATIONS" and got[5].ambiguous == 2


def masks(tokens, n=5, history=64):
    """Whether each window's context tokens are new among those of the windows before."""
    seen, out = {}, []
    for p in range(len(tokens) - n + 1):
        c = tuple(tokens[p : p + n - 1])
        out.append(not (c in seen and p - seen[c] <= history))
        seen[c] = p
    return out


def test_registered_pair_queries_by_full_tables(spark):
    """Distance, ties, steps and survival of the supplied documents of up to 160 tokens, by plain Python."""
    from sigloom import queries

    data = "/root/testdata/sf0.001"
    pairs = {r.pair: (list(r.a), list(r.b)) for r in queries._pairs(spark, data).collect() if len(r.a) <= 160}
    aligned = {r.pair: r for r in queries.pair_alignment(spark, data).collect()}
    lived = {r.pair: r for r in queries.observation_survival(spark, data).collect()}
    some = 0
    for k, (a, b) in pairs.items():
        d, ties, ops = slow(a, b)
        assert (aligned[k].distance, aligned[k].ties, aligned[k].steps) == (d, ties, len(ops))
        if len(a) < 5:
            assert k not in lived
            continue
        match, i, j = [None] * len(a), 0, 0
        for op in ops:
            if op == "M":
                match[i] = j
            i, j = i + (op != "I"), j + (op != "D")
        old, new, counts = masks(a), masks(b), dict.fromkeys(("eligible", "survived", "newly_masked", "unmapped", "changed"), 0)
        for p, ok in enumerate(old):
            at = match[p : p + 5]
            if not ok:
                continue
            counts["eligible"] += 1
            if None in at:
                counts["unmapped"] += 1
            elif at != list(range(at[0], at[0] + 5)):
                counts["changed"] += 1
            else:
                counts["survived" if at[0] < len(new) and new[at[0]] else "newly_masked"] += 1
        assert {c: lived[k][c] for c in counts} == counts
        some += d > 0
    assert some > 20
