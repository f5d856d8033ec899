"""Intervals, corpus checks, spans."""

import random

import pytest

from sigloom.operators import corpus, intervals, spans, scan


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merging_and_coverage_against_sets(spark):
    rng = random.Random(1)
    rows = [(k % 7, k, s, s + rng.randrange(-1, 9)) for k, s in ((k, rng.randrange(60)) for k in range(120))]
    df = frame(spark, rows, "doc int, id int, start int, end int")
    want = {}
    for d, _, s, e in rows:
        want.setdefault(d, set()).update(range(s, e))
    assert {r.doc: r.covered for r in intervals.union_size(df, ("doc",)).collect()} == {d: len(x) for d, x in want.items() if x}
    got = {(r.doc, r.id, r.b_id) for r in intervals.conflicts(df, ("doc",)).collect()}
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]}
    narrow = {(r.doc, r.id, r.b_id) for r in intervals.overlaps(df, df, ("doc",), width=3).where("id < b_id").collect()}
    assert narrow == got


def test_touching_spans_merge_or_stay(spark):
    df = frame(spark, [(1, 0, 3, "A"), (1, 3, 5, "B"), (1, 4, 6, "A")], "doc int, start int, end int, kind string")
    assert [(r.start, r.end) for r in intervals.merged(df, ("doc",)).collect()] == [(0, 6)]
    apart = intervals.merged(df, ("doc",), touching=False, kinds="kind").orderBy("start").collect()
    assert [(r.start, r.end, r.kinds) for r in apart] == [(0, 3, ["A"]), (3, 6, ["A", "B"])]


def test_independent_candidates(spark):
    df = frame(spark, [(1, 0, 10), (1, 0, 2), (1, 2, 4), (1, 3, 9)], "doc int, start int, end int")
    r = intervals.independent_count(df, ("doc",)).first()
    assert (r.candidates, r.independent, r.status) == (4, 2, "SCARCE")


def test_span_to_window_coverage(spark):
    words = frame(spark, [(1, k, 4 * k, 4 * k + 3, 8) for k in range(10)], "doc int, pos int, start int, end int, windows int")
    marks = frame(spark, [(1, 0, 5, 6), (1, 1, 36, 38)], "doc int, id int, start int, end int")
    cover = intervals.covered_windows(marks, words, 3, ("doc",))
    assert sorted((r.id, r.start, r.end) for r in cover.collect()) == [(0, 0, 2), (1, 7, 8)]
    fit = frame(spark, [(1, 1), (1, 7)], "doc int, pos int")
    assert sorted((r.id, r.start, r.end) for r in intervals.eligible_coverage(cover, fit, ("doc",)).collect()) == [(0, 1, 2), (1, 7, 8)]


def test_exploded_tables_are_not_broadcast(spark):
    # Planned at the size of spark.range alone: without the exploded positions, which may be far beyond a driver's memory.
    docs = spark.range(1000).withColumnRenamed("id", "doc")
    words = docs.selectExpr("doc", "explode(sequence(0L, 99L)) AS pos").selectExpr("doc", "pos", "pos * 7 AS start", "pos * 7 + 6 AS end", "96L AS windows")
    marks = docs.selectExpr("doc", "0 AS id", "5L AS start", "600L AS end")
    fit = docs.selectExpr("doc", "explode(sequence(0L, 95L)) AS pos")
    cover = intervals.covered_windows(marks, words, 5, ("doc",))
    for df in (cover, intervals.eligible_coverage(marks, fit, ("doc",)), intervals.eligible_coverage(cover, fit, ("doc",))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def slow_first(rows):
    a, b, out = {}, {}, {}
    for at, x, y in sorted(rows):
        hits = [o[k] for o, k in ((a, x), (b, y)) if k in o]
        out[at] = (not hits, min(hits) if hits else None)
        if not hits:
            a[x], b[y] = at, at
    return out


def test_two_key_first_occurrences(spark):
    rng = random.Random(2)
    for rows in ([(1, "a", "1"), (2, "a", "2"), (3, "b", "2")], [(k, f"a{rng.randrange(12)}", f"b{rng.randrange(12)}") for k in range(60)], []):
        df = frame(spark, rows, "id long, a string, b string")
        got = {r.ordinal: (r.kept, r.conflict) for r in corpus.first_occurrences(df, "id", "a", "b").collect()}
        assert got == slow_first(rows)


def test_checks_raise(spark):
    df = frame(spark, [(1, "x"), (1, "y"), (2, "x")], "id int, split string")
    with pytest.raises(corpus.Violation):
        corpus.expect_empty(corpus.duplicates(df, "id"), "ids repeat")
    corpus.expect_empty(corpus.duplicates(df, "id", "split"), "rows repeat")
    assert [r.id for r in corpus.leaks(df, "id", "split").collect()] == [1]
    with pytest.raises(corpus.Violation):
        corpus.expect_equal(df, df.limit(2), "replay")
    corpus.expect_equal(df, df, "replay")
    ranges = frame(spark, [(0, 5), (5, 9), (10, 12)], "start int, end int")
    assert [tuple(r) for r in corpus.gaps(ranges).collect()] == [(9, 10)]


def test_protected_kinds_and_violations(spark):
    text = "See https://a.example/x. Mail bob@mail.example.org on 2024-02-30 or 2024-02-28, pay $5.00 or 7% of 1,200 at 10.0.0.1 [3] `x y` \"a quote\""
    found = {(k, text[s:e]) for s, e, k in scan.find(text)}
    assert {("URL", "https://a.example/x"), ("EMAIL", "bob@mail.example.org"), ("DATE", "2024-02-28"), ("PERCENTAGE", "7%"), ("NUMBER", "1,200"), ("IPV4", "10.0.0.1"), ("CITATION", "[3]"), ("CODE", "`x y`"), ("QUOTATION", '"a quote"')} <= found
    assert ("DATE", "2024-02-30") not in found
    df = frame(spark, [(1, text), (2, None), (3, "")], "doc_id long, text string")
    raw = spans.raw_spans(df)
    assert {r.doc_id for r in raw.collect()} == {1}
    after = spans.raw_spans(df.replace(text, text.replace("7%", "8%")))
    assert spans.violations(raw, after, "doc_id").first().lost == 2  # the percentage and its number


def test_signature_of_negation_and_modality(spark):
    df = frame(spark, [(1, "You don’t have to; it cannot be required. We should not, may, and need to, never.")], "id int, text string")
    from pyspark.sql import functions as F

    s = df.select(spans.signature(F.col("text")).alias("s")).first().s
    assert s.negations == ["do:not", "can:not", "should:not", "never"]
    assert s.modalities == ["obligation:have_to", "can", "obligation:required", "should", "may", "permission:may", "obligation:need_to"]


def test_reviews(spark):
    votes = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "b")], "sample int, label string")
    got = {r.sample: r.verdict for r in spans.adjudicated(votes, "sample", "label").collect()}
    assert got == {1: "a", 2: None, 3: "b"}
