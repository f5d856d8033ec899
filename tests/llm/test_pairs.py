"""Operators on pairs of rows: near duplicates, passages, lines, vectors."""

import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sigloom.llm import ann, common, lines, neardup, passages, queries, topk
from sigloom.llm.common import Scratch, components

DATA = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    rows = [(i, t, "k", 1, [2.0]) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, rep int, root array<double>")


def groups_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    for edges in ([(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(5, 5), (None, 1)], []):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
        real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
        assert got == groups_of(real, {x for e in real for x in e})


def near_texts(rng):
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = [None, "", " \n", "one two", "ONE two", "a b c d e", "A B c d e"]
    for _ in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = "x"
        texts.append(" ".join(w))
    for _ in range(30):  # one shared passage in otherwise different texts
        texts.append(" ".join(base[:30] + [f"v{rng.randrange(900)}" for _ in range(rng.randrange(5, 40))]))
    texts += [" ".join(base)] * 20 + ["lone " + " ".join(f"u{k}" for k in range(3000))] * 2
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK", block)
    texts = near_texts(random.Random(2))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(links, range(len(texts)))
    got = {r.doc_id: r for r in neardup.groups(docs(spark, texts), spark).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.groups(docs(spark, []), spark).count() == 0
    got = neardup.groups(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [4, 4, None]), spark).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.doc_id) == [(4, 4, True)] * 2
    assert [r.kept for r in got if r.doc_id is None] == [True]


def brute_cut(texts):
    first, out = {}, {}
    words = {k: (t or "").encode().split() for k, t in texts}
    for k in sorted(words):
        for j in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][j : j + 13]), k)
    for k, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < k:
                gone[j : j + 13] = [True] * 13
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 600])
def test_repeated_passages_by_windows(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(passages, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(passages, "PART_WINDOWS", 300)
    monkeypatch.setattr(passages, "GATHER", 200)
    rng = random.Random(5)
    pool = [f"w{k}é" for k in range(40)]
    shared = [[rng.choice(pool) for _ in range(rng.randrange(10, 70))] for _ in range(6)]
    texts = [None, "", "short one"]
    for _ in range(70):
        parts = [rng.choice(shared)[rng.randrange(5) :] if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] for _ in range(4)]
        texts.append("  ".join(w for p in parts for w in p) + rng.choice(["", "\n"]))
    texts += ["same " * 500, "same " * 40, texts[10]]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.cut_repeats(docs(spark, texts), spark).collect()}
    assert got == brute_cut(list(enumerate(texts)))
    spans = passages.cut_repeats(docs(spark, texts), spark).where("n_removed > 0").first()
    assert sum(s.end - s.start for s in spans.removed) == spans.n_removed


def test_wide_alphabets_keep_alignment():
    ids, offsets = np.array([1, 2]), np.array([0, 20, 40])
    codes = np.tile(np.arange(20) + 0x100000, 2)
    hashes = np.tile(np.arange(20, dtype=np.uint64) * np.uint64(977) + np.uint64(1), 2)
    _, _, h = passages._windows(offsets, hashes, 13)
    gone = passages._locate(ids, offsets, codes, hashes, np.unique(h), np.full(len(np.unique(h)), 1), 13)
    assert gone.tolist() == [False] * 20 + [True] * 20


def test_passages_of_odd_tables(spark):
    assert passages.cut_repeats(docs(spark, []), spark).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    got = passages.cut_repeats(docs(spark, [text, text, text], [3, 3, None]), spark).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def line_words(line):
    return tuple(x for x in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if x)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    """Texts without repeated lines and the number of links, for (id, text) rows; edit similarity alone decides."""
    seen = {}
    for k, t in rows:
        for p, line in enumerate(t.split("\n") if t is not None and k is not None else []):
            if w := line_words(line):
                seen.setdefault(w, set()).add((k, t, p))
    all_ = list(seen)
    links = []
    for j, b in enumerate(all_):
        for i, a in enumerate(all_[:j]):
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            common = sum((collections.Counter(a) & collections.Counter(b)).values())
            if common >= max(len(a), len(b)) - most and distance(a, b) <= most:
                links.append((i, j))
    by = collections.defaultdict(set)
    for k, root in groups_of(links, range(len(all_))).items():
        by[root] |= seen[all_[k]]
    # Rows of one id come in the order of their texts' digests.
    order = lambda spot: (spot[0], spot[2], xxhash.xxh64_intdigest(spot[1].encode(), 42) % 2**31)
    gone = {x for spots in by.values() for x in sorted(spots, key=order)[1:]}
    return [t if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (k, t, p) not in gone) for k, t in rows], len(links)


def test_lines_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 3)
    rng = random.Random(6)
    base = [[f"word{rng.randrange(300)}" for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    frame = [f"frame{k}" for k in range(8)]
    texts = [None, "", "\n\n", "a b", "Two Words", "two  words", "one\nOne\n!"]
    for _ in range(50):
        picked = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            picked.append(rng.choice([" ", ", "]).join(w).title() if rng.random() < 0.3 else " ".join(w))
        # One frame in many lines, which are near each other or not: a bucket of several components.
        picked.append(" ".join(frame + [f"f{rng.randrange(4)}" for _ in range(rng.randrange(2, 7))]))
        texts.append("\n".join(picked))
    texts += ["\n".join("same " * k for k in range(3, 60)), "x " * 4000 + "\n" + "x " * 4001]
    rows = list(enumerate(texts))
    # Rows that repeat an id: equal ones, shorter ones, and ones with the lines of others.
    rows += [(20, texts[20]), (21, "short"), (22, "own line of this row alone\n" + texts[30]), (None, texts[40])]
    want, links = brute_lines(rows)
    made = docs(spark, [t for _, t in rows], [k for k, _ in rows])
    out = lines.dedup_lines(made, spark).collect()
    assert links > 20
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(((k, t) for (k, _), t in zip(rows, want, strict=True)), key=repr)
    by = {r.doc_id: r for r in out}
    assert by[0].n_lines == 0 and by[2].n_lines == 3 and set(by[0].asDict()) == {"doc_id", "text", "key", "rep", "root", "n_lines", "n_removed"}


def test_digests_of_the_line_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want, links = brute_lines(rows)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op1_line_dedup(spark, DATA).collect()}
    told = {k: hashlib.sha256(w.encode()).hexdigest() for (k, _), w in zip(rows, want, strict=True)}
    wrong = [k for k in told if told[k] != got[k][1]]
    assert links > 20 and not wrong


def test_lines_at_the_least_similarity_are_found(spark):
    """Recall against edit similarity alone, of pairs with as many changed words as it allows."""
    rng = random.Random(8)
    texts, sizes = [], []
    for k in range(600):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 61))]
        step = len(w) / (len(w) // 5)
        texts += [" ".join(w), " ".join("changed" + str(k * 100 + i) if i in {int(j * step) + 1 for j in range(len(w) // 5)} else x for i, x in enumerate(w))]
        sizes.append(len(w))
    got = {(r.doc_id, r.first_doc) for r in lines.repeated_lines(docs(spark, texts), spark).collect()}
    assert got <= {(k + 1, k) for k in range(0, len(texts), 2)}
    print("recall", len(got) / 600)
    assert len(got) >= 0.97 * 600
    assert all((2 * k + 1, 2 * k) in got for k, n in enumerate(sizes) if n <= 14)


def test_buckets_of_equal_members_are_one(spark):
    """Three near lines meet in many buckets, and a fourth in some of them: each set of members comes once."""
    keys = [(r, k) for k in range(10) for r in (1, 2, 3)] + [(r, k) for k in range(10, 15) for r in (1, 2, 3, 4)] + [(r, 100 + r) for r in range(5)]
    got = collections.defaultdict(set)
    for r in lines.shared_buckets(spark.createDataFrame(keys, "rep long, key long")).collect():
        got[r.key].add(r.rep)
    assert got == {0: {1, 2, 3}, 10: {1, 2, 3, 4}}


def test_lines_of_one_frame_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Lines with sixty words in common, two thirds of each, share buckets, but only the two near ones are compared."""
    frame = " ".join(f"frame{k}" for k in range(60))
    texts = [frame + "".join(f" w{k}x{i}" for i in range(30)) for k in range(60)]
    texts.append(texts[7].replace("w7x3 ", "other "))
    confirm, asked = lines._confirm, []

    def counted(pairs, *more):
        asked.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(lines, "_confirm", counted)
    monkeypatch.setattr(lines, "MANY", 8, raising=False)
    got = {(r.doc_id, r.first_doc) for r in lines.repeated_lines(docs(spark, texts), spark).collect()}
    assert got == {(60, 7)}
    print("pairs", asked)
    assert sum(asked[1:]) <= len(texts)


def test_words_of_large_buckets_are_counted_without_a_join(spark, monkeypatch):
    """Near lines share one of their rarest words; words of one line alone aren't among these, and no join makes a row for each word."""
    rng = random.Random(11)
    frame = [f"frame{k}" for k in range(40)]
    texts = [frame + [f"w{rng.randrange(40)}" for _ in range(14)] + [f"own{k}x{i}" for i in range(k % 4)] for k in range(40)]
    texts += [[*t[:3], "other", *t[4:50], "more", *t[50:]] for t in texts[:20]]
    numbers = collections.defaultdict(itertools.count(7).__next__)
    code = lambda t: "".join(chr(0x4E00 + numbers[x]) for x in t)
    known = spark.createDataFrame([(k, len(t), code(t), code(t)) for k, t in enumerate(texts)], "rep long, n int, codes string, more string")
    plans = []

    class Told(common.Scratch):
        def keep(self, df, rows=None):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().keep(df, rows)

    told = lines._spread(known.select("rep", F.col("rep").alias("root"), "n"), known, lines.SIMILARITY, Told(spark))
    rare = {r.rep: set(r.rare) for r in told.collect()}
    held = collections.Counter(x for t in texts for x in set(t))
    alone = spark.createDataFrame([(chr(0x4E00 + numbers[x]),) for x, n in held.items() if n == 1], "c string")
    alone = {r[0] for r in alone.select(F.xxhash64("c", "c")).collect()}
    assert len(rare) == len(texts) and alone and not alone & set().union(*rare.values())
    for i, j in itertools.combinations(range(len(texts)), 2):
        if distance(texts[i], texts[j]) <= int(max(len(texts[i]), len(texts[j])) * 0.2 + 1e-9):
            assert rare[i] & rare[j]
    assert plans and not [line for plan in plans for line in plan.split("\n") if "Join" in line and "word#" in line]


def test_lines_near_to_all_of_a_component_meet_few_of_it(spark, monkeypatch):
    """Lines that are near to every line of a component need one link to it: few are compared, and none is left apart."""
    base = [f"frame{k}" for k in range(50)]
    texts = [[*base[:k % 40], f"own{k}", *base[k % 40 + 1 :]] for k in range(300)]
    texts += [[*base[:j], *(f"out{k}x{i}" for i in range(4)), *base[j + 4 :]] for k in range(30) for j in (k,)]
    # Near to each other and to nothing else, and near to one line of the component alone.
    other = [w if i % 4 else f"far{i}" for i, w in enumerate(base)]
    texts += [[*other[:k], "own", *other[k + 1 :]] for k in range(3)] + [[f"lone{i}" if i in (45, 46, 47, 48, 49, 41, 42, 43, 44) else w for i, w in enumerate(texts[7])]]
    numbers = collections.defaultdict(itertools.count(7).__next__)
    code = lambda t: "".join(chr(0x4E00 + numbers[x]) for x in t)
    known = spark.createDataFrame([(k, len(t), code(t), code(t)) for k, t in enumerate(texts)], "rep long, n int, codes string, more string")
    start = [0 if k < 300 else k for k in range(len(texts))]
    side = spark.createDataFrame([(1, k, len(t), 0, 0, start[k], len(texts)) for k, t in enumerate(texts)], "key long, rep long, n int, b0 long, b1 long, root long, n_members long")
    confirm, asked = lines._confirm, []

    def counted(pairs, *more):
        asked.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(lines, "_confirm", counted)
    monkeypatch.setattr(lines, "HUBS", 8, raising=False)
    found = [(r.a, r.b) for r in lines._between(side, known, lines.SIMILARITY, Scratch(spark)).collect()]
    near = [(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if start[i] != start[j] and distance(a, b) <= 10]
    own = [(0, k) for k in range(300)]
    print("pairs", len(near), asked, len(found))
    assert set(found) <= set(near) and len(near) > 9000
    assert groups_of(own + found, range(len(texts))) == groups_of(own + near, range(len(texts)))
    assert sum(asked) <= len(near) / 8 and len(found) <= 2 * len(texts)


def exchanged(node):
    """Rows that the exchanges of an executed plan have written."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchanged(node.executedPlan())
    if "QueryStage" in name:
        return exchanged(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(exchanged(node.children().apply(i)) for i in range(node.children().size()))


def test_texts_that_no_pair_asks_for_are_not_exchanged(spark):
    """Of 3,000 lines five pairs are asked for: hardly more than their lines go through an exchange."""
    text = lambda k: "".join(chr(0x4E00 + (k // 2 * 40 + i) % 20_000) for i in range(20)) + chr(0x4DFF - k % 2)
    scratch = Scratch(spark)
    known = scratch.keep(spark.createDataFrame([(k, 21, text(k), text(k)) for k in range(3000)], "rep long, n int, codes string, more string"))
    pairs = spark.createDataFrame([(0, 1), (10, 11), (2998, 2999), (3, 2500), (8, 10)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = lines._confirm(pairs, known, lines.SIMILARITY, scratch)
        assert {(r.a, r.b) for r in near.collect()} == {(0, 1), (10, 11), (2998, 2999)}
        assert 0 < exchanged(near._jdf.queryExecution().executedPlan()) < 100
        none = lines._confirm(pairs.limit(0), known, lines.SIMILARITY, scratch)
        assert none.columns == ["a", "b"] and not none.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_of_steps_that_are_done_go(spark, tmp_path, monkeypatch):
    """While lines are cut only the table of all lines and that of the repeated ones are left of those written."""
    base = [" ".join(f"w{(7 * k + i) % 90}" for i in range(30)) for k in range(40)]
    texts = ["\n".join((base[k], base[(k + 1) % 40] + " more")) for k in range(40)]
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    gone = lines.repeated_lines(docs(spark, texts), spark)
    left = [p for d in tmp_path.iterdir() for p in d.iterdir()]
    assert len(left) == 2 and gone.count() >= 40


def test_words_that_share_a_code_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHARACTERS", 251)
    texts = [" ".join(f"w{rng.randrange(400)}" if k else f"v{j}" for k in (0, 0, 0, 1, 1, 1) for j in range(5)) for rng in map(random.Random, range(40))]
    want, links = brute_lines(list(enumerate(texts)))
    assert not links and [r.text for r in lines.dedup_lines(docs(spark, texts), spark).orderBy("doc_id").collect()] == want


def test_lines_of_odd_tables(spark):
    assert lines.dedup_lines(docs(spark, []), spark).count() == 0
    got = lines.dedup_lines(docs(spark, ["one two three", "one two three"], [None, 1]), spark).collect()
    assert [r.n_removed for r in got] == [0, 0]
    got = lines.dedup_lines(docs(spark, ["word " * 50_000, "word " * 50_001 + "\nx"]), spark).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == {0: (1, 0, "word " * 50_000), 1: (2, 1, "x")}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def odd_vectors(rng, n=400, dim=8):
    rows = [(k, [float(x) for x in rng.standard_normal(dim).astype(np.float32)], 0, 0.0) for k in range(n)]
    rows += [(n + k, rows[7][1], 0, 0.0) for k in range(60)]  # copies
    rows += [(900, None, 0, 0.0), (950, [], 0, 0.0), (1000, [0.0] * dim, 0, 0.0), (1001, [float("nan")] + [1.0] * (dim - 1), 0, 0.0), (1050, [None] + [1.0] * (dim - 1), 0, 0.0), (1100, [1.0, 2.0], 0, 0.0), (1101, [3.0, 1.0], 0, 0.0), (None, rows[0][1], 0, 0.0), (50, rows[50][1], 0, 0.0)]
    return rows


def fit_rows(rows, zero):
    out = {}
    for k, v, *_ in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.setdefault(k, np.array(v, float))
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 90])
def test_top_k_by_all_products(spark, shard_rows):
    rows = odd_vectors(np.random.default_rng(1))
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors(spark, rows), spark, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    by = fit_rows(rows, True)
    whole = {k: np.floor(256 * v).astype(int) for k, v in by.items()}
    for q in whole:
        if q % 50 == 0:
            all_ = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:5]
            assert got[q] == [(k, -s) for s, k in all_]
    assert set(got) == {q for q in whole if q % 50 == 0}
    assert topk.top_k(vectors(spark, []), spark).count() == 0


def test_top_k_of_huge_components():
    a = np.array([[1e300, -1e300], [3.0, 2.0]])
    assert topk._products(a, a).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 13]]


def test_neighbours_reach_the_recall_asked_for(spark):
    rows = odd_vectors(np.random.default_rng(2), n=2000, dim=32)
    rows = rows[:2060] + [(None if r[0] is None else r[0] + 5000, *r[1:]) for r in rows[2060:]]
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), spark, shard_rows=600, train_rows=500, rerank=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    by = fit_rows(rows, False)
    hit = want = 0
    for q, v in by.items():
        if q % 50 == 0:
            cos = {k: float(v @ x / np.sqrt((v @ v) * (x @ x))) for k, x in by.items() if k != q and len(x) == len(v)}
            best = sorted(cos, key=lambda k: (-round(cos[k], 12), k))[:5]
            hit += len({k for k, _ in got[q]} & set(best))
            want += len(best)
            assert all(s == pytest.approx(cos[k], abs=1e-12) for k, s in got[q])
    assert hit / want >= 0.9
    assert ann.nearest(vectors(spark, []), spark).count() == 0


def test_recall_on_the_supplied_vectors(spark):
    df = queries.op10_additive_quantisation(spark, "/root/testdata/sf0.01").collect()
    m = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    ids, x = [r[0] for r in m], np.array([r[1] for r in m], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    hit = 0
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    for k in asked:
        s = x @ x[k]
        s[k] = -9
        hit += len({ids[j] for j in np.argsort(-s)[:5]} & {r.vec_id for r in df if r.query_id == ids[k]})
    assert hit / (5 * len(asked)) >= 0.9


def test_digest_of_the_registered_query(spark):
    got = queries.op4_repeated_passages(spark, DATA).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    want = brute_cut(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in want.items()}
