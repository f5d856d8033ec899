"""Operators on single texts: pieces, personal data, toxicity, language model."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from sigloom.llm import lm, pii, pieces, queries, toxicity
from sigloom.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a ", "a  b", "▁", "x▁ y", "tab\tnew\nline \r\x0b", "é😀 ok", "<s> </s>", "\x00", "word " * 3000, "z" * 5000]


def docs(spark, texts):
    rows = [(k, t, "ids", 1.5, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, key string")


def test_pieces_equal_the_library(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab  ▁\n\té😀.1") for _ in range(rng.randrange(14))) for _ in range(300)]
    df = docs(spark, texts)
    ids = pieces.encode(df, MODEL, keep=tuple(df.columns))
    got = {r.doc_id: r for r in pieces.decode(ids, MODEL, keep=("doc_id", "ids")).collect()}
    encoder = pieces.ChunkEncoder(MODEL, table_chunks=40)
    assert encoder.by_chunk
    for k, t in enumerate(texts):
        want = encoder.model.encode(t or "") + [encoder.model.eos_id()]
        assert got[k].ids == want and got[k].decoded == encoder.model.decode(want)
        bounds, flat = encoder.encode(pa.array([t or ""], pa.large_string()), 2)
        assert flat.tolist() == want  # with a table that overflows again and again
    assert pieces.encode(df.limit(0), MODEL, keep=("doc_id",)).count() == 0


def brute_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_matchers_by_regex():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a@.-+ 1920(%)x\n..@11") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)
    long = "1." * 40000 + "a" * 100000 + "+" * 1000 + "9" * 50000
    assert len(pii.base_spans(long)) == 10000  # in linear time


def test_patterns_discover_what_the_matchers_miss(spark):
    texts = [f"Please write to mail us at u{k}@host{k}.example.org soon." for k in range(6)]
    texts += ["Please mail us at someone(at)host.example soon.", "There is at someone(at)else too.", None, ""]
    got = {r.doc_id: r for r in pii.extract(docs(spark, texts), spark).collect()}
    assert len(got) == len(texts)
    assert [len(got[k].base) for k in range(6)] == [1] * 6
    (span,) = got[6].spans
    assert texts[6][span.start : span.end] == "someone(at)host.example" and span.kind == 0
    assert got[7].spans == got[8].spans == got[9].spans == []
    assert pii.extract(docs(spark, []), spark).count() == 0


def test_discoveries_next_to_other_numbers_and_far_contexts(spark):
    long = "x" * 250
    texts = [f"{long}{k % 2} number +1 (555) 010-00{k:02} ok" for k in range(10, 20)]
    texts += ["call +1 (555) 010-0077 10.1.2.3 now", f"{long}0 number 555 010 0099 ok", "nothing 12 here", "7 " * 30_000]
    got = {r.doc_id: r for r in pii.extract(docs(spark, texts), spark).collect()}
    told = {k: [texts[k][s.start : s.end] for s in r.spans if s not in r.base] for k, r in got.items()}
    # The base phone matcher drops a run of more than 15 digits as a whole.
    assert told[10] == ["+1 (555) 010-0077"] and told[11] == ["555 010 0099"]
    assert not any(told[k] for k in told if k not in (10, 11))


def brute_graph(seen, rounds, least, support):
    """(kind, pattern) -> confidence, by dictionaries; ``seen`` has (kind, patterns, instance, seed)."""
    edges = {}
    for kind, patterns, instance, seed in seen:
        for p in patterns:
            edges[kind, p, instance] = edges.get((kind, p, instance), False) or seed
    all_ = collections.Counter(p for _, p, _ in edges)
    seeds = {(k, i) for (k, _, i), s in edges.items() if s}
    trust = {(k, i): float((k, i) in seeds) for k, _, i in edges}
    for _ in range(rounds):
        good, count = collections.defaultdict(float), collections.Counter()
        for k, p, i in edges:
            good[k, p] += trust[k, i]
            count[k, p] += trust[k, i] >= 0.5
        conf = {x: g / (all_[x[1]] + 1) for x, g in good.items() if g / (all_[x[1]] + 1) >= least and count[x] >= support}
        doubt = collections.defaultdict(lambda: 1.0)
        for k, p, i in edges:
            doubt[k, i] *= max(1 - conf.get((k, p), 0.0), 1e-9)
        trust = {x: 1.0 if x in seeds else 1 - doubt[x] for x in trust}
    return conf


def test_pattern_graph_by_dictionaries(spark):
    rng = random.Random(9)
    seen = [(rng.randrange(2), [f"p{rng.randrange(6)}", f"q{rng.randrange(4)}"], f"i{rng.randrange(40)}", rng.random() < 0.6) for _ in range(150)]
    df = spark.createDataFrame(seen, "kind int, patterns array<string>, instance string, seed boolean")
    for least in (0.3, 0.5, 0.7):
        got = {(r.kind, r.pattern): r.conf for r in pii.confident_patterns(df, Scratch(spark), 3, least, 3).collect()}
        want = brute_graph(seen, 3, least, 3)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_registered_digests_of_personal_data(spark):
    """Base spans by plain regular expressions, additions by the graph above over the same occurrences."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = {k: pii.found(t) for k, t in rows}
    conf = brute_graph([(f["kind"], f["patterns"], f["instance"], f["seed"]) for v in found.values() for f in v], 3, 0.7, 3)
    got = {r.doc_id: r for r in queries.op8_pii(spark, DATA).collect()}
    for k, t in rows:
        base = brute_spans(t)
        told = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in base)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[k][f"n_{name}"] for name in pii.KINDS] == [sum(x == j for _, x, _ in base) for j in range(4)]
        new = sorted((-max(conf[f["kind"], p] for p in f["patterns"] if (f["kind"], p) in conf), f["start"] - f["end"], f["start"], f["kind"], f["end"]) for f in found[k] if not f["seed"] and any((f["kind"], p) in conf for p in f["patterns"]))
        taken = []
        for _, _, s, kind, e in new:
            if not any(a < e and s < b for a, _, b in taken):
                taken.append((s, kind, e))
        want = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(base + taken))
        assert (got[k].spans, got[k].n_added) == (want, len(taken))


def test_odd_rows_of_personal_data(spark):
    rows = [(1, "a@b.cc x", "y"), (1, "a@b.cc x", "y"), (2, None, None)]
    df = spark.createDataFrame(rows, "base long, text string, `▁row` string")
    got = pii.extract(df, spark, keep=("base", "▁row", "text")).collect()
    assert len(got) == 3 and all(set(r.asDict()) == {"▁row", "text", "base", "spans"} for r in got)
    assert sorted(len(r.base) for r in got) == [0, 1, 1]


def test_toxicity_learns_locates_and_ignores_ids(spark):
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(40)]
    texts, toxic = [], []
    for k in range(240):
        sentences = [" ".join(rng.choices(plain, k=8)) + "." for _ in range(4)]
        bad = k % 4 == 0
        if bad:
            sentences[2] = "you vileword and nastyterm thing."
        texts.append(" ".join(sentences))
        toxic.append(int(bad))
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.where("doc_id IS NULL OR doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all((got[k].score >= 0.5) == bool(toxic[k]) for k in range(160, 240))
    (span,) = got[200].sentences
    assert texts[200][span.start : span.end] == "you vileword and nastyterm thing."
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].score == 0
    only = toxicity.fit(df, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(df, only).collect()) < 0.01
    assert toxicity.score(df.limit(0), model).count() == 0


def brute_lm(texts, held):
    tokens = {k: (t or "").encode().lower().split() + [b" end"] for k, t in texts.items()}
    c, pairs = collections.Counter(), collections.Counter()
    for k, w in tokens.items():
        if k not in held:
            c.update(w)
            pairs.update(zip([b" start", *w], w))
    low = collections.Counter(w for _, w in pairs)
    d, dl = (lm.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, low))
    ctx = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (v, _), n in pairs.items():
        ctx[v][0] += n
        ctx[v][min(n, 3)] += 1
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0
    total, spare = len(pairs), sum(dl[min(n, 3) - 1] for n in low.values()) / max(1, len(pairs))

    def p(v, w):
        q = cut(low[w], dl) / max(1, total) + (spare if total else 1) / (len(c) + 1)
        if v not in ctx:
            return q
        n = ctx[v]
        return cut(pairs[v, w], d) / n[0] + sum(x * y for x, y in zip(d, n[1:])) / n[0] * q

    return {k: sum(math.log10(p(v, x)) for v, x in zip([b" start", *w], w)) for k, w in tokens.items()}, p, c


@pytest.mark.parametrize("small", [False, True])
def test_language_model_by_dictionaries(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "TOKENS_A_PART", 8)
        monkeypatch.setattr(lm, "BIGRAMS_A_PART", 40)
        monkeypatch.setattr(lm, "HOT_SHARE", 0.05)
        monkeypatch.setattr(lm, "GATHER", 50)
    rng = random.Random(4)
    texts = dict(enumerate(ODD[:10] + [" ".join(f"W{int(rng.expovariate(0.3))}" for _ in range(rng.randrange(30))) for _ in range(60)]))
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    df = docs(spark, list(texts.values()))
    model = lm.train(df.where(~df.doc_id.isin(*held)), spark)
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    want, p, c = brute_lm(texts, held)
    for k in texts:
        assert got[k].score == pytest.approx(want[k], rel=1e-9)
    assert sum(p(b"w1", w) for w in c) + p(b"w1", b"unseen word") == pytest.approx(1)
    assert model.tokens == sum(c.values()) and model.types == len(c)
    empty = lm.train(df.limit(0), spark)
    assert lm.score(df, empty).first().score == pytest.approx(0.0)  # one outcome only: the unknown token
