"""The registered queries of texts on the smallest supplied tables, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from test_pairs import groups_of
from test_texts import brute_lm

from sigloom.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_near_duplicates(spark, texts):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(links, sorted(sets))
    got = {r.doc_id: r for r in queries.op3_near_duplicates(spark, DATA).collect()}
    assert links and {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


def test_language_model(spark, texts):
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    want, _, counts = brute_lm(texts, held)
    total = sum(counts.values())
    got = {r.doc_id: r for r in queries.op5_kneser_ney(spark, DATA).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b" end"]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(want[k], rel=1e-9)


def test_pieces(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op9_piece_codec(spark, DATA).collect():
        ids = model.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))


def test_toxicity_scores_by_plain_sums(spark, texts):
    """Noisy-or over sentences of sums of a fitted model's weights; the query's own scores follow from its labels alone."""
    from sigloom.llm.common import crc_mod

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    weight = dict(zip(model.numbers.tolist(), model.values.tolist(), strict=True))
    ends = re.compile(r"[.!?][\"')»”’\]]*$")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, DATA).collect()}
    for k, t in texts.items():
        clean, sums, some = 1.0, model.bias, False
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        for i, w in enumerate(words):
            sums += sum(weight.get(f, 0.0) for f in toxicity._features(w) if f >= 0)
            if ends.search(w) or i == len(words) - 1:
                clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, sums))))
                sums = model.bias
        assert got[k].score == pytest.approx(1 - clean if words else 0.0, abs=1e-9)
        assert got[k].predicted == int(got[k].score >= 0.5) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    # The bound on words leaves the shortest texts; none at all give a model that calls nothing toxic.
    small = toxicity.fit(docs, labels, most_words=0)
    assert max(r.score for r in toxicity.score(docs, small).collect()) < 0.01


def test_rows_and_names_of_odd_tables(spark):
    """Repeated rows, kept columns named like new ones, and texts of many words, through the text operators."""
    from sigloom.llm import lm, pieces

    long = "word " * 60_000
    rows = [(1, "a b c", 7.0, 1), (1, "a b c", 7.0, 1), (2, None, None, 2), (3, long, 1.0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, n_tokens int")
    model = lm.train(df, spark)
    got = lm.score(df, model, keep=("doc_id", "score", "n_tokens", "text")).collect()
    by = collections.Counter((r.doc_id, r.n_tokens) for r in got)
    assert by == {(1, 4): 2, (2, 1): 1, (3, 60_001): 1} and all(r.score < 0 for r in got)
    assert lm.score(df.limit(0), model).count() == 0
    told = toxicity.score(df, toxicity.Model({}, -3.0), keep=tuple(df.columns)).collect()
    assert len(told) == 4 and {r.text for r in told} == {"a b c", None, long}
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.round_trip(df, path, keep=tuple(df.columns)).collect()
    assert [len(r.ids) for r in both if r.doc_id == 3] and sum(r.doc_id == 1 for r in both) == 2
    assert pieces.decode(pieces.encode(df.limit(0), path), path).count() == 0
