"""The registered queries of the library's operators, and their SQL for the oracle.

Signal operators run on ``documents`` with a stand-in tokenizer (28 bits of a word's MD5); statistics on
the star schema, whose rows stand for outcome rows.  Nothing here is evidence about any signal: the texts
carry none, so scores are draws from a null distribution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content_words, seed64, seed_payload, sha256, shard, tokens
from .operators import align, corpus, intervals, score, spans, windows
from .plans import calibrate, evaluate, infer, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIGNAL = windows.Signal(n=5, keys=(7, 11, 13), history=64)
# A 32-entry bit table for the table variant.
TABLE = (0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 0, 0, 0, 0, 1)
TABLE_SIGNAL = windows.Signal(n=5, keys=(7, 11, 13), history=64, table=TABLE)
BETA, DELTA, BASE_RATE = [-1.0, -0.5, 0.25], [[0.0, 0.0, 0.0], [0.4, 0.0, 0.0], [-0.3, 0.2, 0.0]], 0.35


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Behind a generator: as a plain column the tokens would be made anew at every use.
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("tokens"))


# --- pieces of SQL -----------------------------------------------------------------------------------


def _tail(k: str, n: str, p: str) -> str:
    """P(X <= k) for n trials of probability p, term by term."""
    term = f"exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({p}) + ({n} - j) * ln(1 - ({p})))"
    return f"(CASE WHEN {k} < 0 THEN 0.0 WHEN {k} >= {n} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda j: {term})) END)"


def _intervals(source: str, k: str, n: str) -> str:
    """CTE ci (k, n, ci_low, ci_high): exact 95 % intervals of the distinct (k, n) of a table, by halving.  Needs RECURSIVE."""
    low, high = "(a0 + a1) / 2", "(b0 + b1) / 2"
    return f"""bisect(k, n, a0, a1, b0, b1, i) AS (
  SELECT DISTINCT CAST({k} AS BIGINT), CAST({n} AS BIGINT), 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM {source}
  UNION ALL SELECT k, n, CASE WHEN {_tail('k - 1', 'n', low)} > 0.975 THEN {low} ELSE a0 END, CASE WHEN {_tail('k - 1', 'n', low)} > 0.975 THEN a1 ELSE {low} END,
    CASE WHEN {_tail('k', 'n', high)} > 0.025 THEN {high} ELSE b0 END, CASE WHEN {_tail('k', 'n', high)} > 0.025 THEN b1 ELSE {high} END, i + 1 FROM bisect WHERE i < 40),
ci AS (SELECT k, n, round(CASE WHEN k = 0 THEN 0 ELSE a0 END, 6) AS ci_low, round(CASE WHEN k = n THEN 1 ELSE b1 END, 6) AS ci_high FROM bisect WHERE i = 40)"""


def _splitmix(seed: str, draw: str) -> str:
    """Output number ``draw`` (from 1) of the SplitMix64 generator of a seed, both UBIGINT."""
    mod = "18446744073709551616::UHUGEINT"
    z = f"((({seed})::UHUGEINT + ({draw})::UHUGEINT * 11400714819323198485::UHUGEINT) % {mod})::UBIGINT"
    step = lambda z, by, m: f"list_transform([{z}], lambda z: ((xor(z, z >> {by}))::UHUGEINT * {m}::UHUGEINT % {mod})::UBIGINT)[1]"
    z = step(step(z, 30, "13787848793156543929"), 27, "10723151780598845931")
    return f"list_transform([{z}], lambda z: xor(z, z >> 31))[1]"


def _seed(*parts: str) -> str:
    return f"('0x' || right(sha256(concat_ws('|', {', '.join(parts)})), 16))::UBIGINT"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- tokens, windows, signals ------------------------------------------------------------------------

_TOK = r"""tok AS MATERIALIZED (
  SELECT doc_id, list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> ''),
         lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT)) AS tokens FROM documents)"""
_M, _TWO64 = "6364136223846793005::HUGEINT", "18446744073709551616::HUGEINT"
_WIN = f"""{_TOK}, win AS MATERIALIZED (
  SELECT doc_id, pos, list_transform(tokens[pos + 1:pos + 5], lambda t: t::HUGEINT) AS gram
  FROM (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 4)) AS pos FROM tok))"""


def _fold(values: str, start: int) -> str:
    return f"list_reduce(list_prepend({start}::HUGEINT, {values}), lambda h, x: ((h + x) * {_M} + 1) % {_TWO64})"


def _hashed(start: int) -> str:
    return f"""{_WIN}, hashed AS MATERIALIZED (
  SELECT doc_id, pos, {_fold('gram[1:4]', start)} AS ctx, {_fold('gram', start)} AS h FROM win
), masked AS MATERIALIZED (
  SELECT *, NOT (coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, ctx ORDER BY pos) <= 64, false) OR (ctx = 0 AND pos < 64)) AS valid FROM hashed)"""


_SIGNED = f"(CASE WHEN a >= 9223372036854775808::HUGEINT THEN a - {_TWO64} ELSE a END)"
_ROUND = f"((((h + 1) * {_M} + 1) % {_TWO64}))"


def _bit(key: int) -> str:
    """The mixed bit: twelve rounds of the generator, each shifted right by five with its sign."""
    step = f"((h + 1) * {_M} + 1) % {_TWO64}"
    # Unsigned value a of the signed a >> 5: the sign fills the five upper bits.
    shifted = f"(({step}) // 32 + CASE WHEN ({step}) >= 9223372036854775808::HUGEINT THEN 17870283321406128128::HUGEINT ELSE 0::HUGEINT END)"
    start = f"((h + {key}) * {_M} + 1) % {_TWO64}"
    return f"CAST((list_reduce(list_prepend({start}, list_transform(range(12), lambda i: i::HUGEINT)), lambda h, x: {shifted}) // 1073741824) % 2 AS INT)"


_BITS = _hashed(SIGNAL.start) + f""", bits AS MATERIALIZED (
  SELECT doc_id, pos, valid, {', '.join(f'{_bit(k)} AS g{i}' for i, k in enumerate(SIGNAL.keys))} FROM masked)"""
_W = score.linear_weights(3)


@query(f"""WITH {_BITS}
SELECT doc_id, count(*) FILTER (valid) AS valid, CASE WHEN count(*) FILTER (valid) = 0 THEN 'ZERO_VALID_WINDOWS' END AS failure, round(sum(g0 + g1 + g2) FILTER (valid) / nullif(count(*) FILTER (valid) * 3, 0), 9) AS score,
       round((sum(g0) FILTER (valid) * {_W[0]!r} + sum(g1) FILTER (valid) * {_W[1]!r} + sum(g2) FILTER (valid) * {_W[2]!r}) / nullif(count(*) FILTER (valid) * 3, 0), 9) AS weighted_score
FROM bits GROUP BY doc_id""")
def doc_signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL)
    s = score.mean_scores(win, 3)
    return s.select("doc_id", "valid", "failure", F.round("score", 9).alias("score"), F.round("weighted_score", 9).alias("weighted_score"))


@query(f"WITH {_TOK} SELECT doc_id, CAST(greatest(0, len(tokens) - 4) AS BIGINT) AS n_windows FROM tok")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir).select("doc_id", windows.n_windows(F.col("tokens"), 5).cast("long").alias("n_windows"))


@query(f"""WITH {_hashed(SIGNAL.start)}
SELECT doc_id, count(*) AS n, CAST(sum(CAST(((CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {_TWO64} ELSE h END) % 1000003 + 1000003) % 1000003 AS BIGINT)) AS BIGINT) AS checksum
FROM masked GROUP BY doc_id""")
def window_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL)
    return win.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.pmod("h", F.lit(1000003))).alias("checksum"))


def _table_bit(key: int) -> str:
    return f"{list(TABLE)}[CAST((((h + {key}) * {_M} + 1) % {_TWO64}) % 32 AS INT) + 1]"


@query(f"""WITH {_hashed(1)}, b AS (SELECT doc_id, valid, {' + '.join(_table_bit(k) for k in TABLE_SIGNAL.keys)} AS s FROM masked)
SELECT doc_id, count(*) FILTER (valid) AS valid, CAST(coalesce(sum(s) FILTER (valid), 0) AS BIGINT) AS ones FROM b GROUP BY doc_id""")
def table_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, TABLE_SIGNAL)
    ones = F.sum(F.when(F.col("valid"), F.aggregate("g", F.lit(0), lambda a, x: a + x)).otherwise(0))
    return win.groupBy("doc_id").agg(F.count_if("valid").alias("valid"), ones.alias("ones"))


@query(f"""WITH {_WIN}, c AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, gram[1:4] ORDER BY pos) AS gap FROM win)
SELECT doc_id, count(*) AS n, count(*) FILTER (gap <= 64) AS repeated FROM c GROUP BY doc_id""")
def exact_context_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.exact_context_repeats(tokenized(spark, sf_dir), 5, 64)
    return r.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("repeated").alias("repeated"))


_THE = "CAST('0x' || substr(md5('the'), 1, 7) AS BIGINT)"


@query(f"""WITH {_hashed(SIGNAL.start)}, e AS (SELECT m.*, coalesce(list_position(tokens, {_THE}), 0) AS p FROM masked m JOIN tok USING (doc_id)),
c AS (SELECT doc_id, count(*) AS windows, count(*) FILTER (valid AND (p = 0 OR pos + 5 < p)) AS eligible, count(*) FILTER (NOT valid) AS repeated,
      count(*) FILTER (NOT (p = 0 OR pos + 5 < p)) AS after_end FROM e GROUP BY doc_id)
SELECT doc_id, length(text) AS code_points, strlen(text) AS bytes, coalesce(windows, 0) AS windows, coalesce(eligible, 0) AS eligible,
       coalesce(repeated, 0) AS repeated, coalesce(after_end, 0) AS after_end FROM documents LEFT JOIN c USING (doc_id)""")
def opportunity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the word "the" as the end token, so that the end mask is at work."""
    import dataclasses
    import hashlib

    signal = dataclasses.replace(SIGNAL, eos=int(hashlib.md5(b"the").hexdigest()[:7], 16))
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, signal)
    return windows.opportunity(win, table(spark, sf_dir, "documents"))


@query(f"""WITH {_BITS}, e AS (SELECT unnest([0, 1, 2]) AS depth, unnest([g0, g1, g2]) AS bit FROM bits WHERE valid)
SELECT depth, count(*) AS valid, round(avg(bit), 9) AS mean_bit FROM e GROUP BY depth""")
def depth_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL)
    return score.depth_means(win, 3).withColumn("mean_bit", F.round("mean_bit", 9))


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _gain(layer: int) -> str:
    logit = " + ".join([repr(BETA[layer]), *[f"({DELTA[layer][k]!r}) * g{k}" for k in range(layer)]])
    return f"ln(greatest(1e-30, 0.5 * ((g{layer} + 0.5) * {_sig(logit)} + (1 - {_sig(logit)})))) - ln(0.5)"


@query(f"""WITH {_BITS}, s AS (SELECT doc_id, count(*) FILTER (valid) AS valid, sum({' + '.join(_gain(k) for k in range(3))}) FILTER (valid) AS gain FROM bits GROUP BY doc_id)
SELECT doc_id, valid, round(CASE WHEN valid > 0 THEN {_sig(f'ln({BASE_RATE}) - ln(1 - {BASE_RATE}) + gain')} END, 6) AS posterior FROM s""")
def bayesian_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL)
    return score.posteriors(win, BASE_RATE, BETA, DELTA).withColumn("posterior", F.round("posterior", 6))


# --- identity and corpus checks ----------------------------------------------------------------------


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(sha256(F.col("text")).alias("text_sha256"))
    return corpus.duplicates(d, "text_sha256")


@query("""SELECT doc_id, CAST('0x' || right(sha256('{"master_seed":42,"parts":["shard","' || doc_id || '"]}'), 16) AS HUGEINT)::VARCHAR AS seed,
       CAST(CAST('0x' || right(sha256('{"master_seed":42,"parts":["shard","' || doc_id || '"]}'), 16) AS HUGEINT) % 16 AS INT) AS shard FROM documents""")
def seeds_and_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = seed_payload(42, F.lit("shard"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", seed64(payload).cast("string").alias("seed"), shard(42, 16, F.col("doc_id")).alias("shard"))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def dangling_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = table(spark, sf_dir, "documents").where("lang = 'en'")
    return corpus.dangling(table(spark, sf_dir, "labels"), en, "doc_id").select("doc_id", "quality")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IS NOT NULL)")
def unused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return corpus.unused(table(spark, sf_dir, "part"), large, "p_partkey").select("p_partkey")


@query("SELECT d.doc_id, d.lang FROM documents d JOIN (SELECT source, min(lang) AS lang FROM documents GROUP BY source) s USING (source) WHERE d.lang IS DISTINCT FROM s.lang")
def metadata_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    dim = d.groupBy("source").agg(F.min("lang").alias("lang"))
    return corpus.disagreements(d, dim, "source", ("lang",)).select("doc_id", "lang")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def partition_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = corpus.leaks(table(spark, sf_dir, "documents"), "source", "lang")
    return leaks.select("source", F.array_join("splits", ",").alias("splits"))


@query("""SELECT match_id, n, signatures FROM (SELECT doc_id // 2 AS match_id, count(*) AS n, count(DISTINCT doc_id % 2) AS labels, count(DISTINCT lang) AS signatures
  FROM documents GROUP BY 1) WHERE n <> 2 OR labels <> 2 OR signatures <> 1""")
def matched_pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("match_id"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("label"), "lang")
    return corpus.bad_pairs(d, "match_id", "label", ("a", "b"), ("lang",)).select("match_id", "n", "signatures")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_chars >= 200 THEN NULL ELSE 'long_enough' END, CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'known_language' END) AS broken
FROM documents WHERE NOT coalesce(n_chars >= 200, false) OR NOT coalesce(lang IN ('en', 'de', 'fr'), false)""")
def sample_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = corpus.guards(table(spark, sf_dir, "documents"), long_enough=F.col("n_chars") >= 200, known_language=F.col("lang").isin("en", "de", "fr"))
    return bad.select("doc_id", F.concat_ws(",", "broken").alias("broken"))


def _first(rows: str) -> str:
    """CTE told (ordinal, kept, at_a, at_b): rows (ordinal, a, b) one by one, with lists of what has been kept.  Needs RECURSIVE."""
    return f"""q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ordinal) AS k FROM ({rows})),
walk(k, ordinal, kept, at_a, at_b, ka, kb, ko) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL SELECT k, ordinal, at_a IS NULL AND at_b IS NULL, at_a, at_b, CASE WHEN at_a IS NULL AND at_b IS NULL THEN list_append(ka, a) ELSE ka END,
    CASE WHEN at_a IS NULL AND at_b IS NULL THEN list_append(kb, b) ELSE kb END, CASE WHEN at_a IS NULL AND at_b IS NULL THEN list_append(ko, ordinal) ELSE ko END FROM (
    SELECT q.k, q.ordinal, q.a, q.b, ko[list_position(ka, q.a)] AS at_a, ko[list_position(kb, q.b)] AS at_b, ka, kb, ko FROM walk JOIN q ON q.k = walk.k + 1)),
told AS MATERIALIZED (SELECT ordinal, kept, at_a, at_b FROM walk WHERE k > 0)"""


_KEYS = "SELECT doc_id AS ordinal, sha256(text) AS a, sha256(array_to_string(list_sort(string_split(lower(text), ' ')), ' ')) AS b FROM documents"


def _dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys: the text's hash, and one of its sorted words (edits of order share it)."""
    words = F.array_join(F.array_sort(F.split(F.lower("text"), " ")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("a"), F.sha2(words, 256).alias("b"))


@query(f"""WITH RECURSIVE {_first(_KEYS)}
SELECT ordinal, kept, CASE WHEN NOT kept THEN least(at_a, at_b) END AS conflict, CASE WHEN NOT kept THEN concat_ws('+', CASE WHEN at_a IS NOT NULL THEN 'TEXT' END, CASE WHEN at_b IS NOT NULL THEN 'TOKENS' END) END AS kinds FROM told""")
def first_occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_occurrences(_dedup_keys(spark, sf_dir), "doc_id", "a", "b").select("ordinal", "kept", "conflict", "kinds")


@query(f"""WITH RECURSIVE {_first(_KEYS + " WHERE doc_id % 2 = 0")}, h AS ({_KEYS}), s AS (SELECT h.* FROM h JOIN told USING (ordinal) WHERE kept), x AS (
  SELECT u.ordinal, min(s.ordinal) AS conflict, 'TEXT' AS kind FROM h u JOIN s USING (a) WHERE u.ordinal % 2 = 1 GROUP BY u.ordinal
  UNION ALL SELECT u.ordinal, min(s.ordinal), 'TOKENS' FROM h u JOIN s USING (b) WHERE u.ordinal % 2 = 1 GROUP BY u.ordinal)
SELECT ordinal AS doc_id, min(conflict) AS conflict, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds FROM x GROUP BY ordinal""")
def cross_role_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents against those even ones that are kept among themselves."""
    d = _dedup_keys(spark, sf_dir)
    kept = corpus.first_occurrences(d.where("doc_id % 2 = 0"), "doc_id", "a", "b").where("kept")
    selected = kept.select(F.col("ordinal").alias("doc_id"), F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return corpus.cross_role_conflicts(d.where("doc_id % 2 = 1"), selected, "doc_id", "a", "b")


@query("""SELECT 'text' AS key, count(*) AS shared FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)""")
def role_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return corpus.overlap_count(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "text")


@query("SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 25")
def first_rows_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_n(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 25).select("lang", "doc_id", "rank")


@query("SELECT shard, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS shard FROM documents) GROUP BY shard")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = corpus.shard_plan(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)
    return plan.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


@query("SELECT lang, count(*) AS n, CAST(CASE WHEN count(*) >= 2000 THEN 2000 WHEN count(*) >= 1000 THEN 1000 ELSE 0 END AS INT) AS usable FROM documents GROUP BY lang")
def corpus_size_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return by.withColumn("usable", corpus.size_rule(F.col("n")))


@query("""SELECT source, lang, doc_id, CASE WHEN r <= 2 THEN 'FIT' ELSE 'EVAL' END AS part
FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3""")
def source_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.holdout(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id")


@query("""WITH e AS (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents) l), d AS (SELECT DISTINCT source, lang FROM documents)
SELECT source, lang, 'MISSING' AS problem FROM e WHERE (source, lang) NOT IN (SELECT (source, lang) FROM d)""")
def incomplete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    grid = corpus.grid(d.select("source").distinct(), d.select("lang").distinct())
    return corpus.incomplete(grid, d, ("source", "lang"))


# --- pairs -------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with some tokens dropped and some changed, by their number."""
    a = tokenized(spark, sf_dir)
    b = F.transform(F.filter("tokens", lambda t: t % 97 != 0), lambda t: F.when(t % 89 == 0, t + 1).otherwise(t))
    return a.select(F.col("doc_id").alias("pair"), F.col("tokens").alias("a"), b.alias("b"))


def _sides(spark: SparkSession, pairs: DataFrame, sure: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Window diffs and both texts' windows; the alignment is made once, as a table."""
    root, final = (windows.signal_windows(pairs, spark, SIGNAL, tokens=c, doc="pair") for c in ("a", "b"))
    pairs = align.aligned(pairs)
    return align.window_diffs(pairs if sure else align.with_ambiguity(pairs), 5), root, final


@query()
def pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = align.aligned(_pairs(spark, sf_dir))
    return p.select("pair", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "al.distance", "al.ties", F.length("al.ops").alias("steps"))


@query()
def observation_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.survival(*_sides(spark, _pairs(spark, sf_dir)))


@query()
def document_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = align.strict_gate(align.residual_geometry(*_sides(spark, _pairs(spark, sf_dir))))
    return told.withColumn("reasons", F.concat_ws(",", "reasons"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against themselves: tokens dropped, changed and doubled by their number, and the beginning again at the end."""
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair"), F.explode(F.array(tokens(F.col("text")))).alias("a"))
    each = lambda t: F.when(t % 11 == 0, F.array().cast("array<bigint>")).when(t % 7 == 0, F.array(t + 1)).when(t % 13 == 0, F.array(t, t)).otherwise(F.array(t))
    return a.select("pair", "a", F.concat(F.flatten(F.transform("a", each)), F.slice("a", 1, 8)).alias("b"))


_ITEMS = r"""i AS MATERIALIZED (SELECT item_id AS pair, list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> ''),
  lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT)) AS a FROM benchmark),
p AS MATERIALIZED (SELECT pair, a, list_concat(flatten(list_transform(a, lambda t: CASE WHEN t % 11 = 0 THEN []::BIGINT[] WHEN t % 7 = 0 THEN [t + 1] WHEN t % 13 = 0 THEN [t, t] ELSE [t] END)), a[1:8]) AS b FROM i),
rows_(pair, i, r) AS (
  SELECT pair, 0::BIGINT, range(0, len(b) + 1) FROM p
  UNION ALL SELECT pair, i, list_transform(range(0, len(c)), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: c[k + 1] - k))) FROM (
    SELECT pair, d.i + 1 AS i, list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN d.i + 1 ELSE least(r[j + 1] + 1, r[j] + CAST(a[d.i + 1] <> b[j] AS BIGINT)) END) AS c
    FROM rows_ d JOIN p USING (pair) WHERE d.i < len(a))),
d AS MATERIALIZED (SELECT * FROM rows_),
path(pair, step, i, j, op, ties) AS (
  SELECT pair, 0, len(a), len(b), '', 0 FROM p
  UNION ALL SELECT pair, step + 1, CASE WHEN op = 'I' THEN i ELSE i - 1 END, CASE WHEN op = 'D' THEN j ELSE j - 1 END, op, ties FROM (
    SELECT pair, step, i, j, CASE WHEN i = 0 THEN 'I' WHEN j = 0 THEN 'D' WHEN c0 = best THEN CASE WHEN same THEN 'M' ELSE 'S' END WHEN c1 = best THEN 'D' ELSE 'I' END AS op,
      CASE WHEN i = 0 OR j = 0 THEN 0 ELSE CAST(c0 = best AS INT) + CAST(c1 = best AS INT) + CAST(c2 = best AS INT) - 1 END AS ties FROM (
      SELECT *, least(c0, c1, c2) AS best FROM (
        SELECT t.pair, t.step, t.i, t.j, a[t.i] = b[t.j] AS same, y.r[t.j] + CAST(a[t.i] <> b[t.j] AS INT) AS c0, y.r[t.j + 1] + 1 AS c1, x.r[t.j] + 1 AS c2
        FROM path t JOIN p USING (pair) JOIN d x ON x.pair = t.pair AND x.i = t.i LEFT JOIN d y ON y.pair = t.pair AND y.i = t.i - 1 WHERE t.i > 0 OR t.j > 0)))),
steps AS MATERIALIZED (SELECT * FROM path WHERE step > 0),
placed AS MATERIALIZED (SELECT pair, i, j, op = 'M' AS match FROM steps WHERE op IN ('M', 'S')),
spots AS (SELECT pair, len(a) AS n, unnest(range(0, greatest(0, len(a) - 4))) AS pos FROM p),
states AS MATERIALIZED (SELECT pair, pos, CASE WHEN m = 5 AND high - low = 4 AND firm THEN 'PRESERVED' WHEN n = 5 AND top - bottom = 4 AND flat THEN 'REPLACED' ELSE 'UNMAPPED' END AS state, m = 5 AS whole, bottom AS "to"
  FROM (SELECT s.pair, s.pos, count(q.i) AS n, count(q.i) FILTER (match) AS m, min(j) FILTER (match) AS low, max(j) FILTER (match) AS high, min(j) AS bottom, max(j) AS top,
    min(j - q.i) FILTER (match) = max(j - q.i) FILTER (match) AS firm, min(j - q.i) = max(j - q.i) AS flat
    FROM spots s LEFT JOIN placed q ON q.pair = s.pair AND q.i BETWEEN s.pos AND s.pos + 4 GROUP BY ALL))"""
_TOK_ITEMS = "tok AS MATERIALIZED (SELECT pair * 2 AS doc_id, a AS tokens FROM p UNION ALL SELECT pair * 2 + 1, b FROM p)"
_ITEM_BITS = _BITS.replace(_TOK, _TOK_ITEMS)


@query(f"""WITH RECURSIVE {_ITEMS}
SELECT pair, len(a) AS n_a, len(b) AS n_b, CAST(r[len(b) + 1] AS INT) AS distance, CAST(coalesce(t.ties, 0) AS INT) AS ties, coalesce(t.ops, '') AS ops
FROM p JOIN d USING (pair) LEFT JOIN (SELECT pair, sum(ties) AS ties, string_agg(op, '' ORDER BY step DESC) AS ops FROM steps GROUP BY pair) t USING (pair) WHERE d.i = len(a)""")
def item_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = align.aligned(_items(spark, sf_dir))
    return p.select("pair", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "al.distance", "al.ties", "al.ops")


@query(f"""WITH RECURSIVE {_ITEMS}, m AS (SELECT pair, i, j, i - row_number() OVER (PARTITION BY pair ORDER BY i) AS g, j - row_number() OVER (PARTITION BY pair ORDER BY i) AS h FROM placed WHERE match)
SELECT pair, CAST(min(i) AS INT) AS a_start, CAST(max(i) + 1 AS INT) AS a_end, CAST(min(j) AS INT) AS b_start, CAST(max(j) + 1 AS INT) AS b_end FROM m GROUP BY pair, g, h""")
def conserved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.conserved_runs(align.aligned(_items(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_ITEMS} SELECT pair, list_transform(range(0, len(b)), lambda x: NULL::INT) = [] AS nothing, coalesce(m.forth, '') AS forth, coalesce(m.back, '') AS back FROM p LEFT JOIN (
  SELECT pair, string_agg(i || ':' || j, ',' ORDER BY i) FILTER (match) AS forth, string_agg(j || ':' || i, ',' ORDER BY j) AS back FROM placed GROUP BY pair) m USING (pair)""")
def alignment_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches forth and places back, as far as there are some."""
    told = align.inverse_maps(align.aligned(_items(spark, sf_dir)))
    pairs_of = lambda c: F.concat_ws(",", F.filter(F.transform(c, lambda x, k: F.concat_ws(":", k.cast("string"), x.cast("string"))), lambda s: s.contains(":")))
    return told.select("pair", (F.size("b") == 0).alias("nothing"), pairs_of("al.matched").alias("forth"), pairs_of("placed_back").alias("back"))


@query(f"""WITH RECURSIVE {_ITEMS} SELECT pair, count(*) AS windows, count(*) FILTER (state = 'PRESERVED') AS preserved, count(*) FILTER (state = 'REPLACED') AS replaced, count(*) FILTER (state = 'UNMAPPED') AS unmapped,
round(count(*) FILTER (state = 'PRESERVED') / count(*), 9) AS preserved_ratio, round(count(*) FILTER (state <> 'PRESERVED') / count(*), 9) AS replacement_ratio FROM states GROUP BY pair""")
def window_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.diff_summary(_sides(spark, _items(spark, sf_dir))[0]), 9, "preserved_ratio", "replacement_ratio")


@query(f"""WITH RECURSIVE {_ITEMS} SELECT s.pair, s.pos, s."to" FROM states s WHERE state = 'PRESERVED' AND EXISTS (SELECT 1 FROM states o WHERE o.pair = s.pair AND o.state = 'PRESERVED' AND o.pos < s.pos AND o."to" >= s."to")""")
def broken_window_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.broken_maps(_sides(spark, _items(spark, sf_dir))[0])


@query("SELECT item_id AS pair, '' AS wrong FROM benchmark WHERE false")
def invalid_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alignments made again: none may differ."""
    return align.invalid_alignments(align.aligned(_items(spark, sf_dir))).select("pair", F.concat_ws(",", "wrong").alias("wrong"))


_FATES = f"""{_ITEMS}, {_ITEM_BITS}, old AS (SELECT doc_id // 2 AS pair, * FROM bits WHERE doc_id % 2 = 0), new AS (SELECT doc_id // 2 AS pair, * FROM bits WHERE doc_id % 2 = 1),
fates AS MATERIALIZED (SELECT s.pair, s.pos, s.state, s."to", old.valid AS was, coalesce(new.valid, false) AS "is", CASE WHEN NOT old.valid THEN 'ROOT' WHEN NOT whole THEN 'UNMAPPED' WHEN state <> 'PRESERVED' THEN 'CHANGED' WHEN NOT coalesce(new.valid, false) THEN 'MASKED' ELSE 'SURVIVED' END AS fate
  FROM states s JOIN old ON old.pair = s.pair AND old.pos = s.pos LEFT JOIN new ON new.pair = s.pair AND new.pos = s."to")"""


@query(f"""WITH RECURSIVE {_FATES}, c AS (SELECT pair, count(*) FILTER (was) AS eligible, count(*) FILTER (fate = 'SURVIVED') AS survived, count(*) FILTER (fate = 'MASKED') AS newly_masked, count(*) FILTER (fate = 'UNMAPPED') AS unmapped,
  count(*) FILTER (fate = 'CHANGED') AS changed FROM fates GROUP BY pair)
SELECT *, 0::BIGINT AS ambiguous, round(CASE WHEN eligible > 0 THEN survived / eligible ELSE 1 END, 9) AS ratio, round(CASE WHEN eligible > 0 THEN (eligible - survived) / eligible ELSE 0 END, 9) AS destroyed_ratio,
CASE WHEN eligible > 0 THEN 'OK' ELSE 'NO_ELIGIBLE_OBSERVATIONS' END AS status FROM c""")
def item_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.survival(*_sides(spark, _items(spark, sf_dir))), 9, "ratio", "destroyed_ratio")


@query()
def sure_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival of windows whose tokens every best alignment treats alike."""
    return align.survival(*_sides(spark, _items(spark, sf_dir), sure=False))


@query(f"""WITH RECURSIVE {_FATES}, w AS (SELECT pair, count(*) AS n, count(*) FILTER (valid) AS root_valid, count(*) FILTER (NOT valid) AS root_repeated FROM old GROUP BY pair),
v AS (SELECT pair, count(*) FILTER (valid) AS final_valid, count(*) FILTER (NOT valid) AS final_repeated FROM new GROUP BY pair),
k AS (SELECT pair, count(*) FILTER ("is") AS preserved, count(*) FILTER (NOT "is") AS lost_to_repetition FROM fates WHERE was AND state = 'PRESERVED' GROUP BY pair),
z AS (SELECT w.pair, root_valid, root_repeated, 0::BIGINT AS root_after_end, coalesce(final_valid, 0) AS final_valid, coalesce(final_repeated, 0) AS final_repeated, 0::BIGINT AS final_after_end,
  coalesce(preserved, 0) AS preserved, coalesce(lost_to_repetition, 0) AS lost_to_repetition, 0::BIGINT AS lost_to_end, 0::BIGINT AS lost_to_both FROM w LEFT JOIN v USING (pair) LEFT JOIN k USING (pair)),
g AS (SELECT *, preserved / greatest(1, root_valid) AS survival_fraction, 1 - preserved / greatest(1, root_valid) AS destruction_fraction, preserved / greatest(1, final_valid) AS inherited_fraction,
  (final_valid - preserved) / greatest(1, final_valid) AS new_fraction, final_valid / greatest(1, root_valid) AS denominator_ratio, final_repeated - root_repeated AS repetition_delta, 0::BIGINT AS end_delta FROM z)
SELECT * REPLACE (round(survival_fraction, 9) AS survival_fraction, round(destruction_fraction, 9) AS destruction_fraction, round(inherited_fraction, 9) AS inherited_fraction, round(new_fraction, 9) AS new_fraction, round(denominator_ratio, 9) AS denominator_ratio),
concat_ws(',', CASE WHEN denominator_ratio < 0.9 THEN 'FINAL_VALID_DENOMINATOR_COLLAPSE' END, CASE WHEN root_valid % 2 = 0 THEN 'HARD_FIDELITY_INVARIANT_FAILED' END, CASE WHEN preserved % 3 > 0 THEN 'PROTECTED_SPAN_VIOLATION' END,
  CASE WHEN repetition_delta > 4 THEN 'REPETITION_MASK_GAMING' END, CASE WHEN final_valid % 5 = 0 THEN 'VISIBLE_FIDELITY_LIMIT_EXCEEDED' END) AS reasons,
NOT (denominator_ratio < 0.9 OR root_valid % 2 = 0 OR preserved % 3 > 0 OR repetition_delta > 4 OR final_valid % 5 = 0) AS eligible FROM g""")
def residual_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span, invariant and fidelity checks are stood in for by remainders of counts."""
    told = align.residual_geometry(*_sides(spark, _items(spark, sf_dir)))
    gate = align.strict_gate(told, 4, 0.9, F.col("preserved") % 3, F.col("root_valid") % 2 != 0, F.col("final_valid") % 5 != 0)
    gate = rounded(gate, 9, "survival_fraction", "destruction_fraction", "inherited_fraction", "new_fraction", "denominator_ratio")
    return gate.withColumn("reasons", F.concat_ws(",", "reasons"))


@query(f"""WITH RECURSIVE {_FATES}, e AS (SELECT f.pair, unnest([0, 1, 2]) AS depth, unnest([old.g0 <> new.g0, old.g1 <> new.g1, old.g2 <> new.g2]) AS changed FROM fates f JOIN old ON old.pair = f.pair AND old.pos = f.pos AND old.valid
  JOIN new ON new.pair = f.pair AND new.pos = f."to" AND new.valid WHERE f.state <> 'UNMAPPED')
SELECT pair, depth, count(*) AS compared, count(*) FILTER (changed) AS changed FROM e GROUP BY ALL""")
def bit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.bit_drift(*_sides(spark, _items(spark, sf_dir)))


@query(f"""WITH {_TOK}, n AS (SELECT doc_id AS pair, len(tokens) AS n FROM tok WHERE len(tokens) >= 20), m AS (SELECT *, n // 2 AS spot FROM n)
SELECT pair, CAST(least(spot, n - 5) - greatest(0, spot - 4) + 1 AS BIGINT) AS predicted, CAST(least(spot, n - 5) - greatest(0, spot - 4) + 1 AS BIGINT) AS changed, 0::BIGINT AS outside FROM m""")
def single_edit_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One substitution in the middle of every document of 20 tokens and more."""
    t = tokenized(spark, sf_dir).where(F.size("tokens") >= 20)
    at = F.floor(F.size("tokens") / 2).cast("int")
    pairs = t.select(F.col("doc_id").alias("pair"), F.col("tokens").alias("a"), F.transform("tokens", lambda x, i: F.when(i == at, F.lit(-1).cast("long")).otherwise(x)).alias("b"), at.alias("pos"))
    diffs = align.window_diffs(align.aligned(pairs), 5)
    return reports.mechanism(diffs, pairs, 5)


@query(f"""WITH {_TOK}, n AS (SELECT doc_id AS pair, len(tokens) AS n, len(tokens) // 2 AS spot FROM tok WHERE len(tokens) >= 20)
SELECT pair, CAST(n - 4 - spot AS BIGINT) AS behind, CAST(n - 4 - spot AS BIGINT) AS preserved, CAST(n - 4 - spot AS BIGINT) AS shifted FROM n""")
def suffix_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token put in the middle: all windows behind it stay, one place further on."""
    t = tokenized(spark, sf_dir).where(F.size("tokens") >= 20)
    at = F.floor(F.size("tokens") / 2).cast("int")
    b = F.concat(F.slice("tokens", 1, at), F.array(F.lit(-1).cast("long")), F.slice("tokens", at + 1, F.size("tokens")))
    pairs = t.select(F.col("doc_id").alias("pair"), F.col("tokens").alias("a"), b.alias("b"), at.alias("pos"))
    return reports.suffix_check(align.window_diffs(align.aligned(pairs), 5), pairs, 1)


@query(f"""WITH {_hashed(SIGNAL.start)}, c AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, gram[1:4] ORDER BY pos) <= 64, false) AS repeated FROM win)
SELECT m.doc_id, m.pos FROM masked m JOIN c ON c.doc_id = m.doc_id AND c.pos = m.pos WHERE m.valid = c.repeated""")
def mask_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose mask by hashes isn't the one by the tokens themselves: none are expected."""
    t = tokenized(spark, sf_dir)
    by_hash = windows.signal_windows(t, spark, SIGNAL).select("doc_id", "pos", "context_ok")
    return by_hash.join(windows.exact_context_repeats(t, 5, 64), ["doc_id", "pos"]).where("context_ok = repeated").select("doc_id", "pos")


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)?)') AS w FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END AS INT) AS distance, CASE WHEN len(w) > 0 THEN 1 / len(w) ELSE 0 END AS rate, CASE WHEN len(w) > 0 THEN 0.25 / (1 / len(w)) END AS leverage FROM w""")
def word_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves without their first word: what one edit costs in words, and a fixed gain for that cost."""
    t = table(spark, sf_dir, "conversations")
    first = F.regexp_replace("text", "^[^A-Za-z0-9]*[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?", "")
    told = t.select("conv_id", "turn", align.word_distance(F.col("text"), first).alias("distance"), F.size(content_words(F.coalesce("text", F.lit("")))).alias("n"))
    rate = align.edit_rate(F.col("distance"), F.col("n"))
    return told.select("conv_id", "turn", "distance", rate.alias("rate"), align.leverage(F.lit(0.25), rate).alias("leverage"))


@query()
def counterfactual_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and what is left of them without the letter of their role's end: distinct pairs are evaluated once."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("source_text"), F.translate(F.coalesce("text", F.lit("")), "q", "").alias("output_text"))
    return align.counterfactuals(t, spark, SIGNAL, keep=("conv_id", "turn"))


@query("""SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS distance, CASE WHEN length(p_type) > 0 THEN least(1.0, levenshtein(p_name, p_type) / length(p_type)) ELSE CAST(levenshtein(p_name, p_type) > 0 AS DOUBLE) END AS rate FROM part""")
def char_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = align.char_distance(F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("distance"), align.edit_rate(d, F.length("p_type")).alias("rate"))


# --- intervals ---------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 10
    return li.select("l_orderkey", F.col("l_linenumber").alias("id"), start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


_SPANS = "SELECT l_orderkey, l_linenumber AS id, CAST(l_linenumber * 10 AS BIGINT) AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS e FROM lineitem"


@query(f"""WITH i AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, CAST(sum(e - s) AS BIGINT) AS covered FROM (SELECT l_orderkey, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) GROUP BY l_orderkey""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_size(_lines(spark, sf_dir), ("l_orderkey",))


@query(f"WITH i AS ({_SPANS}) SELECT a.l_orderkey, a.id AS a_id, b.id AS b_id FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.id < b.id AND a.s < b.e AND b.s < a.e")
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = intervals.conflicts(_lines(spark, sf_dir), ("l_orderkey",))
    return c.select("l_orderkey", F.col("id").alias("a_id"), F.col("b_id"))


@query(f"""WITH i AS ({_SPANS}), l AS (SELECT l_orderkey, count(*) AS candidates, list({{'n': 0::BIGINT, 'at': e, 's': s}} ORDER BY e, s) AS r FROM i GROUP BY 1),
t AS (SELECT l_orderkey, candidates, list_reduce(list_prepend({{'n': 0::BIGINT, 'at': -1::BIGINT, 's': 0::BIGINT}}, r), lambda a, x: CASE WHEN x.s >= a['at'] THEN {{'n': a.n + 1, 'at': x['at'], 's': 0::BIGINT}} ELSE a END).n AS independent FROM l)
SELECT *, CASE WHEN independent >= 4 THEN 'READY' ELSE 'SCARCE' END AS status FROM t""")
def independent_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.independent_count(_lines(spark, sf_dir), ("l_orderkey",))


@query(f"""WITH {_TOK} SELECT doc_id, CAST(sum(least(pos + 1, n) - greatest(0, pos - 4)) AS BIGINT) AS touched
FROM (SELECT doc_id, greatest(0, len(tokens) - 4) AS n, unnest(range(0, len(tokens))) AS pos FROM tok) WHERE n > 0 GROUP BY doc_id""")
def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenized(spark, sf_dir).select("doc_id", windows.n_windows(F.col("tokens"), 5).cast("long").alias("windows"), F.posexplode("tokens").alias("pos", "t")).where("windows > 0")
    each = intervals.of_tokens(t.withColumn("pos", F.col("pos").cast("long")), 5)
    return each.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("touched"))


# --- protected content -------------------------------------------------------------------------------


@query()
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spans.raw_spans(table(spark, sf_dir, "documents"))
    return spans.protected(raw).select("doc_id", "start", "end", F.concat_ws("+", "kinds").alias("kinds"))


_ADDRESSES = r"""list_filter(string_split_regex(t, '[^0-9.]+'), lambda x: regexp_full_match(x, '(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}') AND len(list_filter(string_split(x, '.'), lambda y: TRY_CAST(y AS INT) > 255)) = 0)"""
_MAILS = r"""regexp_extract_all(t, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')"""


@query(f"""WITH d AS (SELECT doc_id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(sum(len({_ADDRESSES})) AS BIGINT) AS addresses, CAST(sum(len({_MAILS})) AS BIGINT) AS mails FROM d GROUP BY doc_id HAVING sum(len({_ADDRESSES})) + sum(len({_MAILS})) > 0""")
def content_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses and mail addresses protected content holds."""
    raw = spans.raw_spans(table(spark, sf_dir, "documents"), kinds=("IPV4", "EMAIL"))
    return raw.groupBy("doc_id").agg(F.count_if(F.col("kind") == "IPV4").alias("addresses"), F.count_if(F.col("kind") == "EMAIL").alias("mails"))


@query(f"""WITH d AS (SELECT doc_id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, unnest({_ADDRESSES}) AS v FROM d UNION ALL SELECT doc_id, unnest({_MAILS}) FROM d), c AS (SELECT doc_id, v, count(*) AS had FROM v GROUP BY ALL)
SELECT doc_id, CAST(sum(CASE WHEN contains(v, '7') THEN had ELSE 0 END) AS BIGINT) AS lost, round(sum(CASE WHEN contains(v, '7') THEN 0 ELSE had END) / sum(had), 9) AS kept_fraction FROM c GROUP BY doc_id""")
def address_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with every address that has a 7 taken away: what protected content loses."""
    raw = spans.raw_spans(table(spark, sf_dir, "documents"), kinds=("IPV4", "EMAIL"))
    return rounded(spans.violations(raw, raw.where("NOT contains(value, '7')"), "doc_id"), 9, "kept_fraction").select("doc_id", "lost", "kept_fraction")


@query()
def protected_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself without its digits 7: what protected content that loses."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    before, after = spans.raw_spans(d), spans.raw_spans(d.withColumn("text", F.translate("text", "7", "")))
    return spans.violations(before, after, "doc_id")


def _listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _mapped(pairs) -> str:
    return "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v + "'" for k, v in pairs) + "}"


_SIGNATURES = f"""w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(replace(text, '’', chr(39))), '[a-z]+(?:''[a-z]+)?') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, w[i] AS x, w[i + 1] AS next_, CASE WHEN i > 1 THEN w[i - 1] END AS last_ FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
m AS MATERIALIZED (SELECT *, {_mapped((k, v) for k, (v, _) in spans.CONTRACTED.items())}[x] AS short, {_mapped((k, m) for k, (_, m) in spans.CONTRACTED.items() if m)}[x] AS short_modal,
  coalesce(x IN {_listed(spans.AUXILIARIES)} AND next_ = 'not', false) AS negated, coalesce(last_ IN {_listed(spans.AUXILIARIES)}, false) AS helped, coalesce(next_ = 'to', false) AS to_ FROM p),
n AS (SELECT doc_id, i, CASE WHEN short IS NOT NULL THEN short WHEN x = 'cannot' THEN 'can:not' WHEN negated THEN x || ':not' WHEN x = 'not' AND NOT helped THEN 'not' WHEN x IN {_listed(spans.NEGATIONS)} THEN x END AS neg,
  CASE WHEN short IS NOT NULL THEN short_modal WHEN x = 'cannot' THEN 'can' WHEN negated THEN {_mapped((k, m) for k, m in spans.AUXILIARIES.items() if m)}[x]
    ELSE nullif(concat_ws(',', CASE WHEN x IN {_listed(spans.MODALS)} THEN x END, CASE WHEN x IN {_listed(spans.OBLIGATIONS)} THEN 'obligation:' || x END, CASE WHEN x IN {_listed(spans.PERMISSIONS)} THEN 'permission:' || x END,
      CASE WHEN x = 'have' AND to_ THEN 'obligation:have_to' END, CASE WHEN x = 'need' AND to_ THEN 'obligation:need_to' END), '') END AS modal FROM m)"""


@query(f"""WITH {_SIGNATURES} SELECT doc_id, coalesce(g.negations, '') AS negations, coalesce(g.modalities, '') AS modalities FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(neg, ',' ORDER BY i) AS negations, string_agg(modal, ',' ORDER BY i) AS modalities FROM n GROUP BY doc_id) g USING (doc_id)""")
def invariant_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.signature(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.concat_ws(",", "s.negations").alias("negations"), F.concat_ws(",", "s.modalities").alias("modalities"))


@query()
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rules = spark.createDataFrame([("version", r"(?i)\bversion\b"), ("number", r"\d+"), ("license", r"(?i)\blicen[cs]ed?\b")], "rule string, pattern string")
    told = spans.candidates(spans.rule_matches(d, rules), spans.protected(spans.raw_spans(d)))
    return told.groupBy("rule", "reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256('9|' || doc_id) AS order_hash, ('0x' || right(sha256('9|' || doc_id), 2))::INT % 2 = 1 AS swapped FROM documents ORDER BY order_hash LIMIT 40")
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.review_packet(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 40, 9)


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, CAST(sum(votes) AS BIGINT) AS reviewers, max(votes) AS most, arg_max(l_returnflag, votes) AS verdict FROM v GROUP BY l_orderkey)
SELECT l_orderkey, reviewers, CASE WHEN reviewers IN (2, 3) AND most >= 2 THEN verdict END AS verdict, CASE WHEN NOT (reviewers IN (2, 3) AND most >= 2) THEN 'NO_MAJORITY' END AS problem FROM b""")
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.adjudicated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""SELECT l_shipdate_month AS rule, n AS reviews, rate, CASE WHEN n < 50 THEN 'TOO_FEW_REVIEWS' WHEN rate < 0.5 THEN 'BELOW_RATE' ELSE 'READY' END AS status
FROM (SELECT CAST(month(l_shipdate) AS INT) AS l_shipdate_month, count(*) AS n, round(avg(CAST(l_returnflag = 'N' AS INT)), 9) AS rate FROM lineitem GROUP BY 1)""")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("rule"), (F.col("l_returnflag") == "N").alias("good"))
    return spans.rule_audit(r, "rule", "good", share=0.5).withColumn("rate", F.round("rate", 9))


# --- calibration -------------------------------------------------------------------------------------


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_linestatus", "l_extendedprice")


_RATES = (0.05, 0.01)
_THRESHOLDS = """WITH v AS (SELECT l_linestatus, l_extendedprice AS x, count(*) AS same FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
o AS (SELECT *, CAST(sum(same) OVER (PARTITION BY l_linestatus) AS BIGINT) AS n,
      CAST(coalesce(sum(same) OVER (PARTITION BY l_linestatus ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS over FROM v),
t AS (SELECT l_linestatus, target, n, min(x) AS threshold, arg_min(over, x) AS false_positives FROM o, (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) r(target) WHERE over <= target * n GROUP BY ALL)"""


@query(_THRESHOLDS + " SELECT l_linestatus, target, n, threshold, false_positives, false_positives / n AS achieved FROM t")
def fpr_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.thresholds(_negatives(spark, sf_dir), ("l_linestatus",), "l_extendedprice", _RATES)


@query(_THRESHOLDS.replace("WITH", "WITH RECURSIVE", 1) + f""", {_intervals('t', 'false_positives', 'n')},
x AS (SELECT l_linestatus, l_extendedprice AS x FROM lineitem WHERE l_returnflag <> 'R'),
m AS (SELECT l_linestatus, median(x) AS centre, quantile_disc(x, 0.75) - quantile_disc(x, 0.25) AS iqr FROM x GROUP BY 1),
s AS (SELECT l_linestatus, centre, coalesce(nullif(median(abs(x - centre)) * 1.482602218505602, 0), nullif(any_value(iqr) / 1.3489795003921634, 0)) AS scale FROM x JOIN m USING (l_linestatus) GROUP BY ALL)
SELECT t.l_linestatus, target, t.n, threshold, false_positives, round(false_positives / t.n, 9) AS achieved, ci_low, ci_high, round(centre, 6) AS centre, round(scale, 6) AS scale,
CASE WHEN scale IS NULL THEN 'NO_SPREAD' ELSE 'OK' END AS status, CASE WHEN t.n >= ceil(1 / target) THEN 'OK' ELSE 'TOO_FEW_NEGATIVES' END AS resolution
FROM t JOIN ci ON ci.k = false_positives AND ci.n = t.n JOIN s USING (l_linestatus)""")
def calibration_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = calibrate.calibrate(_negatives(spark, sf_dir), ("l_linestatus",), "l_extendedprice", _RATES)
    return rounded(rounded(told, 6, "ci_low", "ci_high", "centre", "scale"), 9, "achieved")


@query("""WITH x AS (SELECT l_linestatus, l_extendedprice AS x FROM lineitem WHERE l_returnflag <> 'R'),
m AS (SELECT l_linestatus, count(*) AS n, median(x) AS centre FROM x GROUP BY 1)
SELECT l_linestatus, n, round(centre, 6) AS centre, round(median(abs(x - centre)) * 1.482602218505602, 6) AS scale FROM x JOIN m USING (l_linestatus) GROUP BY ALL""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = calibrate.robust(_negatives(spark, sf_dir), ("l_linestatus",), "l_extendedprice")
    return r.select("l_linestatus", "n", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


@query("""SELECT l_linestatus, quantile_disc(l_extendedprice, 0.25) AS disc, round(quantile_cont(l_extendedprice, 0.25), 6) AS linear FROM lineitem GROUP BY 1""")
def two_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    disc = calibrate.quantile_disc(li, ["l_linestatus"], "l_extendedprice", 0.25, "disc")
    return disc.join(li.groupBy("l_linestatus").agg(F.round(calibrate.quantile_linear("l_extendedprice", 0.25), 6).alias("linear")), "l_linestatus")


@query(_THRESHOLDS.replace("WITH", "WITH RECURSIVE", 1) + f""", d AS (SELECT l.l_linestatus, target, l_extendedprice > threshold AS positive FROM lineitem l JOIN t USING (l_linestatus) WHERE l_returnflag = 'R'),
b AS (SELECT l_linestatus, target, count(*) AS n, count(*) FILTER (positive) AS detected FROM d GROUP BY ALL), {_intervals('b', 'detected', 'n')}
SELECT l_linestatus, target, b.n, detected, round(detected / b.n, 9) AS rate, ci_low, ci_high, CASE WHEN detected / b.n >= 0.04 THEN 'PASS' ELSE 'FAIL' END AS status FROM b JOIN ci ON ci.k = detected AND ci.n = b.n""")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = calibrate.calibrate(_negatives(spark, sf_dir), ("l_linestatus",), "l_extendedprice", _RATES)
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    told = calibrate.decide(rows, cut, ("l_linestatus",), "l_extendedprice")
    return rounded(rounded(calibrate.baseline(told, ("l_linestatus",), floor=0.04), 6, "ci_low", "ci_high"), 9, "rate")


_FROZEN = _THRESHOLDS.replace("WITH", "WITH RECURSIVE", 1).replace("WHERE l_returnflag <> 'R'", "WHERE l_returnflag <> 'R' AND l_orderkey % 2 = 0").replace("AND 1 PRECEDING), 0)", "AND CURRENT ROW), 0)")


@query(_FROZEN + f""", b AS (SELECT l_linestatus, target, threshold, count(*) AS n, count(*) FILTER (l_extendedprice >= threshold) AS false_positives FROM lineitem JOIN (SELECT l_linestatus, target, threshold FROM t) USING (l_linestatus)
  WHERE l_returnflag <> 'R' AND l_orderkey % 2 = 1 GROUP BY ALL), {_intervals('b', 'false_positives', 'n')}
SELECT l_linestatus, target, threshold, b.n, false_positives, round(false_positives / b.n, 9) AS rate, ci_low, ci_high, CASE WHEN b.n >= 1000 THEN 'OK' ELSE 'TOO_FEW_ROWS' END AS status
FROM b JOIN ci ON ci.k = false_positives AND ci.n = b.n""")
def audited_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen on orders with even keys, measured again on odd ones."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linestatus", "l_extendedprice")
    registry = calibrate.thresholds(li.where("l_orderkey % 2 = 0"), ("l_linestatus",), "l_extendedprice", _RATES, strict=False)
    told = calibrate.audit(registry, li.where("l_orderkey % 2 = 1"), ("l_linestatus",), "l_extendedprice")
    return rounded(rounded(told, 6, "ci_low", "ci_high"), 9, "rate")


@query("""SELECT lang, count(*) AS n, min(n_chars) AS low, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75,
max(n_chars) AS high, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars) / avg(n_chars), 6) AS cv FROM documents GROUP BY lang""")
def count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = calibrate.distribution(table(spark, sf_dir, "documents"), ("lang",), "n_chars")
    return d.select("lang", "n", "low", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "high", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


@query("""WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents GROUP BY lang)
SELECT x.lang AS lang, y.lang AS other, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / least(x.b - x.a, y.b - y.a), 6) AS overlap FROM q x JOIN q y ON x.lang < y.lang""")
def iqr_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = calibrate.distribution(table(spark, sf_dir, "documents"), ("lang",), "n_chars").select("lang", "q25", "q75")
    o = d.select(F.col("lang").alias("other"), F.col("q25").alias("a"), F.col("q75").alias("b"))
    ov = calibrate.iqr_overlap(F.col("q25"), F.col("q75"), F.col("a"), F.col("b"))
    return d.join(o, F.col("lang") < F.col("other")).select("lang", "other", F.round(ov, 6).alias("overlap"))


@query("SELECT CAST(CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 2000 THEN 1 WHEN n_chars <= 8000 THEN 2 ELSE 3 END AS INT) AS regime, count(*) AS n FROM documents GROUP BY 1")
def regime_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(calibrate.regime(F.col("n_chars"), (500, 2000, 8000)).alias("regime"))
    return d.groupBy("regime").agg(F.count("*").alias("n"))


# --- evaluation --------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT l_linestatus, l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY l_linestatus ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT l_linestatus, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 9) AS auc FROM b GROUP BY l_linestatus""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_returnflag") == "R")
    return evaluate.auc(li, ("l_linestatus",), "l_extendedprice", "pos").withColumn("auc", F.round("auc", 9))


@query("""WITH o AS (SELECT o_orderpriority, 'ALL' AS population, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderpriority, 'LARGE', o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 150000),
f AS (SELECT o_orderpriority, count(*) AS failed FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
c AS (SELECT o_orderpriority, population, count(*) AS analysed, round(avg(o_totalprice), 4) AS mean_price FROM o GROUP BY ALL)
SELECT o_orderpriority, population, analysed, mean_price, coalesce(failed, 0) AS failed, analysed + coalesce(failed, 0) AS expected,
CASE WHEN coalesce(failed, 0) > 0 THEN 'INCOMPLETE_FAILURE_ROWS' ELSE 'COMPLETE' END AS status FROM c LEFT JOIN f USING (o_orderpriority)""")
def condition_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    told = evaluate.cells(
        o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), ("o_orderpriority",),
        {"mean_price": F.col("o_totalprice")}, {"ALL": F.lit(True), "LARGE": F.col("o_totalprice") >= 150000},
    )
    return told.withColumn("mean_price", F.round("mean_price", 4)).select("o_orderpriority", "population", "analysed", "mean_price", "failed", "expected", "status")


@query("""WITH l AS (SELECT l_suppkey, l_extendedprice AS y, 'l_quantity' AS predictor, l_quantity AS x FROM lineitem UNION ALL SELECT l_suppkey, l_extendedprice, 'l_discount', l_discount FROM lineitem),
s AS (SELECT predictor, l_suppkey, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM l GROUP BY ALL),
r AS (SELECT predictor, l_suppkey, sum(n) OVER w - n AS n, sum(sx) OVER w - sx AS sx, sum(sy) OVER w - sy AS sy, sum(sxx) OVER w - sxx AS sxx, sum(sxy) OVER w - sxy AS sxy FROM s WINDOW w AS (PARTITION BY predictor)),
f AS (SELECT *, CASE WHEN n * sxx - sx * sx > 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END AS slope FROM r WHERE n > 0),
e AS (SELECT l.predictor, count(*) AS n, sqrt(avg((y - (sy - slope * sx) / f.n - slope * x) ** 2)) AS rmse FROM l JOIN f USING (predictor, l_suppkey) GROUP BY 1)
SELECT predictor, n, round(rmse, 3) AS rmse, rmse <= min(rmse) OVER () + 1e-12 AS selected FROM e""")
def predictor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.leave_one_out_fit(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", ("l_quantity", "l_discount"))
    return r.withColumn("rmse", F.round("rmse", 3))


@query("""WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
c AS (SELECT l_quantity - mx AS a, l_extendedprice - my AS b FROM lineitem JOIN m USING (l_suppkey))
SELECT count(*) AS n, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS correlation FROM c""")
def centred_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.centred_correlation(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return r.withColumn("correlation", F.round("correlation", 9))


@query("""WITH b AS (SELECT CAST(CASE WHEN l_discount * 10 < 0.1 THEN 0 WHEN l_discount * 10 < 0.25 THEN 1 WHEN l_discount * 10 < 0.5 THEN 2 WHEN l_discount * 10 < 0.75 THEN 3 ELSE 4 END AS INT) AS bin, l_extendedprice AS y FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1),
g AS (SELECT bin, count(*) AS n, avg(y) AS mean FROM b GROUP BY 1 UNION ALL SELECT -1, count(*), avg(l_extendedprice) FROM lineitem WHERE NOT l_discount * 10 BETWEEN 0 AND 1),
d AS (SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, mean FROM range(-1, 5) r(i) LEFT JOIN g ON g.bin = r.i)
SELECT bin, n, round(mean, 4) AS mean, coalesce(mean < last_value(CASE WHEN bin >= 0 THEN mean END IGNORE NULLS) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS falls FROM d""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("dose"), "l_extendedprice")
    return evaluate.dose_response(li, "dose", "l_extendedprice").select("bin", "n", F.round("mean", 4).alias("mean"), "falls")


@query("""WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS sources, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS sd, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 4) AS iqr FROM m GROUP BY 1""")
def source_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.mean_of_means(table(spark, sf_dir, "lineitem"), ("l_returnflag",), "l_suppkey", "l_extendedprice")
    return r.select("l_returnflag", "sources", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "iqr")])


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS difference FROM lineitem
GROUP BY 1 HAVING count(*) FILTER (l_linestatus = 'F') > 0 AND count(*) FILTER (l_linestatus = 'O') > 0""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.paired(table(spark, sf_dir, "lineitem"), ("l_suppkey",), "l_linestatus", "F", "O", "l_quantity")
    return r.select("l_suppkey", F.round("difference", 6).alias("difference"))


_DID = "(avg(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') - avg(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'O')) - (avg(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') - avg(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'O'))"


@query(f"SELECT l_suppkey, round({_DID}, 6) AS effect FROM lineitem GROUP BY 1 HAVING {_DID} IS NOT NULL")
def control_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.difference_in_differences(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_linestatus", ("R", "A"), ("F", "O"), "l_quantity")
    return r.withColumn("effect", F.round("effect", 6))


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'l_linenumber' END AS stratum,
coalesce(CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus ELSE CAST(l_linenumber AS VARCHAR) END) AS value,
count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))""")
def stratified_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.battery(table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber"), {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")})
    return r.select("stratum", "value", "n", *[F.round(c, 6).alias(c) for c in ("mean_quantity", "mean_discount")])


@query("""WITH e AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT v, unnest(range(len(v))) AS i FROM e), q AS (SELECT v, i, unnest(range(len(v))) AS j FROM p)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS n, round(covar_samp(v[i + 1], v[j + 1]), 9) AS covariance FROM q GROUP BY i, j""")
def depth_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return evaluate.depth_covariance(e, "v").withColumn("covariance", F.round("covariance", 9))


@query("""SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS "both", count(*) FILTER (l_quantity > 25 AND NOT l_discount > 0.05) AS lost,
count(*) FILTER (NOT l_quantity > 25 AND l_discount > 0.05) AS gained, count(*) FILTER (NOT l_quantity > 25 AND NOT l_discount > 0.05) AS neither FROM lineitem GROUP BY 1""")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns({"before": F.col("l_quantity") > 25, "after": F.col("l_discount") > 0.05})
    return evaluate.transitions(li, ("l_linestatus",), "before", "after")


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey))
SELECT o_orderpriority, CAST(least(3, i * 4 // n) AS INT) AS quartile, count(*) AS n FROM r GROUP BY ALL""")
def repetition_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = evaluate.quartiles(table(spark, sf_dir, "orders"), "o_orderpriority", ("o_totalprice", "o_orderkey"))
    return q.groupBy("o_orderpriority", "quartile").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem)
SELECT l_orderkey, count(*) AS n, CAST(sum(abs(a - b)) AS BIGINT) AS displaced, bool_or(a = 1 AND b = 1) AS same_first, round(CASE WHEN count(*) >= 2 THEN 1 - 6 * sum((a - b) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE ** 2 - 1)) END, 9) AS spearman FROM r GROUP BY 1""")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    r = evaluate.spearman(li, ("l_orderkey",), "l_quantity", "l_extendedprice", "id")
    return r.withColumns({"spearman": F.round("spearman", 9), "displaced": F.col("displaced").cast("long")})


@query("SELECT o_orderstatus, n, x AS threshold FROM (SELECT o_orderstatus, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r = floor(0.05 * n) + 1")
def control_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kth_largest(table(spark, sf_dir, "orders"), ("o_orderstatus",), "o_totalprice", 0.05)


@query("""SELECT p_partkey, p_brand FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pareto(table(spark, sf_dir, "part"), ("p_brand",), "p_retailprice", "p_size").select("p_partkey", "p_brand")


@query("""WITH f AS (SELECT l_suppkey, l_linenumber, avg(l_discount) AS g, avg(l_extendedprice) AS c FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(round(g, 9) - lag(round(g, 9)) OVER w < 0.01 AND round(c, 6) > lag(round(c, 6)) OVER w, false) AS flat FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber)),
t AS (SELECT l_suppkey, flat AND coalesce(lag(flat) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber), false) AS twice FROM b) SELECT l_suppkey, bool_or(twice) AS saturated FROM t GROUP BY 1""")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg("l_discount"), 9).alias("g"), F.round(F.avg("l_extendedprice"), 6).alias("c"))
    return evaluate.saturation(li, ("l_suppkey",), "l_linenumber", "g", "c")


# --- reports -----------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_tax > 0.03 THEN 'WORDS' END, CASE WHEN l_discount > 0.015 THEN 'CHARACTERS' END,
CASE WHEN NOT (1 + l_tax - l_discount BETWEEN 0.97 AND 1.03) THEN 'LENGTH' END) AS reasons FROM lineitem""")
def visible_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = reports.visible_cost("STRICT", F.col("l_tax"), F.col("l_discount"), 1 + F.col("l_tax") - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", reasons).alias("reasons"))


@query("SELECT doc_id, substr(text, 1, 3) || 'X' || substr(text, 6, 4) || substr(text, 12) AS output FROM documents WHERE length(text) >= 20")
def replayed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((3, 5, "X"), (9, 11, ""))])
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 20)
    return d.select("doc_id", reports.replayed(F.col("text"), ops).alias("output"))


@query("""SELECT o_orderpriority, o_orderstatus, a AS first, b AS second, b - a AS delta, CASE WHEN b IS NULL THEN 'ONLY_FIRST' WHEN a IS NULL THEN 'ONLY_SECOND' END AS problem
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
FULL JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS b FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) USING (o_orderpriority, o_orderstatus)""")
def replication_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("o_orderpriority", "o_orderstatus")
    a, b = (table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == k).groupBy(*keys).agg(F.count("*").alias("n")) for k in (0, 1))
    return reports.replication(a, b, keys, "n")


@query("""SELECT count(*) AS n, count(*) FILTER (sign(l_discount - 0.05) = sign(l_tax - 0.04)) AS agree, round(avg(l_discount - 0.05), 9) AS mean_a, round(avg(l_tax - 0.04), 9) AS mean_b,
round(corr(l_discount - 0.05, l_tax - 0.04), 6) AS correlation FROM lineitem""")
def adapter_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("a"), (F.col("l_tax") - 0.04).alias("b"))
    t = reports.transfer(li, "a", "b")
    return t.select("n", "agree", F.round("mean_a", 9).alias("mean_a"), F.round("mean_b", 9).alias("mean_b"), F.round("correlation", 6).alias("correlation"))


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS controls, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL HAVING count(*) >= 8)
SELECT l_suppkey, l_linenumber, count(*) AS n, round(avg(l_discount - m), 9) AS advantage FROM lineitem JOIN c USING (l_suppkey, l_linenumber) WHERE l_returnflag = 'R' GROUP BY ALL""")
def matched_cost_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, keys = table(spark, sf_dir, "lineitem"), ("l_suppkey", "l_linenumber")
    told = reports.matched_cost(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'N'"), keys, "l_discount")
    return told.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("advantage"), 9).alias("advantage"))


@query("""SELECT l_returnflag, count(*) AS pairs, count(*) FILTER (l_discount > 0.05) AS gained, count(*) FILTER (l_discount > 0.05 AND l_quantity > 25) AS gained_and_dropped,
round(avg(l_quantity - 25) FILTER (l_discount > 0.05), 6) AS mean_drop FROM lineitem GROUP BY 1""")
def post_selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.round(F.col("l_discount") * 100) - 5).alias("gain"), (F.col("l_quantity") - 25).alias("drop"))
    r = reports.post_selection(li, "l_returnflag", "gain", "drop")
    return r.select("l_returnflag", "pairs", "gained", "gained_and_dropped", F.round("mean_drop", 6).alias("mean_drop"))


@query("""SELECT pair, 2 AS tokenizers, least(a, b) AS least, greatest(a, b) AS most, least(a, b) > 0 AS changed_by_all, a <> b AS metrics_differ
FROM (SELECT p_partkey AS pair, CAST(levenshtein(p_name, p_brand) AS INT) AS a, CAST(levenshtein(lower(p_name), lower(p_brand)) AS INT) AS b FROM part)""")
def tokenizer_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = [p.select(F.col("p_partkey").alias("pair"), F.lit(name).alias("tokenizer"), F.levenshtein(f("p_name"), f("p_brand")).alias("d"), F.length("p_name").alias("a"), F.length("p_brand").alias("b")) for name, f in (("exact", F.col), ("lower", F.lower))]
    told = reports.differential(rows[0].unionByName(rows[1]), "pair", "tokenizer", "d", "a", "b")
    return told.select("pair", F.col("tokenizers").cast("int").alias("tokenizers"), "least", "most", "changed_by_all", "metrics_differ")


@query(f"""WITH RECURSIVE b AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount >= 0.095) AS good FROM lineitem GROUP BY ALL), {_intervals('b', 'good', 'n')}
SELECT l_returnflag, l_linestatus, b.n, good, round(good / b.n, 9) AS rate, ci_low, ci_high FROM b JOIN ci ON ci.k = good AND ci.n = b.n""")
def blind_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("good", F.col("l_discount") >= 0.095)
    return rounded(rounded(reports.favourable(li, ("l_returnflag", "l_linestatus"), "good"), 6, "ci_low", "ci_high"), 9, "rate")


@query("""SELECT * FROM (VALUES ('windows', '', 0), ('scores', 'windows', 1), ('pairs', 'windows', 1), ('calibration', 'scores', 2), ('survival', 'pairs', 2), ('detectability', 'calibration', 3),
('controls', 'calibration,pairs', 3), ('predictors', 'survival,scores', 3), ('dose', 'survival,scores', 3), ('spacing', 'dose', 4), ('batteries', 'detectability,survival', 4)) t(step, needs, level)""")
def step_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.registry(spark).withColumn("needs", F.concat_ws(",", "needs"))


# --- inference ---------------------------------------------------------------------------------------


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_suppkey").agg((F.avg("l_discount") - 0.05).alias("effect"))


_EFFECTS = "e AS MATERIALIZED (SELECT l_returnflag, l_suppkey, avg(l_discount) - 0.05 AS effect FROM lineitem GROUP BY ALL)"


def _paired_p(a: str, b: str) -> str:
    tail = _tail(f"least({a}, {b})", f"({a} + {b})", "0.5")
    return f"round(CASE WHEN {a} + {b} = 0 THEN 1 ELSE least(1.0, 2 * {tail}) END, 9)"


@query(f"""WITH t AS (SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS "both", count(*) FILTER (l_quantity > 25 AND NOT l_discount > 0.05) AS lost,
count(*) FILTER (NOT l_quantity > 25 AND l_discount > 0.05) AS gained, count(*) FILTER (NOT l_quantity > 25 AND NOT l_discount > 0.05) AS neither FROM lineitem GROUP BY 1)
SELECT *, {_paired_p('lost', 'gained')} AS p FROM t""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(infer.mcnemar(transition_counts(spark, sf_dir)), 9, "p")


@query(f"""WITH {_EFFECTS}, t AS (SELECT l_returnflag, count(*) FILTER (effect > 0) AS up, count(*) FILTER (effect < 0) AS down FROM e GROUP BY 1)
SELECT *, {_paired_p('down', 'up')} AS p FROM t""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of the exact means of the doubles; sums in the order of rows would leave those next to 0.05 to chance."""
    effects = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(infer.mean_less("l_discount", 0.05).alias("effect"))
    return rounded(infer.sign_test(effects, ("l_returnflag",), "effect"), 9, "p")


@query("""WITH p AS (SELECT p_partkey, (p_retailprice % 100) / 5000 AS p FROM part),
r AS (SELECT *, least(1.0, (1000000 - row_number() OVER (ORDER BY p, p_partkey) + 1) * p) AS raw FROM p)
SELECT p_partkey, round(max(raw) OVER (ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family of a million fixed in advance, of which the table has some."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 100 / 5000).alias("p"))
    told = infer.holm(p, "p", 1_000_000, order=("p", "p_partkey"))
    return told.select("p_partkey", F.round("p_holm", 9).alias("p_holm"))


@query(f"""WITH e AS MATERIALIZED (SELECT l_returnflag, l_linestatus AS s, l_suppkey, avg(l_discount) - 0.05 AS v FROM lineitem GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s, v) AS draw, row_number() OVER (PARTITION BY l_returnflag, s ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY l_returnflag, s) AS size FROM e),
seeds AS MATERIALIZED (SELECT l_returnflag, r, {_seed("'1'", 'l_returnflag', 'r')} AS seed FROM (SELECT DISTINCT l_returnflag FROM e), range(1000) x(r)),
d AS (SELECT l_returnflag, r, s, CAST({_splitmix('seed', 'draw')} % size AS BIGINT) AS place FROM seeds JOIN o USING (l_returnflag)),
m AS (SELECT l_returnflag, r, avg(v) AS m FROM d JOIN o USING (l_returnflag, s, place) GROUP BY ALL),
q AS (SELECT l_returnflag, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT l_returnflag, n, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM q JOIN (SELECT l_returnflag, count(*) AS n, avg(v) AS mean FROM e GROUP BY 1) USING (l_returnflag)""")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' effects, resampled within line statuses."""
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg((F.avg("l_discount") - 0.05).alias("effect"))
    return rounded(infer.bootstrap_mean(e, ("l_returnflag",), ("l_linestatus",), "effect"), 9, "mean", "low", "high")


@query()
def bootstrap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.bootstrap_sources(_effects(spark, sf_dir), ("l_returnflag",), "effect")


_PRICES = "SELECT l_linestatus, l_suppkey, avg(l_extendedprice) AS v, avg(l_discount) > 0.05 AS y FROM lineitem GROUP BY ALL"


@query(f"""WITH e AS MATERIALIZED ({_PRICES}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY y, v) AS draw, row_number() OVER (PARTITION BY l_linestatus, y ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY l_linestatus, y) AS size FROM e),
seeds AS MATERIALIZED (SELECT l_linestatus, r, {_seed("'1'", 'l_linestatus', 'r')} AS seed FROM (SELECT DISTINCT l_linestatus FROM e), range(1000) x(r)),
d AS (SELECT l_linestatus, r, y, CAST({_splitmix('seed', 'draw')} % size AS BIGINT) AS place FROM seeds JOIN o USING (l_linestatus)),
x AS (SELECT l_linestatus, r, v, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM d JOIN o USING (l_linestatus, y, place) GROUP BY ALL),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY l_linestatus, r ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
m AS (SELECT l_linestatus, r, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS m FROM b GROUP BY ALL),
z AS (SELECT l_linestatus, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1),
w AS (SELECT a.l_linestatus, avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS auc FROM e a JOIN e b ON a.l_linestatus = b.l_linestatus AND a.y AND NOT b.y GROUP BY 1),
n AS (SELECT l_linestatus, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM e GROUP BY 1)
SELECT l_linestatus, positives, negatives, round(auc, 9) AS auc, round(low, 9) AS low, round(high, 9) AS high FROM n LEFT JOIN w USING (l_linestatus) LEFT JOIN z USING (l_linestatus)""")
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' mean prices as scores, high discounts as labels, by line status."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(F.avg("l_extendedprice").alias("v"), (F.avg("l_discount") > 0.05).alias("y"))
    return rounded(infer.bootstrap_auc(e, ("l_linestatus",), (), "v", "y"), 9, "auc", "low", "high")


@query(f"""WITH e AS MATERIALIZED (SELECT sum(l_discount) AS s, count(l_discount) AS n, row_number() OVER (ORDER BY l_suppkey) - 1 AS k FROM lineitem GROUP BY l_suppkey),
d AS (SELECT r, CAST({_seed("'1'", 'r', 'k')} % (SELECT count(*) FROM e) AS BIGINT) AS k FROM e, range(1000) x(r)),
m AS (SELECT r, sum(s) / sum(n) AS m FROM d JOIN e USING (k) GROUP BY r), w AS (SELECT count(*) AS sources, sum(s) / sum(n) AS mean FROM e)
SELECT any_value(sources) AS sources, round(any_value(mean), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m, w""")
def bootstrap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(infer.bootstrap_clusters(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount"), 9, "mean", "low", "high")


@query(f"""WITH {_EFFECTS}, o AS (SELECT l_returnflag, list(effect ORDER BY effect) AS x FROM e GROUP BY 1),
s AS MATERIALIZED (SELECT l_returnflag, x, len(x) AS n, (len(x) + 63) // 64 AS words, list_sum(x) / len(x) AS mean, {_seed("'1'", 'l_returnflag')} AS seed FROM o),
w AS (SELECT l_returnflag, r, list_transform(range(words), lambda k: {_splitmix('seed', 'r * words + k + 1')}) AS bits, x, n, mean FROM s, range(10000) y(r)),
f AS (SELECT l_returnflag, abs(list_sum(list_transform(range(n), lambda i: x[i + 1] * (1 - 2 * CAST((bits[i // 64 + 1] >> (i % 64)::UBIGINT) & 1 AS INT)))) / n) >= abs(mean) - 1e-15 AS extreme FROM w)
SELECT l_returnflag, any_value(n) AS n, round(any_value(mean), 9) AS mean, (count(*) FILTER (extreme) + 1) / 10001 AS p FROM f JOIN s USING (l_returnflag) GROUP BY 1""")
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(infer.sign_flip(_effects(spark, sf_dir), ("l_returnflag",), "effect"), 9, "mean")


@query(f"""WITH {_EFFECTS}, o AS MATERIALIZED (SELECT effect AS v, row_number() OVER (ORDER BY effect) - 1 AS place, count(*) OVER () AS many FROM e),
t AS MATERIALIZED (SELECT size, trial, {_seed("'1'", 'size', 'trial')} AS seed FROM (VALUES (4), (8), (16), (32)) s(size), range(200) x(trial)),
a AS MATERIALIZED (SELECT size, trial, k AS place, {_splitmix('seed', 'k + 1')} % (SELECT any_value(many) FROM o) AS pick FROM (SELECT *, unnest(range(size)) AS k FROM t)),
b AS MATERIALIZED (SELECT size, trial, a.place, v FROM a JOIN o ON o.place = CAST(pick AS BIGINT)),
d AS (SELECT size, trial, k // size AS r, CAST({_splitmix('seed', 'size + k + 1')} % size AS BIGINT) AS place FROM (SELECT *, unnest(range(size * 200)) AS k FROM t)),
m AS (SELECT size, trial, r, avg(v) AS m FROM d JOIN b USING (size, trial, place) GROUP BY ALL),
h AS (SELECT size, trial, quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS hit FROM m GROUP BY ALL)
SELECT size, count(*) AS trials, avg(hit::INT) AS power, CASE WHEN avg(hit::INT) >= 0.8 THEN 'SUFFICIENT' ELSE 'UNRESOLVED' END AS status FROM h GROUP BY size""")
def power_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.power(_effects(spark, sf_dir), "effect", [4, 8, 16, 32])


# --- checks, gates and records -----------------------------------------------------------------------


@query(f"""WITH {_BITS}, s AS (SELECT doc_id, count(*) AS windows, count(*) FILTER (valid) AS valid, CASE WHEN count(*) FILTER (valid) = 0 THEN 'ZERO_VALID_WINDOWS' END AS failure,
  round(sum(g0 + g1 + g2) FILTER (valid) / nullif(count(*) FILTER (valid) * 3, 0), 9) AS raw_score, sha256(string_agg(CAST(valid AS INT)::VARCHAR || g0 || g1 || g2, ',' ORDER BY pos)) AS batch_sha256 FROM bits GROUP BY doc_id)
SELECT *, 'mean' AS detector, 'mixed' AS adapter, 3 AS depth, 'HIGHER_IS_MORE_SIGNAL' AS direction, sha256('mean|mixed|3|1,1,1') AS config_sha256 FROM s""")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL)
    return rounded(score.evidence(score.mean_scores(win, 3), win, "mean", "mixed", 3, [1.0, 1.0, 1.0]), 9, "raw_score")


@query("SELECT * FROM (VALUES ('plain', 5, 3, 64, 'mixed'), ('table', 5, 3, 64, 'table')) t(name, n, depth, history, kind)")
def adapter_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = windows.Adapters()
    known.register("plain", SIGNAL)
    known.register("table", TABLE_SIGNAL)
    return known.table(spark)


@query("""SELECT a AS adapter, d AS detector, CASE WHEN d IN ('mean', 'weighted_mean') THEN 'SUPPORTED' WHEN d = 'bayesian' THEN 'UNVERIFIED' ELSE 'UNSUPPORTED' END AS status
FROM (VALUES ('mixed'), ('table')) x(a), (VALUES ('mean'), ('weighted_mean'), ('bayesian'), ('other')) y(d)""")
def detector_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, d, score.compatibility(a, d)) for a in ("mixed", "table") for d in ("mean", "weighted_mean", "bayesian", "other")]
    return spark.createDataFrame(rows, "adapter string, detector string, status string")


@query("""WITH s AS (SELECT l_linestatus AS role, l_suppkey AS source, l_discount > 0.05 AS y FROM lineitem), b AS (SELECT role, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, count(DISTINCT source) AS sources FROM s GROUP BY 1),
h AS (SELECT source FROM s GROUP BY 1 HAVING count(DISTINCT role) > 1), c AS (SELECT role, count(DISTINCT source) AS shared_sources FROM s JOIN h USING (source) GROUP BY 1)
SELECT role, positives, negatives, sources, coalesce(shared_sources, 0) AS shared_sources, CASE WHEN coalesce(shared_sources, 0) > 0 THEN 'SHARED_SOURCES' WHEN least(positives, negatives) < 1000 THEN 'TOO_FEW_SAMPLES' ELSE 'READY' END AS status FROM b LEFT JOIN c USING (role)""")
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("role"), F.col("l_suppkey").alias("source"), (F.col("l_discount") > 0.05).alias("y"))
    return score.training_readiness(li, "role", "y", "source")


@query("""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(concat_ws('|', '=' || doc_id, coalesce('=' || text, '-'), coalesce('=' || lang, '-'), coalesce('=' || source, '-'))) AS h FROM documents),
b AS (SELECT CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n, count(DISTINCT id) AS ids, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM r GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(ids) AS BIGINT) AS distinct_ids, sha256(string_agg(bucket || ':' || h, ',' ORDER BY bucket)) AS manifest_sha256 FROM b""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest(table(spark, sf_dir, "documents"), "doc_id", ("text", "lang", "source"))


@query("""WITH e AS (SELECT user_id, event_id, ['AUTHORIZED', 'STARTED', 'COMPLETED', 'INVALIDATED'][event_id % 4 + 1] AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id, state, before FROM b WHERE NOT ((before IS NULL AND state = 'AUTHORIZED') OR (coalesce(before = 'AUTHORIZED', false) AND state IN ('STARTED', 'INVALIDATED')) OR (coalesce(before = 'STARTED', false) AND state IN ('COMPLETED', 'INVALIDATED')))""")
def broken_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as if they were states of runs, one run a user."""
    from .sources import files

    state = F.element_at(F.array(*[F.lit(x) for x in ("AUTHORIZED", "STARTED", "COMPLETED", "INVALIDATED")]), (F.col("event_id") % 4 + 1).cast("int"))
    told = files.broken_ledger(table(spark, sf_dir, "events").withColumn("state", state), "user_id", "event_id", "state")
    return told.select("user_id", "event_id", "state", "before")


@query("SELECT s_name AS source_id, 'r' || s_nationkey AS repository, CAST(s_suppkey AS VARCHAR) AS revision, CAST(s_suppkey + 1 AS VARCHAR) AS observed FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, 'r' || s_nationkey, CAST(s_suppkey AS VARCHAR), NULL FROM supplier WHERE s_suppkey % 3 = 1")
def drifted_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pinned sources: a third has moved on, a third can't be found."""
    from .sources import files

    s = table(spark, sf_dir, "supplier")
    pinned = s.select(F.col("s_name").alias("source_id"), F.concat(F.lit("r"), "s_nationkey").alias("repository"), F.col("s_suppkey").cast("string").alias("revision"))
    seen = s.where("s_suppkey % 3 <> 1").select(F.col("s_name").alias("source_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey")).cast("string").alias("revision"))
    return files.drifted(pinned, seen)


@query("SELECT '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS value FROM region")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    return files.canonical_rows(table(spark, sf_dir, "region"))


@query("""WITH b AS (SELECT l_orderkey % 2 AS arm, l_orderkey, l_returnflag AS rule, count(*) AS n FROM lineitem GROUP BY ALL) SELECT arm, rule, count(*) AS traces, CAST(sum(n) AS BIGINT) AS uses FROM b GROUP BY ALL""")
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as traces, return flags as rules."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("rules")).withColumn("arm", F.col("l_orderkey") % 2)
    return reports.rule_usage(li, "rules", "arm")


@query("""WITH r AS (SELECT l_returnflag, unnest(list_filter([CASE WHEN l_tax > 0.03 THEN 'WORDS' END, CASE WHEN l_discount > 0.015 THEN 'CHARACTERS' END, CASE WHEN NOT (1 + l_tax - l_discount BETWEEN 0.97 AND 1.03) THEN 'LENGTH' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem),
g AS (SELECT l_returnflag, reason FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES ('WORDS'), ('CHARACTERS'), ('LENGTH'), ('NEVER')) v(reason))
SELECT g.l_returnflag, g.reason, count(r.reason) AS n FROM g LEFT JOIN r ON r.l_returnflag = g.l_returnflag AND r.reason = g.reason GROUP BY ALL""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = reports.visible_cost("STRICT", F.col("l_tax"), F.col("l_discount"), 1 + F.col("l_tax") - F.col("l_discount"))
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", reasons.alias("reasons"))
    return evaluate.reason_counts(li, "reasons", ("WORDS", "CHARACTERS", "LENGTH", "NEVER"), ("l_returnflag",))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount = 0) AS none, avg((l_tax / l_quantity) / (l_discount / l_extendedprice)) FILTER (l_discount > 0) AS m FROM lineitem GROUP BY ALL
UNION ALL SELECT 'SOME', l_linestatus, count(*), 0, avg((l_tax / l_quantity) / (l_discount / l_extendedprice)) FROM lineitem WHERE l_discount > 0 GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, CASE WHEN none = 0 THEN round(m, 4) END AS efficiency, CASE WHEN none > 0 THEN 'ZERO_TOKEN_EDIT_DENOMINATOR' ELSE 'COMPLETE' END AS status FROM c""")
def coverage_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes as replaced windows, discounts as edits; by flag, and over lines with edits."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_quantity", "l_discount", "l_extendedprice")
    both = li.unionByName(li.where("l_discount > 0").withColumn("l_returnflag", F.lit("SOME")))
    return rounded(evaluate.coverage_efficiency(both, ("l_returnflag", "l_linestatus"), "l_tax", "l_quantity", "l_discount", "l_extendedprice"), 4, "efficiency")


_QUARTILES = "SELECT lang, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75, stddev_pop(e) / avg(e) AS cv, stddev_pop(t) / avg(t) AS tcv FROM w GROUP BY lang"


@query(f"""WITH {_TOK}, w AS (SELECT lang, len(tokens) AS t, greatest(0, len(tokens) - 4) AS e FROM tok JOIN documents USING (doc_id)), q AS ({_QUARTILES}),
o AS (SELECT max(least(1.0, CASE WHEN least(x.q75 - x.q25, y.q75 - y.q25) > 0 THEN greatest(0, least(x.q75, y.q75) - greatest(x.q25, y.q25)) / least(x.q75 - x.q25, y.q75 - y.q25) ELSE CAST(least(x.q75, y.q75) >= greatest(x.q25, y.q25) AS INT) END)) AS overlap FROM q x JOIN q y ON x.lang < y.lang)
SELECT count(*) AS groups, round(max(greatest(cv, tcv)), 9) AS worst_cv, round(coalesce(any_value(overlap), 0), 9) AS worst_overlap, CASE WHEN max(greatest(cv, tcv)) <= 0.05 AND coalesce(any_value(overlap), 0) <= 0.1 THEN 'NOMINAL_TARGET_LENGTH' ELSE 'ELIGIBLE_OBSERVATION_BINS' END AS mode FROM q, o""")
def regime_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as nominal strata."""
    d = tokenized(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    w = d.select("lang", F.size("tokens").alias("t"), windows.n_windows(F.col("tokens"), 5).alias("e"))
    return rounded(calibrate.regime_decision(w, "lang", "t", "e"), 9, "worst_cv", "worst_overlap")


@query("""WITH l AS (SELECT l_linestatus, 'quantity' AS counted, l_quantity AS x FROM lineitem UNION ALL SELECT l_linestatus, 'number', l_linenumber FROM lineitem),
s AS (SELECT l_linestatus, counted, count(*) AS n, min(x) AS low, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS high, avg(x) AS mean, stddev_pop(x) / avg(x) AS cv FROM l GROUP BY ALL)
SELECT s.l_linestatus, counted, n, low, q25, q50, q75, high, round(mean, 9) AS mean, round(s.cv, 9) AS cv, p.cv <= 0.05 AS length_passes, n >= 1000 AS resolution_passes FROM s JOIN (SELECT l_linestatus, cv FROM s WHERE counted = 'quantity') p USING (l_linestatus)""")
def frozen_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("number"))
    return rounded(calibrate.frozen_opportunity(li, ("l_linestatus",), ("quantity", "number"), "quantity"), 9, "mean", "cv")


@query("""WITH h AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM (SELECT l_linestatus, l_returnflag FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL UNION ALL SELECT DISTINCT l_linestatus, 'R' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'X', 'X') GROUP BY ALL),
e AS (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem)
SELECT l_linestatus, l_returnflag, CASE WHEN n IS NULL THEN 'MISSING' WHEN wanted IS NULL THEN 'UNEXPECTED' ELSE 'REPEATED' END AS problem FROM (SELECT *, true AS wanted FROM e) FULL JOIN h USING (l_linestatus, l_returnflag) WHERE n IS NULL OR wanted IS NULL OR n > 1""")
def registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry without one flag, with another twice, and with a regime of its own."""
    regimes = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag").distinct()
    own = spark.createDataFrame([("X", "X")], "l_linestatus string, l_returnflag string")
    have = regimes.where("l_returnflag <> 'A'").unionByName(regimes.where("l_returnflag = 'R'")).unionByName(own)
    return calibrate.registry_problems(have, regimes, ("l_linestatus", "l_returnflag"))


@query("""WITH r AS (SELECT o_custkey, o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL), s AS (SELECT o_custkey, bool_and(high >= 1000) AS b4, bool_and(high >= 100000) AS b6, bool_or(low < 2000) AS dear FROM r GROUP BY 1)
SELECT count(*) AS sources, 0::BIGINT AS repeated, CASE WHEN NOT bool_and(b4) THEN 'SCARCE_B4' WHEN NOT bool_and(b6) THEN 'SCARCE_B6' WHEN bool_or(dear) THEN 'COST_CEILING' ELSE 'NO_SCARCITY' END AS decision FROM s""")
def candidate_scarcity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources that reach a budget if all their orders' statuses do."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    rows = by.groupBy("o_custkey").agg(F.bool_and(F.col("high") >= 1000).alias("b4"), F.bool_and(F.col("high") >= 100000).alias("b6"), F.bool_or(F.col("low") < 2000).alias("dear"))
    return reports.scarcity(rows, "o_custkey", (("B4", "b4"), ("B6", "b6")), "dear")


@query("""WITH p AS (SELECT doc_id AS item, doc_id + 1000 AS sample_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), j AS (SELECT doc_id AS item, quality AS label, row_number() OVER (PARTITION BY doc_id ORDER BY quality) AS k FROM labels),
s AS (SELECT doc_id + 1000 AS sample_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS now FROM documents WHERE doc_id % 10 <> 7)
SELECT item, sample_id, CASE WHEN j.item IS NOT NULL THEN 'r' END AS reviewer, label, CASE WHEN p.item IS NULL THEN 'NOT_IN_PACKET' WHEN j.item IS NULL THEN 'NO_LABEL' WHEN now IS NULL THEN 'SAMPLE_MISSING' WHEN now <> h THEN 'SAMPLE_CHANGED' END AS problem
FROM p FULL JOIN j USING (item) LEFT JOIN s USING (sample_id)""")
def bound_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgments of documents, some of which have changed or gone."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    packet = d.select(F.col("doc_id").alias("item"), (F.col("doc_id") + 1000).alias("sample_id"), F.sha2("text", 256).alias("sample_sha256"))
    votes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.lit("r").alias("reviewer"), F.col("quality").alias("label"))
    now = d.where("doc_id % 10 <> 7").select((F.col("doc_id") + 1000).alias("sample_id"), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return spans.bound_judgments(votes, packet, now)


@query("""WITH k AS (SELECT r, s, count(*) FILTER (l_quantity <= 25) AS safe, count(*) FILTER (l_quantity > 25) AS overlap, count(*) FILTER (l_discount > 0.09) AS violations FROM (SELECT l_returnflag AS r, l_linestatus AS s, * FROM lineitem) GROUP BY ALL)
SELECT x.r AS rule, y.s AS kind, coalesce(safe, 0) AS safe, coalesce(overlap, 0) AS overlap, coalesce(violations, 0) AS violations FROM (SELECT DISTINCT l_returnflag AS r FROM lineitem) x, (SELECT DISTINCT l_linestatus AS s FROM lineitem) y LEFT JOIN k ON k.r = x.r AND k.s = y.s""")
def span_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as rules, line statuses as kinds: every combination, empty ones as well."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("kind"), (F.col("l_quantity") > 25).alias("overlaps"), (F.col("l_discount") > 0.09).alias("violated"))
    return reports.stress_matrix(li, li, li)


@query("""WITH a AS (SELECT CAST(month(l_shipdate) AS INT) AS rule, CASE WHEN count(*) < 50 THEN 'TOO_FEW_REVIEWS' WHEN avg(CAST(l_returnflag = 'N' AS INT)) < 0.5 THEN 'BELOW_RATE' ELSE 'READY' END AS audit FROM lineitem GROUP BY 1),
f AS (SELECT CAST(month(o_orderdate) AS INT) AS rule, count(*) AS fixtures FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1), r AS (SELECT CAST(unnest(range(1, 14)) AS INT) AS rule)
SELECT rule, coalesce(fixtures, 0) AS fixtures, audit, CASE WHEN coalesce(fixtures, 0) < 5 THEN 'TOO_FEW_FIXTURES' WHEN audit IS NULL THEN 'NOT_AUDITED' WHEN audit <> 'READY' THEN audit ELSE 'READY' END AS status FROM r LEFT JOIN f USING (rule) LEFT JOIN a USING (rule)""")
def fidelity_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as rules, and a thirteenth that nothing speaks for."""
    r = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("rule"), (F.col("l_returnflag") == "N").alias("good"))
    fixtures = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.month("o_orderdate").alias("rule"))
    return reports.readiness(spark.range(1, 14).select(F.col("id").cast("int").alias("rule")), spans.rule_audit(r, "rule", "good", share=0.5), fixtures)


@query("""WITH g AS (SELECT l_linestatus AS budget, l_suppkey AS source, avg(l_discount) - 0.01 AS gain, true AS ok, max(l_quantity) > 49 AS win FROM lineitem GROUP BY ALL),
b AS (SELECT budget, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (gain < 0) AS bad, median(gain) AS median, count(*) FILTER (win) AS wins FROM g GROUP BY 1)
SELECT CASE WHEN NOT bool_and(n = (SELECT count(DISTINCT source) FROM g) AND sources = (SELECT count(DISTINCT source) FROM g)) THEN 'INCOMPLETE' WHEN sum(bad) > 0 OR min(median) <= 0 THEN 'K2' WHEN min(wins) = 0 THEN 'K1' ELSE 'PASS' END AS verdict FROM b""")
def geometry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources, line statuses as budgets."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("budget"), F.col("l_suppkey").alias("source")).agg((F.avg("l_discount") - 0.01).alias("gain"), F.lit(True).alias("ok"), (F.max("l_quantity") > 49).alias("win"))
    return reports.paired_gate(g, "source", "budget", "gain", "ok", "win")


_TOUCHED = f"""i AS ({_SPANS}), t AS (SELECT unnest(range(0, 21)) AS pos), w AS (SELECT DISTINCT l_orderkey, id, unnest(range(greatest(0, pos - 4), least(pos + 1, 17))) AS spot FROM i JOIN t ON pos * 7 < e AND s < pos * 7 + 6 WHERE e > s)"""


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans of characters over 21 tokens of six characters and a blank, 17 windows."""
    lines = _lines(spark, sf_dir)
    tokens_ = lines.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    tokens_ = tokens_.select("l_orderkey", "pos", (F.col("pos") * 7).alias("start"), (F.col("pos") * 7 + 6).alias("end"), F.lit(17).alias("windows"))
    return intervals.covered_windows(lines, tokens_, 5, ("l_orderkey",))


@query(f"WITH {_TOUCHED} SELECT l_orderkey, id, count(*) AS covered FROM w GROUP BY ALL")
def span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_size(_touched(spark, sf_dir), ("l_orderkey", "id"))


@query(f"WITH {_TOUCHED} SELECT l_orderkey, id, count(*) AS covered FROM w WHERE spot % 3 <> 1 GROUP BY ALL")
def eligible_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three windows are eligible."""
    lines = _lines(spark, sf_dir)
    eligible = lines.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("pos")).where("pos % 3 <> 1")
    return intervals.union_size(intervals.eligible_coverage(_touched(spark, sf_dir), eligible, ("l_orderkey",)), ("l_orderkey", "id"))


@query("""WITH e AS (SELECT l_discount - 0.05 AS a, l_tax - 0.04 AS b FROM lineitem), m AS (SELECT median(a) AS ma, median(b) AS mb, median(b - a) AS md FROM e)
SELECT round(median(abs(a - ma)), 9) AS mad_a, round(median(abs(b - mb)), 9) AS mad_b, round(median(abs(b - a - md)), 9) AS mad_difference FROM e, m""")
def transfer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("a"), (F.col("l_tax") - 0.04).alias("b"))
    return rounded(reports.transfer_spread(li, "a", "b"), 9, "mad_a", "mad_b", "mad_difference")


@query(f"""WITH {_hashed(SIGNAL.start)}, o AS (SELECT m.doc_id, valid, sha256(concat_ws('|', m.doc_id, m.pos, array_to_string(gram, ','))) AS h FROM masked m JOIN win ON win.doc_id = m.doc_id AND win.pos = m.pos)
SELECT doc_id, count(*) AS n, count(*) FILTER (valid) AS eligible, min(h) AS first_occurrence, max(h) AS last_occurrence FROM o GROUP BY doc_id""")
def root_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = windows.observations(windows.signal_windows(tokenized(spark, sf_dir), spark, SIGNAL))
    return o.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"), F.min("occurrence").alias("first_occurrence"), F.max("occurrence").alias("last_occurrence"))


@query("SELECT doc_id, true AS same FROM documents")
def retokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's words, put together again, give the tokens of the text."""
    from .functions.text import words

    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    direct = tokenized(spark, sf_dir)
    again = d.select("doc_id", tokens(F.array_join("w", " ")).alias("again"))
    return direct.join(again, "doc_id").select("doc_id", (F.col("tokens") == F.col("again")).alias("same"))


@query("""SELECT lang, source, CAST('0x' || right(sha256('{"master_seed":42,"parts":["condition","' || lang || '","' || source || '"]}'), 16) AS HUGEINT)::VARCHAR AS seed FROM documents GROUP BY ALL""")
def condition_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return d.select("lang", "source", seed64(seed_payload(42, F.lit("condition"), F.col("lang"), F.col("source"))).cast("string").alias("seed"))


@query("""WITH r AS (SELECT p_partkey * 10 AS s, p_partkey * 10 + CASE WHEN p_partkey % 7 = 0 THEN 9 WHEN p_partkey % 11 = 0 THEN 12 ELSE 10 END AS e FROM part), n AS (SELECT e AS "end", lead(s) OVER (ORDER BY s) AS next FROM r)
SELECT "end", next FROM n WHERE next IS NOT NULL AND next <> "end" """)
def shard_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ranges of ten, some of them short or long by a few."""
    size = F.when(F.col("p_partkey") % 7 == 0, 9).when(F.col("p_partkey") % 11 == 0, 12).otherwise(10)
    return corpus.gaps(table(spark, sf_dir, "part").select((F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + size).alias("end")))


@query("""SELECT * FROM (SELECT 'ids' AS gate, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'labels', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'texts', (SELECT count(*) FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1))), (SELECT 1) x(one)""".replace("SELECT * FROM (", "SELECT gate, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (", 1))
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return corpus.gates({
        "ids": corpus.duplicates(d, "doc_id"), "labels": corpus.dangling(labels, d, "doc_id"),
        "texts": corpus.duplicates(d.select(sha256(F.col("text")).alias("h")), "h"),
    })


@query(f"""WITH RECURSIVE c AS (SELECT l_linestatus, l_quantity > 25 AS b, l_quantity + l_discount * 20 > 25 AS a, l_discount * 20 AS shift, l_tax > 0.07 AS x FROM lineitem),
g AS (SELECT l_linestatus, count(*) FILTER (NOT x) AS n, count(*) FILTER (x) AS excluded, count(*) FILTER (NOT x AND NOT b AND a) AS false_to_true, avg(shift) FILTER (NOT x) AS m, median(shift) FILTER (NOT x) AS d FROM c GROUP BY 1), {_intervals('g', 'false_to_true', 'n')}
SELECT l_linestatus, g.n, excluded, false_to_true, round(false_to_true / g.n, 9) AS rate, ci_low, ci_high, round(m, 6) AS mean_shift, round(d, 6) AS median_shift FROM g JOIN ci ON ci.k = false_to_true AND ci.n = g.n""")
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as scores, moved up a little; high taxes are excluded."""
    after = F.col("l_quantity") + F.col("l_discount") * 20
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("s0"), after.alias("s1"), (F.col("l_quantity") > 25).alias("b"), (after > 25).alias("a"), (F.col("l_tax") > 0.07).alias("x"))
    told = evaluate.control(li, ("l_linestatus",), "b", "a", "s0", "s1", F.col("x"))
    return rounded(rounded(told, 6, "ci_low", "ci_high", "mean_shift", "median_shift"), 9, "rate")


@query(_THRESHOLDS.replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT l.l_linestatus, target, threshold, count(*) AS n, count(*) FILTER (l_extendedprice > threshold) AS detected FROM lineitem l JOIN t USING (l_linestatus) WHERE l_returnflag = 'R' GROUP BY ALL), {_intervals('p', 'detected', 'n')},
v2 AS (SELECT l_linestatus, l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY ALL),
w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY l_linestatus ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v2), u AS (SELECT l_linestatus, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM w GROUP BY 1)
SELECT p.l_linestatus, target, p.n, detected, round(detected / p.n, 9) AS rate, ci_low, ci_high, CASE WHEN detected / p.n >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status, threshold, round(auc, 9) AS auc FROM p JOIN ci ON ci.k = detected AND ci.n = p.n JOIN u USING (l_linestatus)""")
def pristine_detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").alias("pos"))
    told = evaluate.detectability(li, ("l_linestatus",), "l_extendedprice", "pos", _RATES)
    return rounded(rounded(told, 6, "ci_low", "ci_high"), 9, "rate", "auc")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS a, replace(coalesce(text, ''), 'é', 'e' || chr(769)) AS b FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN a <> nfc_normalize(a) OR b <> nfc_normalize(b) THEN 'NOT_NFC' END,
CASE WHEN list_sort(regexp_extract_all(a, '[\p{Cf}\p{Co}\p{Mn}\p{Me}]')) <> list_sort(regexp_extract_all(b, '[\p{Cf}\p{Co}\p{Mn}\p{Me}]')) THEN 'MARKS_CHANGED' END) AS reasons FROM d""")
def representation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with one accent taken apart."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"), F.replace(F.coalesce("text", F.lit("")), F.lit("é"), F.lit("e\u0301")).alias("b"))
    return d.select("doc_id", F.concat_ws(",", reports.representation_reasons(F.col("a"), F.col("b"))).alias("reasons"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 5 = 1 THEN '{"b":1,"a":2}' WHEN event_id % 5 = 2 THEN '{"a":1,"a":2}' WHEN event_id % 5 = 3 THEN 'nope' WHEN event_id % 5 = 4 THEN '{"a":1}' ELSE '{"a":' || event_id || ',"b":"x"}' END AS raw FROM events)
SELECT CASE WHEN raw = 'nope' THEN 'NOT_JSON' WHEN raw = '{"a":1}' THEN 'FIELDS_DIFFER' WHEN raw = '{"a":1,"a":2}' THEN 'DUPLICATE_KEY' WHEN raw = '{"b":1,"a":2}' THEN 'NOT_CANONICAL' END AS problem, count(*) AS n FROM e GROUP BY 1""")
def json_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON, four fifths of them wrong in some way."""
    from .sources import files

    kinds = F.col("event_id") % 5
    raw = F.when(kinds == 1, '{"b":1,"a":2}').when(kinds == 2, '{"a":1,"a":2}').when(kinds == 3, "nope").when(kinds == 4, '{"a":1}').otherwise(F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit(',"b":"x"}')))
    told = files.checked_json(table(spark, sf_dir, "events").select(raw.alias("raw")), "raw", ["a", "b"], must_be_canonical=True)
    return told.groupBy("problem").agg(F.count("*").alias("n"))


# --- events ------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.scores import counts_by_window

    told = counts_by_window(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return told.select(F.col("window.start").alias("hour"), "event_type", "n")
