"""The registered queries of this package: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, spark).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), spark)
    return mixed.select("doc_id", F.col("▁tokens").alias("n_words"), F.round("▁p", 6).alias("probability"), F.col("▁drawn").alias("drawn"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import groups

    return groups(_table(spark, sf_dir, "documents"), spark).drop("row", "component")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import cut_repeats

    cut = cut_repeats(_table(spark, sf_dir, "documents"), spark)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .lm import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(~held_out), spark)
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), spark)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .toxicity import fit, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, extract

    def told(spans: str):
        names = F.array(*[F.lit(k) for k in KINDS])
        one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    found = extract(_table(spark, sf_dir, "documents"), spark)
    # A lambda of two parameters, even if one has a default, would get each element's place as the second.
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(told("base"), 256).alias("base_sha256"),
        told("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trip

    both = round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing_sql(), "op6_exact_top_k": OP6_SQL}


def mixing_sql(rounds: int = 30, fills: int = 12) -> str:
    """Raking and sampling with the rounds written out."""
    from .mixing import AXES, POWERS, SHARE

    steps = []
    for axis in AXES:
        steps.append(f"""t_{axis} AS MATERIALIZED (
  SELECT {axis}, pow(CAST(sum(tokens) AS DOUBLE), {POWERS[axis]}) / sum(pow(CAST(sum(tokens) AS DOUBLE), {POWERS[axis]})) OVER () AS target
  FROM cells GROUP BY {axis} HAVING sum(tokens) > 0)""")
    steps.append("w_0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) AS weight FROM cells WHERE tokens > 0)")
    last = 0
    for _ in range(rounds):
        for axis in AXES:
            steps.append(f"""w_{last + 1} AS MATERIALIZED (
  SELECT w.source, w.lang, w.topic, w.tokens, w.weight * t.target / sum(w.weight) OVER (PARTITION BY w.{axis}) AS weight
  FROM w_{last} w JOIN t_{axis} t USING ({axis}))""")
            last += 1
    steps.append(f"f_0 AS MATERIALIZED (SELECT {SHARE} * (SELECT sum(tokens) FROM cells) AS wanted, {SHARE} * (SELECT sum(tokens) FROM cells) AS scale)")
    for k in range(fills):
        steps.append(f"""f_{k + 1} AS MATERIALIZED (
  SELECT max(wanted) AS wanted, greatest(max(scale), coalesce((max(wanted) - coalesce(sum(tokens) FILTER (tokens <= weight * scale), 0))
         / nullif(sum(weight) FILTER (tokens > weight * scale), 0), 0)) AS scale
  FROM w_{last}, f_{k})""")
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN text LIKE '% | %' THEN 'table' WHEN coalesce(length(text), 0) < 400 THEN 'note'
              WHEN length(text) < 4000 THEN 'article' ELSE 'essay' END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_words
  FROM documents
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_words) AS tokens FROM d GROUP BY ALL),
{", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0, weight / tokens * scale) AS p FROM w_{last}, f_{fills})
SELECT doc_id, n_words, round(CASE WHEN n_words > 0 THEN coalesce(p, 0) ELSE 0 END, 6) AS probability,
       CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
         < CASE WHEN n_words > 0 THEN coalesce(p, 0) ELSE 0 END AS drawn
FROM d LEFT JOIN p USING (source, lang, topic)
"""


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
