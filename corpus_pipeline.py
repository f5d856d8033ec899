"""From raw documents to encoded training text: five stages, each a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Scratch, crc_mod

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; it learns from four fifths of the labels of those given."""
    from sigloom.llm.common import spare
    from sigloom.llm.toxicity import fit, score

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    into = spare("▁score", docs.columns), spare("▁sentences", docs.columns)
    return score(docs, model, keep=tuple(docs.columns), into=into).where(F.col(into[0]) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; those left without any text go."""
    from sigloom.llm import lines
    from sigloom.llm.common import spare

    counts = spare("▁lines", docs.columns), spare("▁removed", docs.columns)
    cut = lines.dedup_lines(docs, spark, into=counts)
    emptied = (F.col(counts[1]) > 0) & (F.trim(F.col("text")) == "")
    kept = cut.where(F.coalesce(~emptied, F.lit(True)))
    n_chars = F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: of the smallest id the row of the least digest of its text, once.

    Rows without words or id have no group and stay.
    """
    from sigloom.llm.common import spare
    from sigloom.llm.neardup import groups

    told = groups(docs, spark).where("doc_id IS NOT NULL AND n_shingles > 0")
    # Rows to drop, by id and digest: those that aren't their group's least one.
    least = told.where("doc_id = component_id").groupBy("component").agg(F.min("row").alias("least"))
    gone = told.join(least, "component").where("doc_id <> component_id OR row <> least").select("doc_id", "row").distinct()
    row, extra, doc, digest = (spare(f"▁{c}", docs.columns) for c in ("row", "extra", "doc", "digest"))
    marked = docs.withColumn(row, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(doc)) & (F.col(row) == F.col(digest))
    left = marked.join(gone.select(F.col("doc_id").alias(doc), F.col("row").alias(digest)), same, "left_anti")
    if not told.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
        return left.select(*docs.columns)
    again = left.withColumn(extra, F.when(F.col("doc_id").isNull() | F.coalesce(F.trim(F.col("text")) == "", F.lit(True)), F.monotonically_increasing_id()))
    return again.dropDuplicates(["doc_id", row, extra]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet source, language and topic targets."""
    from sigloom.llm.common import spare
    from sigloom.llm.mixing import mix

    into = tuple(spare(f"▁{c}", docs.columns) for c in ("tokens", "p", "drawn"))
    return mix(docs, spark, into=into).where(F.col(into[2])).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, an end id behind each, and what these decode to."""
    import public_tokenizers

    from sigloom.llm.pieces import round_trip

    both = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(docs.columns))
    return both.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The first and last stage can't be told in SQL; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's table is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
