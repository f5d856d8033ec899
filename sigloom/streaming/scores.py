"""Window scores over a stream of documents.

Masks and scores concern one document, so a micro-batch needs no state: each batch runs the same plan as
a table.  Counts of scored documents by event-time window show the stateful form with late data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators.score import mean_scores
from ..operators.windows import Signal, signal_windows


def score_batch(spark: SparkSession, docs: DataFrame, signal: Signal) -> DataFrame:
    told = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    return mean_scores(signal_windows(told, spark, signal), len(signal.keys))


def score_stream(spark: SparkSession, docs: DataFrame, signal: Signal, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score every micro-batch of a stream of (doc_id, text) and hand it to ``sink``."""
    def each(batch: DataFrame, number: int) -> None:
        sink(score_batch(batch.sparkSession, batch, signal), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` no longer change a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"))
