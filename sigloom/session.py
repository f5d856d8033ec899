"""Session helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """64-bit arithmetic of expressions analysed inside wraps around; later ones are as before.

    The mode is taken over when a DataFrame is made from an expression, so only that has to happen here.
    """
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(ANSI, before)


def built_wrapping(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    with wrapping(spark):
        out = build()
        out.schema  # noqa: B018  analysed here
    return out
