"""Running sums, ranks and maxima over whole tables, or over few keys, without one task that reads all.

Rows are dealt to ranges of the order; each range sums its own, and what all ranges before it hold is a
small table that joins back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], tops: dict[str, Column] | None = None) -> DataFrame:
    """The rows with, for each name, the sum or the maximum over all rows of equal keys that come earlier.

    Sums of nothing are 0, maxima null.  Rows that tie in the order come in some order, so it had better be total.
    """
    tops = tops or {}
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    made = df.withColumns({f"{n}_own_": c for n, c in (sums | tops).items()})
    rows = keep(made.repartitionByRange(*keys, *by).withColumn("range_", F.spark_partition_id()))
    own = [*keys, "range_"]
    total = rows.groupBy(*own).agg(*[F.sum(f"{n}_own_").alias(f"{n}_all_") for n in sums], *[F.max(f"{n}_own_").alias(f"{n}_all_") for n in tops])
    # A row a range and key: ranges are few, and a key that lies within one range has one row.
    ranges = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*own, *[F.sum(f"{n}_all_").over(ranges).alias(f"{n}_all_") for n in sums], *[F.max(f"{n}_all_").over(ranges).alias(f"{n}_all_") for n in tops])
    inside = Window.partitionBy(*own).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({**{f"{n}_in_": F.sum(f"{n}_own_").over(inside) for n in sums}, **{f"{n}_in_": F.max(f"{n}_own_").over(inside) for n in tops}})
    both = _joined(local, before, keys)
    out = {n: F.coalesce(f"{n}_all_", F.lit(0)) + F.coalesce(f"{n}_in_", F.lit(0)) for n in sums} | {n: F.greatest(f"{n}_all_", f"{n}_in_") for n in tops}
    return both.withColumns(out).select(*df.columns, *out)


def _joined(local: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join by range and keys, null keys as equal."""
    named = before.select(F.col("range_").alias("r_"), *(F.col(k).alias(f"k_{i}_") for i, k in enumerate(keys)), *(c for c in before.columns if c.endswith("_all_")))
    on = F.col("range_") == F.col("r_")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"k_{i}_"))
    return local.join(named, on, "left")


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """The rows with their number within equal keys, from 0."""
    return with_running(df, keys, order, {name: F.lit(1).cast("long")})
