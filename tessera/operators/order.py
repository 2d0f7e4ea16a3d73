"""Sums and numbers along an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import checkpointed


def running(rows: DataFrame, order: list[Column | str], **values: Column) -> DataFrame:
    """rows with a column for each of values: its sum over the rows before, in order (0 for the first).

    Rows are dealt into ranges of the order. Ranges are summed up first, one row a range, so their sums meet in one task whatever the number of rows; sums within a range are that task's own.
    """
    dealt = rows.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]).repartitionByRange(*order)
    cells = checkpointed(dealt.withColumn("__cell", F.spark_partition_id()))
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(F.col("__cell").alias("__of")).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    base = sums.select("__of", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in values])
    within = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = [(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0))).alias(n) for n in values]
    return cells.join(F.broadcast(base), F.col("__cell") == F.col("__of")).select(*[F.col(f"`{c}`") for c in rows.columns], *summed)


def numbered(rows: DataFrame, order: list[Column | str], name: str = "nth") -> DataFrame:
    """rows with their number (long, from 0) in an order without ties."""
    return running(rows, order, **{name: F.lit(1).cast("long")})
