"""Global ranks without a global task: rows are dealt into ranges of the whole order, ranked within, and moved on by the rows
of the ranges before. There are as many ranges as the session has shuffle partitions; a value that many rows share is split by
the order's further columns. The dealt rows are checkpointed, so that sums and rows see the same ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.session import cut


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _range, which rises with the order; ranges hold like numbers of rows."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running_before(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """Adds the sum of `value` over all rows that come before in the order, of which no two rows should be equal."""
    r = ranged(df.withColumn("_v", value), order)
    sums = r.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = sums.select("_range", F.coalesce(F.sum("_s").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    within = F.coalesce(F.sum("_v").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("_w", within).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_w")).drop("_range", "_v", "_w", "_before")


def row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a row's place in the order, from 1."""
    return running_before(df, F.lit(1).cast("long"), order, name).withColumn(name, F.col(name) + 1)
