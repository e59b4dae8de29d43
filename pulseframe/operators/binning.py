"""Quantile bins and statistics over them. Edges come from exact percentiles with linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(df: DataFrame, value: str, group: list[str], bins: int = 10) -> DataFrame:
    qs = [i / bins for i in range(bins + 1)]
    return df.groupBy(*group).agg(F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("edges"))


def bin_unique(value: Column, edge_col: str = "edges") -> Column:
    """Left-closed bins between distinct edges; both ends belong to the outer bins."""
    e = F.array_distinct(edge_col)
    return F.size(F.filter(F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0))), lambda x: x <= value))


def bin_fixed(value: Column, edge_col: str = "edges", bins: int = 10) -> Column:
    """Left-closed bins between all edges, equal ones included; the top edge belongs to the last bin."""
    return F.least(F.greatest(F.size(F.filter(edge_col, lambda x: x <= value)) - 1, F.lit(0)), F.lit(bins - 1))


def assign(df: DataFrame, value: str, group: list[str], bins: int = 10, unique: bool = True) -> DataFrame:
    """Adds bin. The edges, a row for each group, join on the group."""
    e = edges(df, value, group, bins)
    joined = df.join(e, group) if group else df.crossJoin(F.broadcast(e))  # one row
    make = bin_unique(F.col(value)) if unique else bin_fixed(F.col(value), bins=bins)
    return joined.withColumn("bin", make).drop("edges")


def rates(binned: DataFrame, y: str, group: list[str]) -> DataFrame:
    """(group, bin, n, hits): counts that every statistic below starts from."""
    return binned.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("hits"))


def max_deviation(counted: DataFrame, group: list[str], least: float = 0.015, relative: bool = False) -> DataFrame:
    """max |rate - base| over bins that hold a share `least` of the rows."""
    total = counted.groupBy(*group).agg(F.sum("n").alias("_n"), (F.sum("hits") / F.sum("n")).alias("_base"))
    both = counted.join(total, group) if group else counted.crossJoin(F.broadcast(total))  # one row
    dev = F.abs(F.col("hits") / F.col("n") - F.col("_base"))
    dev = dev / F.nullif("_base", F.lit(0.0)) if relative else dev
    return both.groupBy(*group).agg(F.max(F.when(F.col("n") >= F.floor(F.col("_n") * least), dev)).alias("stat"))


def spread(counted: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """Standard deviation of the bins' rates, weighted by their rows."""
    some = counted.where(F.col("n") >= least).withColumn("_r", F.col("hits") / F.col("n"))
    mean = some.groupBy(*group).agg((F.sum(F.col("n") * F.col("_r")) / F.sum("n")).alias("_m"))
    both = some.join(mean, group) if group else some.crossJoin(F.broadcast(mean))  # one row
    return both.groupBy(*group).agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("_r") - F.col("_m"), 2)) / F.sum("n")).alias("stat"))
