"""Power spectra as two grouped sums: a transform of n = n1 n2 values is n2 transforms of n1 values, turned, and n1 of n2, so that some
n (n1 + n2) rows are summed instead of n squared."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power(df: DataFrame, pos: str, value: str, group: list[str]) -> DataFrame:
    """(group.., n, k, power): for k = 1 .. n/2 of the first n values by pos (0, 1, ..), n being the largest power of two that a group has; less their mean."""
    two_to = lambda e: F.round(F.pow(F.lit(2.0), e)).cast("long")
    n = two_to(F.floor(F.log2(F.count("*").cast("double")) + 1e-9))
    df = df.select(*group, pos, value)
    size = df.groupBy(*group).agg(n.alias("n"))
    s = (df.join(size, group) if group else df.crossJoin(F.broadcast(size))).where(F.col(pos) < F.col("n")).select(*group, "n", F.col(pos).cast("long").alias("_t"), F.col(value).cast("double").alias("_v"))  # one row without groups
    mean = s.groupBy(*group).agg(F.avg("_v").alias("_m"))
    s = (s.join(mean, group) if group else s.crossJoin(F.broadcast(mean))).withColumn("_v", F.col("_v") - F.col("_m"))
    half = F.expr("cast(round(log2(cast(n as double))) + 1 as int) div 2")
    s = s.withColumn("_n1", two_to(half)).withColumn("_n2", F.expr("n div _n1"))
    turn = lambda a, b: -2 * math.pi * F.pmod(F.col(a[0]) * F.col(a[1]), F.col(b)) / F.col(b)
    first = s.withColumn("_t1", F.expr("_t div _n2")).withColumn("_t2", F.col("_t") % F.col("_n2")).withColumn("_k1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n1") - 1)))
    angle = turn(("_t1", "_k1"), "_n1")
    rows = first.groupBy(*group, "n", "_n1", "_n2", "_t2", "_k1").agg(F.sum(F.col("_v") * F.cos(angle)).alias("_re"), F.sum(F.col("_v") * F.sin(angle)).alias("_im"))
    second = rows.withColumn("_k2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n2") - 1))).withColumn("k", F.col("_k1") + F.col("_n1") * F.col("_k2"))
    second = second.where("k between 1 and n div 2")
    angle = turn(("_t2", "k"), "n")
    re, im = F.col("_re") * F.cos(angle) - F.col("_im") * F.sin(angle), F.col("_re") * F.sin(angle) + F.col("_im") * F.cos(angle)
    return second.groupBy(*group, "n", "k").agg((F.pow(F.sum(re), F.lit(2)) + F.pow(F.sum(im), F.lit(2))).alias("power"))
