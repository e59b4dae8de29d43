"""Exact quantiles by repeated histograms. Each round counts the values between a rank's bounds in cells, and keeps the cell that
holds the rank with the least and greatest value in it; it ends when they are equal. A round is one aggregation of partial counts,
so that no task holds all distinct values; all groups and ranks share it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.session import cut

#: Cells between a rank's bounds.
CELLS = 4096


def exact(df: DataFrame, value: str | Column, probs: list[float], group: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """(group.., p, quantile): as percentile() gives them, bit by bit: between two ranks by linear interpolation.

    Nulls and NaN are left out; groups without other values don't appear, and without groups an empty table gives no row. Infinite
    values aren't supported.
    """
    group = group or []
    v = F.col(value) if isinstance(value, str) else value
    held = cut(df.select(*group, v.cast("double").alias("_v"))).where("_v is not null and not isnan(_v)")  # filters on a column, not on what it is made of
    ends = held.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    asked = ends.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("_at", (F.col("_n") - 1) * F.col("p"))
    ranks = asked.select(*group, "_lo", "_hi", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k")).distinct()
    left = cut(ranks.withColumn("_before", F.lit(0).cast("long")))
    found = None
    while True:
        done = left.where("_lo = _hi").select(*group, "_k", F.col("_lo").alias("_q"))
        found = done if found is None else found.unionByName(done)
        todo = left.where("_lo < _hi")
        if todo.isEmpty():
            break
        bounds = todo.groupBy(*group, "_lo", "_hi").agg(F.min("_before").alias("_before"), F.collect_set("_k").alias("_ks"))  # ranks between the same bounds are counted once
        met = held.join(bounds, group) if group else held.crossJoin(F.broadcast(bounds))  # as many rows as probabilities
        met = met.where("_v >= _lo and _v <= _hi")
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves, which can't overflow
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        counted = met.groupBy(*group, "_lo", "_hi", "_before", "_ks", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = W.partitionBy(*group, "_lo", "_hi").orderBy("_cell")
        upto = counted.withColumn("_end", F.col("_before") + F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
        inside = upto.select(*group, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_start").alias("_before"), F.explode(F.filter("_ks", lambda k: (k >= F.col("_start")) & (k < F.col("_end")))).alias("_k"))
        left = cut(inside.select(*group, "_lo", "_hi", "_k", "_before"))
    order = cut(found)
    lower, upper = (asked.withColumn("_k", f("_at")).join(order, [*group, "_k"]).select(*group, "p", "_at", F.col("_q").alias(n)) for f, n in ((F.floor, "_x"), (F.ceil, "_y")))
    both = lower.join(upper.drop("_at"), [*group, "p"])
    at = F.col("_at")
    mixed = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((F.ceil(at) - at) * F.col("_x") + (at - F.floor(at)) * F.col("_y"))
    return both.select(*group, "p", mixed.alias("quantile"))


def one(df: DataFrame, value: str | Column, p: float, cells: int = CELLS) -> float | None:
    """The quantile of a whole table as a number, as exact() gives it; None without values. A round's counts, one row a cell, reach the driver."""
    v = F.col(value) if isinstance(value, str) else value
    held = cut(df.select(v.cast("double").alias("_v"))).where("_v is not null and not isnan(_v)")
    n, lo, hi = held.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if not n:
        return None
    at, before = (n - 1) * p, 0
    low, high = math.floor(at), math.ceil(at)
    x = y = lo
    while lo < hi:
        cell = F.least(F.floor((F.col("_v") / 2 - lo / 2) / F.lit(hi / 2 - lo / 2) * cells), F.lit(cells - 1))
        rows = sorted(held.where(F.col("_v").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b")).collect())
        for i, (_, k, a, b) in enumerate(rows):
            if low < before + k:
                break
            before += k
        if high >= before + k:  # the ranks part at a cell's end
            x, y = b, rows[i + 1]["a"]
            break
        lo = hi = x = y = a
        if a < b:
            hi = b
    return x if x == y else (high - at) * x + (at - low) * y
