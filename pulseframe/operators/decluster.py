"""Greedy, order-dependent selections.

Declustering keeps an event unless a kept one of higher rank covers it. With the covering pairs from a bucketed join,
rounds decide every event whose covering events are all decided: one that a kept event covers goes, one whose
covering events have all gone stays. Each round is a few equi-joins, and ranks make rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.session import cut


def thin(days: Column, window: int) -> Column:
    """array of the days that stay when each must be more than `window` after the last that stayed: a fold over a sorted array."""
    empty = F.array().cast("array<int>")
    return F.aggregate(F.array_sort(days), empty, lambda kept, d: F.when((F.size(kept) == 0) | (d - F.coalesce(F.element_at(kept, -1), F.lit(0)) > window), F.concat(kept, F.array(d))).otherwise(kept))


def resolve(events: DataFrame, covers: DataFrame) -> DataFrame:
    """(id, kept) from events (id) and covers (id, by): `by` precedes id in rank and covers it. As many rounds as the longest chain of covers needs."""
    covers, before = cut(covers), None
    state = events.select("id").distinct().join(covers.select("id").distinct().withColumn("_open", F.lit(True)), "id", "left").select("id", F.when(F.col("_open").isNull(), True).alias("kept"))
    while True:
        state = cut(state)
        left = state.where("kept is null").count()
        if left == 0:
            return state
        if left == before:  # each round decides the first of those that are left
            raise RuntimeError("covering pairs must follow a rank")
        before = left
        by = state.select(F.col("id").alias("by"), F.col("kept").alias("by_kept"))
        told = covers.join(by, "by").groupBy("id").agg(F.max(F.coalesce("by_kept", F.lit(False))).alias("hit"), F.count_if(F.col("by_kept").isNull()).alias("open"))
        state = state.join(told, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.col("open") == 0, True).alias("kept"))
