"""Resampling nulls. A replicate moves only the rows that carry an event; zeros are never built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shifted_hits(bins: DataFrame, event_pos: DataFrame, shifts: DataFrame, n: int | Column, group: list[str]) -> DataFrame:
    """(group, replicate, bin, hits): events at pos move to pmod(pos + shift, n) and count in the bin they meet.

    bins: (group, pos, bin); event_pos: (pos); shifts: (replicate, shift), as many as there are replicates.
    """
    n = F.lit(n) if isinstance(n, int) else n
    moved = event_pos.crossJoin(F.broadcast(shifts)).select("replicate", F.pmod(F.col("pos") + F.col("shift"), n).alias("pos"))  # replicates are a parameter
    return moved.join(bins, "pos").groupBy(*group, "replicate", "bin").agg(F.count("*").alias("hits"))


def shifted_statistic(bins: DataFrame, event_pos: DataFrame, shifts: DataFrame, n: int, group: list[str], least: float = 0.015) -> DataFrame:
    """(group, replicate, stat): the largest |rate - base| of any bin in each replicate."""
    sizes = bins.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    hits = shifted_hits(bins, event_pos, shifts, n, group)
    grid = sizes.crossJoin(F.broadcast(shifts.select("replicate")))
    full = grid.join(hits, [*group, "replicate", "bin"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    w = W.partitionBy(*group, "replicate")
    total, base = F.sum("n").over(w), F.sum("hits").over(w) / F.sum("n").over(w)
    dev = F.when(F.col("n") >= F.floor(total * least), F.abs(F.col("hits") / F.col("n") - base))
    return full.withColumn("dev", dev).groupBy(*group, "replicate").agg(F.max("dev").alias("stat"))


def season_shift(t: Column, t0: Column, span: Column, years: Column, jitter: Column) -> Column:
    """Time moved by whole years and a jitter, around the span."""
    return t0 + F.pmod(t - t0 + F.rint(years * 365.25) + jitter, span)


def inject_extreme(df: DataFrame, pool: str, label: str, order: list[Column], chosen: Column) -> DataFrame:
    """All rows; in the pools that are chosen, the label stands on the first row of the order alone."""
    first = (F.row_number().over(W.partitionBy(pool).orderBy(*order)) == 1).cast("int")
    return df.withColumn("_first", first).withColumn(label, F.when(chosen, F.col("_first")).otherwise(F.col(label))).drop("_first")


def rotate(df: DataFrame, pos: str, n: Column, k: Column) -> DataFrame:
    return df.withColumn(pos, F.pmod(F.col(pos) + k, n))


def permute_within(df: DataFrame, block: str, natural: str, random: Column, value: str) -> DataFrame:
    """The values of each block in the order of `random`, on the rows in their natural order."""
    a = df.withColumn("_i", F.row_number().over(W.partitionBy(block).orderBy(natural)))
    b = df.withColumn("_i", F.row_number().over(W.partitionBy(block).orderBy(random, natural))).select(block, "_i", F.col(value).alias("permuted"))
    return a.join(b, [block, "_i"]).drop("_i")


def shuffle_labels(df: DataFrame, pool: str, random: Column) -> Column:
    """The one row of each pool that a random order puts first."""
    return (F.row_number().over(W.partitionBy(pool).orderBy(random)) == 1).cast("int")


def permute_blocks(pos: Column, block: int, n_blocks: Column | int, mult: int, add: int = 0) -> Column:
    """A position after its contiguous block moved: blocks map by an affine function modulo their number, which mult shares no factor with."""
    return F.pmod(F.floor(pos / block) * mult + add, n_blocks if isinstance(n_blocks, Column) else F.lit(n_blocks)) * block + F.pmod(pos, F.lit(block))


def lcg(*terms: tuple[Column, int], modulus: int = 10007) -> Column:
    """A long in 0 .. modulus - 1 from a weighted sum of integers; the same in any engine, whatever the partitions."""
    total = F.lit(0).cast("long")
    for c, k in terms:
        total = total + c.cast("long") * k
    return F.pmod(total, F.lit(modulus))


def free_shift(t: Column, t0: Column, span: Column, draw: Column, margin: int) -> Column:
    """Time moved around the span by an offset that stays `margin` away from none and from a full turn."""
    return t0 + F.pmod(t - t0 + margin + F.pmod(draw, span - 2 * margin), span)


def redraw_weighted(weights: DataFrame, pos: str, weight: str, draws: DataFrame, draw: str, modulus: int) -> DataFrame:
    """draws with a pos each, by inverting the running sum of whole weights; an as-of step, not a range join."""
    from .joins import as_of
    from .ranking import running_before

    run = running_before(weights.where(F.col(weight) > 0), F.col(weight), [pos], "start").select("start", pos)
    total = weights.agg(F.sum(weight).alias("_total"))
    asked = draws.crossJoin(F.broadcast(total)).withColumn("_at0", F.floor(F.col(draw) * F.col("_total") / modulus)).drop("_total")  # one row
    return as_of(asked, run, [], "_at0", "start", [pos]).drop("_at0", "start")
