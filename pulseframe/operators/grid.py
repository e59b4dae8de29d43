"""Dense grids and ordered-sequence operators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def densify(df: DataFrame, pos: str, group: list[str] | None = None) -> DataFrame:
    """Every position between the first and last of each group; other columns are null where a row was missing.

    One row per group and position is generated from the group's extremes, so nothing is collected.
    """
    group = group or []
    span = df.groupBy(*group).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    grid = span.select(*group, F.explode(F.sequence("_lo", "_hi")).alias(pos))
    return grid.join(df, [*group, pos], "left")


def ordered(pos: str, group: list[str] | None = None):
    return W.partitionBy(*(group or [F.lit(0)])).orderBy(pos)


def forward_fill(value: str, pos: str, group: list[str] | None = None) -> Column:
    return F.last(value, ignorenulls=True).over(ordered(pos, group).rowsBetween(W.unboundedPreceding, 0))


def fill_with_median(df: DataFrame, value: str, pos: str, out: str, group: list[str] | None = None) -> DataFrame:
    """Forward fill; a leading gap takes the median of the filled series, and a series without values 0."""
    filled = df.withColumn(out, forward_fill(value, pos, group))
    mid = filled.groupBy(*(group or [])).agg(F.percentile(out, F.lit(0.5)).alias("_mid"))
    joined = filled.join(mid, group) if group else filled.crossJoin(F.broadcast(mid))  # one row
    return joined.withColumn(out, F.coalesce(out, "_mid", F.lit(0.0))).drop("_mid")


def backward_difference(value: str, pos: str, group: list[str] | None = None) -> Column:
    return F.coalesce(F.col(value) - F.lag(value).over(ordered(pos, group)), F.lit(0.0))


def central_difference(value: str, pos: str, group: list[str] | None = None) -> Column:
    """(next - previous) / 2, one-sided at the ends."""
    w = ordered(pos, group)
    prev, nxt, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(prev.isNull(), nxt - v).when(nxt.isNull(), v - prev).otherwise((nxt - prev) / 2)


def box_smooth(value: str, pos: str, width: int, group: list[str] | None = None) -> Column:
    """Sum over a centred odd window divided by its width, with zeros beyond the ends."""
    half = width // 2
    return F.sum(F.coalesce(value, F.lit(0.0))).over(ordered(pos, group).rowsBetween(-half, half)) / width


def median_anomaly(value: str, pos: str, half: int, group: list[str] | None = None) -> Column:
    """Value less the running median of a centred window that the ends cut short."""
    return F.col(value) - F.percentile(value, F.lit(0.5)).over(ordered(pos, group).rowsBetween(-half, half))


def mean_anomaly(value: str, pos: str, width: int, group: list[str] | None = None) -> Column:
    """Value less the mean of rows -width/2 .. width/2 - 1; the first and last value stand for those beyond the ends."""
    w = ordered(pos, group)
    half = width // 2
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    i, n = F.row_number().over(w), F.count("*").over(whole)
    before = F.greatest(F.lit(0), half - (i - 1))
    after = F.greatest(F.lit(0), (width - half - 1) - (n - i))
    total = F.sum(value).over(w.rowsBetween(-half, width - half - 1)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return F.col(value) - total / width


def mean_anomaly_nullzero(value: str, pos: str, width: int, group: list[str] | None = None) -> Column:
    """As mean_anomaly, where missing values count as 0 in the mean and the ends are cut short."""
    half = width // 2
    return F.col(value) - F.sum(F.coalesce(value, F.lit(0.0))).over(ordered(pos, group).rowsBetween(-half, width - half - 1)) / width


def past_sum(value: str, pos: str, width: int, group: list[str] | None = None) -> Column:
    return F.coalesce(F.sum(value).over(ordered(pos, group).rowsBetween(-width, -1)), F.lit(0))


def since_last(flag: Column, pos: str, cap: int, group: list[str] | None = None) -> Column:
    """Positions since the last flagged row before this one, at most cap."""
    seen = F.last(F.when(flag, F.col(pos)), ignorenulls=True).over(ordered(pos, group).rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(F.least(F.col(pos) - seen, F.lit(cap)), F.lit(cap))


def window_summaries(value: str, pos: str, width: int, group: list[str] | None = None) -> dict[str, Column]:
    """Maximum, mean, population deviation, last, change, 90th percentile and minimum of the rows before this one."""
    w = ordered(pos, group).rowsBetween(-width, -1)
    return {
        "w_max": F.max(value).over(w), "w_mean": F.avg(value).over(w), "w_sd": F.stddev_pop(value).over(w), "w_last": F.last(value).over(w),
        "w_change": F.last(value).over(w) - F.first(value).over(w), "w_p90": F.percentile(value, F.lit(0.9)).over(w), "w_min": F.min(value).over(w),
    }


def lag_vector(value: str, pos: str, width: int, group: list[str] | None = None) -> Column:
    return F.collect_list(value).over(ordered(pos, group).rowsBetween(-width, -1))


def rank_normal(value: str, pos: str, group: list[str]) -> Column:
    """(rank - 1/2) / n; ties by position."""
    return (F.row_number().over(W.partitionBy(*group).orderBy(value, pos)) - 0.5) / F.count("*").over(W.partitionBy(*group))


def block_reduce(df: DataFrame, pos: Column, group: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*group, pos).agg(*[c.alias(k) for k, c in aggs.items()])


def valid_span(df: DataFrame, value: str, pos: str, group: list[str], steady: float = 0.98) -> DataFrame:
    """Adds valid: from the first to the last change of the series; always if nearly all rows change, never if none does."""
    changed = F.coalesce(F.col(value) != F.lag(value).over(ordered(pos, group)), F.lit(False))
    flagged = df.withColumn("_ch", changed)
    span = flagged.groupBy(*group).agg(F.min(F.when(F.col("_ch"), F.col(pos))).alias("_lo"), F.max(F.when(F.col("_ch"), F.col(pos))).alias("_hi"), (F.count_if("_ch") / (F.count("*") - 1)).alias("_share"))
    out = flagged.join(span, group)
    ok = F.when(F.col("_share") >= steady, True).when(F.col("_lo").isNull(), False).otherwise(F.col(pos).between(F.col("_lo") - 1, F.col("_hi")))
    return out.withColumn("valid", ok).drop("_ch", "_lo", "_hi", "_share")
