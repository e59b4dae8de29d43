"""Joins in time and space, written as equi-joins on buckets with a residual predicate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.geo import haversine
from pulseframe.session import cut

from .ranking import ranged


def lag_window(events: DataFrame, field: DataFrame, key: list[str], event_day: str, field_day: str, lo: int, hi: int) -> DataFrame:
    """Field rows at the event's own key on days event - hi .. event - lo, with lag. Each field row is filed under the days that
    ask for it, so that the join is on equality and events are moved once; it is never broadcast, as estimates don't see the copies."""
    asked = field.withColumn("lag", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(event_day, F.col(field_day) + F.col("lag"))
    return events.join(asked.hint("merge"), [*key, event_day])


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, values: list[str], tolerance: Column | None = None, hot: bool = False) -> DataFrame:
    """The last right row at or before each left row, by union and a running last; no pair is built.

    A key's rows meet in one task, unless hot, or without a key: then rows are dealt into ranges of (key, time), and the last value of
    a key that began in an earlier range is carried on, two rows a range.
    """
    v = F.struct(right_ts, *values)
    a = left.withColumn("_at", F.col(left_ts)).withColumn("_v", F.lit(None).cast(right.select(v).schema[0].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*key, F.col(right_ts).alias("_at"), v.alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    if key and not hot:
        w = W.partitionBy(*key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
        met = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    else:
        r = ranged(both.withColumn("_key", F.struct(*[F.col(k) for k in key], F.lit(0).alias("_"))), ["_key", "_at", "_side"])
        ends = r.groupBy("_range").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))  # a row a range
        edge = r.join(F.broadcast(ends), "_range").where("_key = _lo or _key = _hi").groupBy("_range", "_key").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_at", "_side"))).alias("_c"))
        carried = edge.withColumn("_c", F.last("_c", ignorenulls=True).over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))
        w = W.partitionBy("_range", "_key").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
        met = r.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(F.broadcast(carried), ["_range", "_key"], "left")
        met = met.withColumn("_v", F.coalesce("_v", "_c")).drop("_c", "_range", "_key")
    ok = F.lit(True) if tolerance is None else (F.col("_at") - F.col(f"_v.{right_ts}")) <= tolerance
    out = [F.when(ok, F.col(f"_v.{c}")).alias(c) for c in [right_ts, *values]]
    return met.select(*left.columns, *out)


def interpolate(grid: DataFrame, points: DataFrame, pos: str, value: str) -> DataFrame:
    """Linear interpolation of points on a grid; the ends hold."""
    both = grid.select(pos).join(points, pos, "full")
    back = W.partitionBy(F.lit(0)).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    on = W.partitionBy(F.lit(0)).orderBy(pos).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(pos, value))
    both = both.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(on))
    a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    lerp = a(value) + (b(value) - a(value)) * (F.col(pos) - a(pos)) / F.nullif(b(pos) - a(pos), F.lit(0))
    return both.withColumn("interpolated", F.coalesce(lerp, a(value), b(value))).drop("_a", "_b").join(grid.select(pos), pos)


def near_pairs(a: DataFrame, b: DataFrame, km: float, hours: tuple[int, int] | None, residual: Column | None = None, spread_b: bool = False) -> DataFrame:
    """Pairs of a (id, hour, lat, lon, ..) and b (id2, hour2, lat2, lon2, ..) within km, where hours[0] <= hour2 - hour <= hours[1]; None: at any time.

    Cells are as high as the radius and, in each row of cells, as wide as it is at the row's narrowest; rows that
    touch a pole are one cell. a, or with spread_b b, goes to its own cell and its neighbours, in space and time; each pair
    meets once. It should be the smaller side; copies are never broadcast, as estimates of size don't see them.
    """
    size = km / 111.0
    rows = math.floor(180 / size) + 1
    span = max(hours[1] - hours[0], 1) if hours else 1

    def cells(row: Column) -> Column:
        """How many cells a row has around the globe."""
        edge = F.greatest(F.abs((row - 1) * size - 90), F.abs((row + 2) * size - 90))  # neighbouring rows included
        return F.when(edge >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / size))).cast("int")

    row_of = lambda lat: F.floor((lat + 90) / size).cast("int")
    col_of = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360 / n)), n - 1).cast("int")

    def filed(df: DataFrame, k: str) -> DataFrame:
        return df.withColumn("_r", row_of(F.col(f"lat{k}"))).withColumn("_c", col_of(F.col(f"lon{k}"), cells(F.col("_r")))).withColumn("_t", F.floor(F.col(f"hour{k}") / span) if hours else F.lit(0).cast("long"))

    def around(df: DataFrame, k: str, lo: int, hi: int) -> DataFrame:
        row = row_of(F.col(f"lat{k}"))
        df = df.withColumn("_r", F.explode(F.sequence(F.greatest(row - 1, F.lit(0)), F.least(row + 1, F.lit(rows)))))
        n = cells(F.col("_r"))
        here = col_of(F.col(f"lon{k}"), n)
        df = df.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(here + i, n) for i in (-1, 0, 1)]))))
        if not hours:
            return df.withColumn("_t", F.lit(0).cast("long"))
        return df.withColumn("_t", F.explode(F.sequence(F.floor((F.col(f"hour{k}") + lo) / span), F.floor((F.col(f"hour{k}") + hi) / span))))

    lo, hi = hours or (0, 0)
    left, right = (filed(a, ""), around(b, "2", -hi, -lo)) if spread_b else (around(a, "", lo, hi), filed(b, "2"))
    met = left.hint("merge").join(right, ["_r", "_c", "_t"]).where((F.col("hour2") - F.col("hour")).between(*hours) if hours else F.lit(True))
    met = met.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)
    return (met.where(residual) if residual is not None else met).drop("_r", "_c", "_t")


def covering_pairs(events: DataFrame, km: Callable, days: Callable, residual: Column, step: float = 0.5) -> DataFrame:
    """near_pairs of events with later ones in windows that grow with the magnitude of the first: km(mag) and days(mag).

    Events are joined by bands of magnitude, each under the largest window of its band, so that the few largest don't
    widen the search of all; one row of bounds reaches the driver. The windows must not fall within a band by more than at its ends.
    """
    ends = events.agg(F.min("mag").alias("lo"), F.max("mag").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    edges = [] if lo is None else [step * k for k in range(math.floor(lo / step), math.floor(hi / step) + 2)]
    probe = events.sparkSession.createDataFrame([(e, max(e + step - 1e-9, e)) for e in edges[:-1]] or [(0.0, step)], "a double, b double")
    both = lambda f: F.greatest(f(F.col("a")), f(F.col("b")))
    bands = [(r["a"], r["b"], r["km"], r["days"]) for r in probe.select("a", "b", both(km).alias("km"), both(days).alias("days")).collect()]
    own = residual & (F.col("km") <= km(F.col("mag"))) & ((F.col("hour2") - F.col("hour")) <= days(F.col("mag")))
    out = None
    for a, b, reach, length in bands:
        some = events.where((F.col("mag") >= a) & (F.col("mag") <= b))
        met = near_pairs(some, second(events, ["id", "hour", "lat", "lon", "mag"]), reach, (0, math.ceil(length)), own)
        out = met if out is None else out.unionByName(met)
    return out


def fitted_ring(points: DataFrame, k: int, ring: float, span: float) -> float:
    """The ring, halved until a point shares its square cell with at most k points on average, itself included."""
    known = points.where("x is not null and y is not null")
    while ring > span / 2**40:
        c = known.groupBy(F.floor(F.col("x") / ring), F.floor(F.col("y") / ring)).agg(F.count("*").cast("double").alias("c"))
        if (c.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0) <= max(k, 1):
            break
        ring /= 2
    return ring


def kth_neighbour(points: DataFrame, k: int, ring: float) -> DataFrame:
    """points (x, y, distinct) with width, the distance to the k-th other point; null where there are fewer.

    Cells as wide as the ring are joined with their neighbours. A point is done when k others lie within the ring, as
    nothing outside can be nearer; the ring doubles for the rest, until it spans all points. It is first halved until a point shares
    its cell with k on average, so that a point meets some k others, however many there are.
    """
    points = cut(points)
    ends = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    span = math.hypot(ends["w"] or 0.0, ends["h"] or 0.0)
    ring = fitted_ring(points, k, ring, span)
    open_, done = points, None
    while True:
        cell = lambda c: F.floor(F.col(c) / ring)  # noqa: B023, E731
        near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        others = points.select(F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("_r"), cell("y").alias("_c"))
        met = open_.withColumn("_r", near("x")).withColumn("_c", near("y")).hint("merge").join(others, ["_r", "_c"])  # copies are never broadcast
        d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)))
        met = met.where((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))).withColumn("width", d).where(F.col("width") <= ring)
        found = met.withColumn("_i", F.row_number().over(W.partitionBy("x", "y").orderBy("width"))).where(F.col("_i") == k).select("x", "y", "width")
        found = cut(found)
        done = found if done is None else done.union(found)
        open_ = cut(open_.join(found, ["x", "y"], "left_anti"))
        if ring >= span or open_.limit(1).count() == 0:
            return points.join(done, ["x", "y"], "left")
        ring *= 2


def kernel_density(sources: DataFrame, targets: DataFrame, width: str = "width", reach: float = 6.0) -> DataFrame:
    """targets (id, x, y) with density: the mean over sources (x, y, width) of Gaussian kernels, each of its own width and cut `reach` widths out.

    A source is filed in the grid whose cells are the least power of two that holds its reach, and a place asks its own cell and
    the eight around it at every level that occurs, so that wide kernels meet all places near them and narrow ones only theirs.
    Targets at one place ask once. Levels are as many as powers of two between the least and the greatest width. Sources without
    a positive width are left out.
    """
    ok = sources.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col(width) > 0))
    s = ok.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(width).alias("_w")).withColumn("_level", F.ceil(F.log2(F.col("_w") * reach)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(F.col(c) / size)
    s = cut(s.withColumn("_r", cell("_x")).withColumn("_c", cell("_y")))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())
    n = s.count()
    asked = targets.select("x", "y").distinct().withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    met = asked.withColumn("_r", around("x")).withColumn("_c", around("y")).hint("merge").join(s, ["_level", "_r", "_c"])  # copies are never broadcast
    d2 = F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2))
    w2 = F.col("_w") * F.col("_w")
    near = met.withColumn("_k", F.exp(-d2 / (2 * w2)) / (2 * math.pi * w2)).where(F.sqrt(d2) <= F.col("_w") * reach)  # squares would part a width and its reach at the very edge
    found = near.groupBy("x", "y").agg((F.sum("_k") / n).alias("density"))
    return targets.join(found, ["x", "y"], "left").select(*targets.columns, F.coalesce("density", F.lit(0.0)).alias("density"))


def second(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with a 2 behind their names, for the right side of near_pairs."""
    return df.select(*[F.col(c).alias(f"{c}2") for c in columns])


def forward_label(df: DataFrame, flag: Column, pos: str, horizon: int, group: list[str] | None = None) -> Column:
    """Whether any of the next `horizon` rows is flagged; the row itself doesn't count."""
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(pos).rowsBetween(1, horizon)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0))


def merge_rows(primary: DataFrame, fallback: DataFrame, key: list[str], level: str, columns: list[str]) -> DataFrame:
    """Primary columns, all of them from the fallback where the primary level is missing."""
    other = fallback.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    met = primary.join(other, key, "left")
    use = F.col(level).isNull()
    return met.select(*key, *[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
