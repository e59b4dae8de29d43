"""What past events are expected to trigger in zones: the kernel's integral over each zone, and the events that drive it.

A zone is covered with points of low discrepancy, made by an expression, over which the kernel's mean times the zone's
area is its integral. The kernel's tail has no end, so that each ancestor gets the reach within which all but `tail` of its
plane integral lies. Ancestors are filed in the grid whose cells are the least power of two that holds their reach, and points ask
their own cell and the eight around it at every level that occurs; no pair farther apart than that is made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.geo import omori_integral, space_kernel

KM = 111.19


@dataclass(frozen=True)
class Triggering:
    """An ancestor of magnitude m0 + dm triggers k e^(alpha dm) (t+c)^-p events a day, at distances of the kernel (d, gamma, q)."""

    m0: float
    k: float
    alpha: float
    c: float
    p: float
    d: float
    gamma: float
    q: float

    def reach(self, dm: Column, tail: float) -> Column:
        """The distance beyond which the share `tail` of the plane integral lies."""
        return self.d * F.pow(F.lit(10.0), self.gamma / 2 * dm) * math.sqrt(tail ** (1 / (1 - self.q)) - 1)


def radical_inverse(i: Column, base: int, n: int) -> Column:
    """The digits of i, 0 <= i < n, in a base, mirrored at the point."""
    digits = max(1, math.ceil(math.log(max(n, 2)) / math.log(base) + 1e-9))
    return sum((F.floor(i / F.lit(base**k)) % base / F.lit(float(base ** (k + 1))) for k in range(digits)), F.lit(0.0))


def points(zones: DataFrame, n: int, lat0: float) -> DataFrame:
    """zones (zone, lat_lo, lat_hi, lon_lo, lon_hi) as (zone, x, y, area): n points each, in kilometres on the plane that touches lat0."""
    squeeze = math.cos(math.radians(lat0))
    p = zones.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda lo, hi, base: F.col(lo) + (F.col(hi) - F.col(lo)) * radical_inverse(F.col("_i"), base, n)
    area = (F.col("lat_hi") - F.col("lat_lo")) * (F.col("lon_hi") - F.col("lon_lo")) * (KM * KM * squeeze)
    return p.select("zone", (at("lon_lo", "lon_hi", 3) * KM * squeeze).alias("x"), (at("lat_lo", "lat_hi", 2) * KM).alias("y"), area.alias("area"))


def contributions(events: DataFrame, zones: DataFrame, now: float, days: float, law: Triggering, lat0: float = 0.0, n: int = 400, memory: float = 3650.0, tail: float = 0.01) -> DataFrame:
    """(zone, id, expected) of each event (id, day, lat, lon, mag) that reaches a zone: what it triggers there in `days` after `now`.

    Events after `now`, more than `memory` days before it, smaller than m0 or with nulls are left out; of what an
    event triggers, at most the share `tail` may be left out. Boxes don't go around the globe.
    """
    squeeze = math.cos(math.radians(lat0))
    dm = F.col("mag") - law.m0
    old = events.select("id", (F.lit(now) - F.col("day")).alias("age"), (F.col("lon") * KM * squeeze).alias("_x"), (F.col("lat") * KM).alias("_y"), dm.alias("dm")).dropna()
    old = old.where((F.col("age") >= 0) & (F.col("age") < memory) & (F.col("dm") >= 0)).withColumn("_reach", law.reach(F.col("dm"), tail))
    old = old.withColumn("_level", F.ceil(F.log2("_reach")).cast("int")).withColumn("made", omori_integral(F.col("age"), F.col("age") + days, F.col("dm"), law.k, law.alpha, law.c, law.p))
    size = F.pow(F.lit(2.0), F.col("_level"))
    old = old.withColumn("_r", F.floor(F.col("_x") / size)).withColumn("_c", F.floor(F.col("_y") / size))
    ends = old.agg(F.min("_level").alias("lo"), F.max("_level").alias("hi")).first()  # levels are powers of two between the reaches
    levels = [] if ends["lo"] is None else list(range(ends["lo"], ends["hi"] + 1))
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    asked = points(zones, n, lat0).withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    met = asked.withColumn("_r", near("x")).withColumn("_c", near("y")).join(old, ["_level", "_r", "_c"])
    km2 = F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2))
    met = met.withColumn("km", F.sqrt(km2)).where(F.col("km") <= F.col("_reach"))
    share = F.sum(space_kernel(F.col("km"), F.col("dm"), law.d, law.gamma, law.q)) * F.first("area") / n
    return met.groupBy("zone", "id").agg((share * F.first("made")).alias("expected"))


def forecast(found: DataFrame, zones: DataFrame, drivers: int = 3) -> DataFrame:
    """(zone, expected, events, rank, id, part) of contributions: a zone's sum and how many events it is of, and its largest parts, ties to the smaller id.

    A zone that nothing reaches has one row, expected 0 and no driver.
    """
    total = found.groupBy("zone").agg(F.sum("expected").alias("expected"), F.count("*").alias("events"))
    order = W.partitionBy("zone").orderBy(F.round("expected", 9).desc(), "id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= drivers).select("zone", "rank", "id", F.col("expected").alias("part"))
    out = zones.select("zone").join(total, "zone", "left").join(top, "zone", "left")
    return out.select("zone", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("events", F.lit(0)).alias("events"), "rank", "id", "part")
