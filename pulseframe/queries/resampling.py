"""Shifts, redraws, injected signals, their power, folds and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators import grid, joins, nulls
from pulseframe.operators.grid import rank_normal
from pulseframe.plans.modulation import binned_bank, joined_bank
from pulseframe.sources.testbed import bank, catalog, daily, field, indicator, large, read

from .base import BANK, BINNED, CAT, DAILY, FIELD, IND, big, hav, query

COLS = ["id", "hour", "lat", "lon", "mag"]
SPAN = "s AS (SELECT min(hour) AS t0, max(hour) - min(hour) AS span FROM cat)"


def _span(c):
    """One row."""
    return F.broadcast(c.agg(F.min("hour").alias("t0"), (F.max("hour") - F.min("hour")).alias("span")))


def _replicates(df, n: int):
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))


@query(f"WITH {BINNED}, r AS (SELECT dd, family, abs((row_number() OVER (PARTITION BY variable ORDER BY value, dd) - 0.5) / count(*) OVER (PARTITION BY variable) - 0.5) AS x FROM binned) SELECT dd, family, max((x >= 0.45)::INT)::INTEGER AS any_extreme FROM r GROUP BY dd, family")
def family_any_extreme(spark, sf):
    r = joined_bank(spark, sf).select("dd", "family", F.abs(rank_normal("value", "dd", ["variable"]) - 0.5).alias("x"))
    return r.groupBy("dd", "family").agg(F.max((F.col("x") >= 0.45).cast("int")).alias("any_extreme"))


@query(f"WITH {CAT}, {big(0.97)}, {SPAN}, r AS (SELECT unnest(range(1, 6))::INTEGER AS replicate) SELECT replicate, id, (t0 + (hour - t0 + 30 + (replicate * 7919) % (span - 60)) % span)::INTEGER AS hour FROM big, s, r")
def free_time_shift(spark, sf):
    b = _replicates(large(spark, sf, 0.97).crossJoin(_span(catalog(spark, sf))), 5)
    return b.select("replicate", "id", nulls.free_shift(F.col("hour"), F.col("t0"), F.col("span"), F.col("replicate") * 7919, 30).cast("int").alias("hour"))


@query(f"""WITH {CAT}, {big(0.97)}, {SPAN}, r AS (SELECT unnest(range(1, 4))::INTEGER AS replicate),
  p AS (SELECT a.id AS parent, b.id AS id, a.hour AS hour, b.hour - a.hour AS dt FROM big a JOIN cat b ON b.hour - a.hour BETWEEN 1 AND 24 AND {hav('a', 'b')} <= 50)
  SELECT replicate, parent, id, (t0 + (hour - t0 + 30 + (replicate * 7919) % (span - 60)) % span + dt)::INTEGER AS hour FROM p, s, r""")
def parent_shift(spark, sf):
    """Parents move; what follows them keeps its delay."""
    c = catalog(spark, sf)
    p = joins.near_pairs(large(spark, sf, 0.97), joins.second(c, COLS), 50.0, (1, 24))
    p = _replicates(p.crossJoin(_span(c)), 3)
    moved = nulls.free_shift(F.col("hour"), F.col("t0"), F.col("span"), F.col("replicate") * 7919, 30) + F.col("hour2") - F.col("hour")
    return p.select("replicate", F.col("id").alias("parent"), F.col("id2").alias("id"), moved.cast("int").alias("hour"))


PHASES = """beta AS (SELECT unnest([0, 10, 20, 30])::INTEGER AS beta),
phases AS (SELECT beta, user_id, 2 * pi() * ((user_id * 7919 + event_id * 104729) % 100003) / 100003.0::DOUBLE * (1 - beta / 100.0::DOUBLE) AS a FROM beta, events),
trials AS (SELECT beta, user_id, exp(-(pow(sum(cos(a)), 2) + pow(sum(sin(a)), 2)) / count(*)) AS p FROM phases GROUP BY beta, user_id)"""


def _trials(spark, sf):
    """(beta, user_id, p): Schuster's p of as many phases from a portable generator as a user has events, squeezed by beta percent."""
    x = read(spark, sf, "events").select("user_id", "event_id", F.explode(F.array(*map(F.lit, (0, 10, 20, 30)))).alias("beta"))
    a = 2 * math.pi * nulls.lcg((F.col("user_id").cast("long"), 7919), (F.col("event_id").cast("long"), 104729), modulus=100003) / F.lit(100003.0) * (1 - F.col("beta") / F.lit(100.0))
    return x.withColumn("a", a).groupBy("beta", "user_id").agg(F.exp(-(F.pow(F.sum(F.cos("a")), 2) + F.pow(F.sum(F.sin("a")), 2)) / F.count("*")).alias("p"))


@query(f"WITH {PHASES} SELECT user_id, round(p, 6) AS p FROM trials WHERE beta = 0")
def uniform_phase_null(spark, sf):
    return _trials(spark, sf).where("beta = 0").select("user_id", F.round("p", 6).alias("p"))


@query(f"WITH {PHASES} SELECT beta, count(*) AS n, round(avg((p < 0.05)::INT), 6) AS power FROM trials GROUP BY beta")
def detection_power(spark, sf):
    return _trials(spark, sf).groupBy("beta").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") < 0.05).cast("int")), 6).alias("power"))


@query(f"WITH {PHASES} SELECT beta, count(*) AS n, round(min(p), 6) AS least, round(1 - pow(1 - min(p), count(*)), 6) AS corrected FROM trials GROUP BY beta")
def look_elsewhere(spark, sf):
    return _trials(spark, sf).groupBy("beta").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("least"), F.round(1 - F.pow(1 - F.min("p"), F.count("*")), 6).alias("corrected"))


@query(f"WITH {BINNED}, z AS (SELECT dd, variable, pos, avg(y) OVER v AS base, (value - avg(value) OVER v) / nullif(stddev_pop(value) OVER v, 0) AS z FROM binned WINDOW v AS (PARTITION BY variable)) SELECT dd, variable, (((pos * 7919 + 13) % 10007) / 10007.0::DOUBLE < least(1, greatest(0, base * (1 + 0.3 * z))))::INTEGER AS y FROM z WHERE z IS NOT NULL")
def bernoulli_redraw(spark, sf):
    """Events drawn anew, likelier where the series is high."""
    v = W.partitionBy("variable")
    z = binned_bank(spark, sf).select("dd", "variable", "pos", F.avg("y").over(v).alias("base"), ((F.col("value") - F.avg("value").over(v)) / F.nullif(F.stddev_pop("value").over(v), F.lit(0.0))).alias("z"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("base") * (1 + 0.3 * F.col("z"))))
    return z.where("z IS NOT NULL").select("dd", "variable", (nulls.lcg((F.col("pos"), 7919), (F.lit(13), 1)) / F.lit(10007.0) < p).cast("int").alias("y"))


@query(f"WITH {DAILY}, c AS (SELECT dd, sum(cnt) OVER (ORDER BY dd) - cnt AS lo, sum(cnt) OVER (ORDER BY dd) AS hi, sum(cnt) OVER () AS total FROM daily) SELECT k.range::BIGINT AS k, dd FROM range(500) k JOIN c ON (k.range * 7919 + 13) % 10007 * total // 10007 >= lo AND (k.range * 7919 + 13) % 10007 * total // 10007 < hi")
def weighted_redraw(spark, sf):
    draws = spark.range(500).select(F.col("id").alias("k"), nulls.lcg((F.col("id"), 7919), (F.lit(13), 1)).alias("draw"))
    return nulls.redraw_weighted(daily(spark, sf).select("dd", "cnt"), "dd", "cnt", draws, "draw", 10007).select("k", "dd")


@query(f"""WITH {BINNED}, e AS (SELECT variable, dd, row_number() OVER (PARTITION BY variable ORDER BY pos) AS i FROM binned WHERE y = 1 AND pos * 7919 % 10 < 2),
  t AS (SELECT variable, dd AS onto, row_number() OVER (PARTITION BY variable ORDER BY pos * 104729 % 10007, pos) AS i FROM binned WHERE y = 0 AND bin >= 8) SELECT variable, dd, onto FROM e JOIN t USING (variable, i)""")
def inject_top_bins(spark, sf):
    """A fifth of event days move, each to its own quiet day in the two highest bins."""
    b = binned_bank(spark, sf).select("variable", "dd", "pos", "bin", "y")
    at = lambda *order: F.row_number().over(W.partitionBy("variable").orderBy(*order))
    e = b.where("y = 1").where(nulls.lcg((F.col("pos"), 7919), modulus=10) < 2).select("variable", "dd", at("pos").alias("i"))
    t = b.where("y = 0 AND bin >= 8").select("variable", F.col("dd").alias("onto"), at(nulls.lcg((F.col("pos"), 104729)), "pos").alias("i"))
    return e.join(t, ["variable", "i"]).select("variable", "dd", "onto")


@query(f"""WITH {CAT}, {big(0.9)}, k AS (SELECT hour // 24 AS block, hour AS peak FROM cat QUALIFY row_number() OVER (PARTITION BY hour // 24 ORDER BY mag DESC, id) = 1)
  SELECT id, (CASE WHEN id % 5 = 0 THEN peak ELSE hour END)::INTEGER AS hour FROM big JOIN k ON hour // 24 = block""")
def shift_to_extremum(spark, sf):
    """A fifth of events move by the offset to the extremum of their day."""
    block = F.floor(F.col("hour") / 24).alias("block")
    peaks = catalog(spark, sf).groupBy(block).agg(F.max_by("hour", F.struct("mag", -F.col("id"))).alias("peak"))
    b = large(spark, sf, 0.9).select("id", "hour", block)
    return b.join(peaks, "block").select("id", F.when(F.col("id") % 5 == 0, F.col("peak")).otherwise(F.col("hour")).cast("int").alias("hour"))


@query(f"WITH {IND}, k AS (SELECT unnest([1, 2, 3, 4]) AS k) SELECT (dd + k)::INTEGER AS dd, sum(8 // k)::BIGINT AS added FROM ind, k WHERE y = 1 AND dd % 7 = 0 GROUP BY 1")
def plant_bursts(spark, sf):
    """Bursts that decay after some of the event days."""
    e = indicator(spark, sf).where("y = 1 AND dd % 7 = 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return e.groupBy((F.col("dd") + F.col("k")).alias("dd")).agg(F.sum(F.floor(F.lit(8) / F.col("k"))).alias("added"))


@query(f"WITH {IND}, {BANK}, w AS (SELECT min(dd) AS lo, max(dd) AS hi FROM ind WHERE y = 1) SELECT family, count(*) AS n, count(*) FILTER (dd BETWEEN lo AND hi) AS n_in, round((1.96 + 0.84) / sqrt(count(*)), 6) AS detectable FROM bank, w GROUP BY family")
def coverage_by_family(spark, sf):
    w = indicator(spark, sf).where("y = 1").agg(F.min("dd").alias("lo"), F.max("dd").alias("hi"))
    b = bank(spark, sf).crossJoin(F.broadcast(w))  # one row
    return b.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("dd").between(F.col("lo"), F.col("hi"))).alias("n_in"), F.round((1.96 + 0.84) / F.sqrt(F.count("*")), 6).alias("detectable"))


@query(f"""WITH {IND}, r AS (SELECT dd, y, row_number() OVER (ORDER BY dd) AS i, count(*) OVER () AS n FROM ind), f AS (SELECT unnest([1, 2, 3, 4]) AS fold)
  SELECT fold::INTEGER AS fold, count(*) FILTER (i <= n * fold // 5 - 10) AS n_train, count(*) FILTER (i > n * fold // 5) AS n_test, sum(y) FILTER (i > n * fold // 5)::BIGINT AS events FROM r, f WHERE i <= n * (fold + 1) // 5 GROUP BY fold""")
def expanding_folds(spark, sf):
    """Each fold trains on all before it but a gap of ten rows."""
    r = indicator(spark, sf).select("y", F.row_number().over(grid.ordered("dd")).alias("i"), F.count("*").over(W.partitionBy(F.lit(0))).alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(4))))
    cut = F.floor(F.col("n") * F.col("fold") / 5)
    r = r.where(F.col("i") <= F.floor(F.col("n") * (F.col("fold") + 1) / 5))
    return r.groupBy("fold").agg(F.count_if(F.col("i") <= cut - 10).alias("n_train"), F.count_if(F.col("i") > cut).alias("n_test"), F.sum(F.when(F.col("i") > cut, F.col("y"))).alias("events"))


@query(f"WITH {IND} SELECT ((dd * 7919 + 13) % 10007 < 3002)::BOOLEAN AS test, count(*) AS n, sum(y)::BIGINT AS events FROM ind GROUP BY 1")
def random_split(spark, sf):
    return indicator(spark, sf).groupBy((nulls.lcg((F.col("dd"), 7919), (F.lit(13), 1)) < 3002).alias("test")).agg(F.count("*").alias("n"), F.sum("y").alias("events"))


@query(f"WITH {FIELD}, t AS (SELECT count(DISTINCT dd) AS days FROM field) SELECT cell, count(*) AS n, min(dd) AS lo, max(dd) AS hi, (count(*) = any_value(days))::BOOLEAN AS whole FROM field, t GROUP BY cell ORDER BY n, cell LIMIT 8")
def worst_coverage(spark, sf):
    """The eight cells with the fewest days."""
    f = field(spark, sf)
    t = f.agg(F.count_distinct("dd").alias("days"))
    c = f.groupBy("cell").agg(F.count("*").alias("n"), F.min("dd").alias("lo"), F.max("dd").alias("hi")).crossJoin(F.broadcast(t))  # one row
    return c.select("cell", "n", "lo", "hi", (F.col("n") == F.col("days")).alias("whole")).orderBy("n", "cell").limit(8)


@query(f"""WITH {CAT}, e AS (SELECT *, max(hour) OVER () AS h1 FROM cat), z AS (SELECT (floor((lat + 90) / 10) * 36 + floor((lon + 180) / 10))::INTEGER AS block, count(*) AS n, count(*) FILTER (hour > h1 - 100) AS recent, round(max(mag) FILTER (hour > h1 - 100), 6) AS top FROM e GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY recent / n::DOUBLE DESC, block)::INTEGER AS rank FROM z""")
def zone_rank(spark, sf):
    """Zones by how much of their activity is recent; zones are as many as blocks of ten degrees."""
    c = catalog(spark, sf)
    e = c.crossJoin(F.broadcast(c.agg(F.max("hour").alias("h1"))))  # one row
    recent = F.col("hour") > F.col("h1") - 100
    block = (F.floor((F.col("lat") + 90) / 10) * 36 + F.floor((F.col("lon") + 180) / 10)).cast("int")
    z = e.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"), F.round(F.max(F.when(recent, F.col("mag"))), 6).alias("top"))
    return z.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy((F.col("recent") / F.col("n")).desc(), "block")))


@query(f"""WITH {CAT}, corner AS (SELECT id, (floor(lat / 10) + a)::INTEGER AS i, ((floor(lon / 10) + b)::INTEGER + 36) % 36 AS j, abs(1 - a - (lat / 10 - floor(lat / 10))) * abs(1 - b - (lon / 10 - floor(lon / 10))) AS w FROM cat, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  node AS (SELECT i.range - 9 AS i, j.range AS j, ((i.range - 9) * 7 + j.range * 13 + 100) % 17 AS v FROM range(19) i, range(36) j WHERE (i.range + j.range) % 11 <> 0)
  SELECT id, round(sum(w * v) / nullif(sum(w), 0), 6) AS v FROM corner JOIN node USING (i, j) GROUP BY id""")
def bilinear_corners(spark, sf):
    """Four corners each, joined on equality; undefined nodes are left out and weights made to sum to one again."""
    node = spark.range(19 * 36).select((F.floor(F.col("id") / 36) - 9).cast("int").alias("i"), (F.col("id") % 36).cast("int").alias("j")).where((F.col("i") + 9 + F.col("j")) % 11 != 0)
    node = node.withColumn("v", (F.col("i") * 7 + F.col("j") * 13 + 100) % 17)
    y, x = F.col("lat") / 10, F.col("lon") / 10
    corners = [F.struct((F.floor(y) + a).cast("int").alias("i"), F.pmod(F.floor(x) + b, F.lit(36)).cast("int").alias("j"), (F.abs(1 - a - (y - F.floor(y))) * F.abs(1 - b - (x - F.floor(x)))).alias("w")) for a in (0, 1) for b in (0, 1)]
    met = catalog(spark, sf).select("id", F.inline(F.array(*corners))).join(F.broadcast(node), ["i", "j"])  # the grid's 684 nodes
    return met.groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0)), 6).alias("v"))


@query(f"WITH {IND}, e AS (SELECT dd, max(CASE WHEN y = 1 THEN dd END) OVER (ORDER BY dd) AS before, min(CASE WHEN y = 1 THEN dd END) OVER (ORDER BY dd ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM ind) SELECT dd, before, after, round((dd - before) / (after - before)::DOUBLE, 6) AS share FROM e WHERE before IS NOT NULL AND after IS NOT NULL")
def phase_bracket(spark, sf):
    """Each day between the phase days around it."""
    at = F.when(F.col("y") == 1, F.col("dd"))
    w = W.partitionBy(F.lit(0)).orderBy("dd")
    e = indicator(spark, sf).select("dd", F.max(at).over(w).alias("before"), F.min(at).over(w.rowsBetween(1, W.unboundedFollowing)).alias("after")).where("before IS NOT NULL AND after IS NOT NULL")
    return e.withColumn("share", F.round((F.col("dd") - F.col("before")) / (F.col("after") - F.col("before")), 6))


@query(f"WITH {CAT}, {big(0.98)} SELECT a.id AS id, count(*) FILTER (a.hour - b.hour <= 24) AS n24, count(*) FILTER (a.hour - b.hour <= 168) AS n168, count(b.id) AS n720, min(a.hour - b.hour)::INTEGER AS since FROM big a LEFT JOIN cat b ON a.hour - b.hour BETWEEN 1 AND 720 AND {hav('a', 'b')} <= 300 GROUP BY a.id")
def causal_neighbours(spark, sf):
    """Only what came strictly before counts."""
    a = large(spark, sf, 0.98)
    p = joins.near_pairs(a, joins.second(catalog(spark, sf), COLS), 300.0, (-720, -1)).withColumn("dt", F.col("hour") - F.col("hour2"))
    p = p.groupBy("id").agg(F.count_if(F.col("dt") <= 24).alias("n24"), F.count_if(F.col("dt") <= 168).alias("n168"), F.count("*").alias("n720"), F.min("dt").alias("since"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n24", "n168", "n720")]
    return a.select("id").join(p, "id", "left").select("id", *zero, "since")


@query(f"""WITH {CAT}, {big(0.97)}, e AS (SELECT a.id AS id, a.mag AS mag, count(b.id) AS seen FROM big a LEFT JOIN cat b ON b.hour - a.hour BETWEEN 1 AND 168 AND {hav('a', 'b')} <= 50 GROUP BY a.id, a.mag)
  SELECT (floor(mag * 10))::INTEGER AS tenth, count(*) AS n, sum(seen)::BIGINT AS seen, round(sum(0.05 * pow(10, 0.7 * (mag - 5))), 6) AS expected FROM e GROUP BY 1""")
def aftershock_verification(spark, sf):
    """Followers within 50 km and 168 hours against those that the productivity law expects."""
    a = large(spark, sf, 0.97)
    p = joins.near_pairs(a, joins.second(catalog(spark, sf), COLS), 50.0, (1, 168)).groupBy("id").agg(F.count("*").alias("seen"))
    e = a.select("id", "mag").join(p, "id", "left")
    return e.groupBy(F.floor(F.col("mag") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"), F.sum(F.coalesce("seen", F.lit(0))).alias("seen"), F.round(F.sum(0.05 * F.pow(F.lit(10.0), 0.7 * (F.col("mag") - 5))), 6).alias("expected"))


@query("SELECT event_id, round(value * 98.07, 6) AS water_pa, round(value * 100, 6) AS pressure_pa, round(value / 10, 6) AS tecu, round(value * 149597870.7, 3) AS km FROM events")
def unit_conversions(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", F.round(v * 98.07, 6).alias("water_pa"), F.round(v * 100, 6).alias("pressure_pa"), F.round(v / 10, 6).alias("tecu"), F.round(v * 149597870.7, 3).alias("km"))


@query("SELECT CASE WHEN year(o_orderdate) < 1997 THEN 'early' WHEN year(o_orderdate) < 2000 THEN 'middle' ELSE 'late' END AS era, month(o_orderdate)::INTEGER AS m, count(*) AS n, count(*) FILTER (o_totalprice IS NULL OR o_totalprice <= 0 OR o_custkey IS NULL) AS violations FROM orders GROUP BY ALL")
def era_groups(spark, sf):
    y = F.year("o_orderdate")
    bad = F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0) | F.col("o_custkey").isNull()
    return read(spark, sf, "orders").groupBy(F.when(y < 1997, "early").when(y < 2000, "middle").otherwise("late").alias("era"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"))
