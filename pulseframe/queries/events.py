"""Joins in time and space, declustering, case-control sampling and point-process scores."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions import geo
from pulseframe.operators import decluster, grid, joins, nulls, stats
from pulseframe.sources.testbed import catalog, daily, field, indicator, large, read

from .base import CAT, DAILY, FIELD, IND, big, hav, query

COLS = ["id", "hour", "lat", "lon", "mag"]


@query(f"WITH {CAT}, {big(0.98)} SELECT a.id AS a, b.id AS b, round({hav('a', 'b')}, 6) AS km FROM big a JOIN big b ON a.id < b.id AND {hav('a', 'b')} <= 1500 AND b.hour - a.hour BETWEEN -1000 AND 1000")
def haversine_pairs(spark, sf):
    b = large(spark, sf, 0.98)
    p = joins.near_pairs(b, joins.second(b, COLS), 1500, (-1000, 1000), F.col("id") < F.col("id2"))
    return p.select(F.col("id").alias("a"), F.col("id2").alias("b"), F.round("km", 6).alias("km"))


@query(f"WITH {CAT}, {big(0.98)} SELECT a.id AS id, count(*) FILTER (b.id IS NOT NULL) AS n, count(*) FILTER (b.hour < a.hour AND b.hour >= a.hour - 72) AS past FROM big a LEFT JOIN cat b ON a.id <> b.id AND {hav('a', 'b')} <= 500 GROUP BY a.id")
def radius_neighbours(spark, sf):
    a = large(spark, sf, 0.98)
    p = joins.near_pairs(a, joins.second(catalog(spark, sf), COLS), 500, None, F.col("id") != F.col("id2"))
    past = (F.col("hour2") < F.col("hour")) & (F.col("hour2") >= F.col("hour") - 72)
    c = p.groupBy("id").agg(F.count("*").alias("n"), F.count_if(past).alias("past"))
    return a.select("id").join(c, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("past", F.lit(0)).alias("past"))


def _followed(spark, sf, km: float, hours: int, q: float):
    """Events with a larger one within km in the next hours, the same hour not counted."""
    c = catalog(spark, sf)
    p = joins.near_pairs(c, joins.second(large(spark, sf, q), COLS), km, (1, hours), F.col("mag2") > F.col("mag"), spread_b=True)
    return c.join(p.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


FOLLOWED = "EXISTS (SELECT 1 FROM {big} b WHERE b.hour - c.hour BETWEEN 1 AND {h} AND b.mag > c.mag AND {hav} <= {km})"


@query(f"WITH {CAT}, {big(0.98)} SELECT id, ({FOLLOWED.format(big='big', h=72, km=300, hav=hav('c', 'b'))})::INTEGER AS foreshock FROM cat c")
def foreshock_label(spark, sf):
    return _followed(spark, sf, 300, 72, 0.98).select("id", F.col("hit").alias("foreshock"))


@query(f"WITH {CAT}, {big(0.9)}, {big(0.99, 'huge')} SELECT h.id, (EXISTS (SELECT 1 FROM big b WHERE h.hour - b.hour BETWEEN 1 AND 48 AND {hav('h', 'b')} <= 800))::INTEGER AS alarmed FROM huge h")
def alarm_hit(spark, sf):
    h, b = large(spark, sf, 0.99), large(spark, sf, 0.9)
    p = joins.near_pairs(h, joins.second(b, COLS), 800, (-48, -1)).select("id").distinct().withColumn("alarmed", F.lit(1))
    return h.select("id").join(p, "id", "left").select("id", F.coalesce("alarmed", F.lit(0)).alias("alarmed"))


@query(f"""WITH {CAT}, {big(0.9)}, p AS (SELECT unnest([100.0, 500.0])::DOUBLE AS km), d AS (SELECT unnest([24, 72])::INTEGER AS hours)
  SELECT km, hours, round(avg((EXISTS (SELECT 1 FROM big b WHERE b.hour - c.hour BETWEEN 1 AND hours AND {hav('c', 'b')} <= km))::INT), 9) AS rate FROM big c, p, d GROUP BY ALL""")
def window_forecast(spark, sf):
    b = large(spark, sf, 0.9)
    p = joins.near_pairs(b, joins.second(b, COLS), 500, (1, 72)).select("id", "km", (F.col("hour2") - F.col("hour")).alias("dh"))
    cells = [(k, h) for k in (100.0, 500.0) for h in (24, 72)]
    best = p.groupBy("id").agg(*[F.max(((F.col("km") <= k) & (F.col("dh") <= h)).cast("int")).alias(f"c{i}") for i, (k, h) in enumerate(cells)])
    all_ = b.select("id").join(best, "id", "left")
    rates = all_.agg(*[F.avg(F.coalesce(f"c{i}", F.lit(0))).alias(f"c{i}") for i in range(len(cells))])
    return rates.select(F.inline(F.array(*[F.struct(F.lit(k).alias("km"), F.lit(h).alias("hours"), F.round(f"c{i}", 9).alias("rate")) for i, (k, h) in enumerate(cells)])))


@query("SELECT o_orderkey, (least(greatest(rint(o_totalprice / 25000), 0), 19))::INTEGER AS cell FROM orders".replace("rint(o_totalprice / 25000)", "round_even(o_totalprice / 25000, 0)"))
def nearest_cell(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.least(F.greatest(F.rint(F.col("o_totalprice") / 25000), F.lit(0.0)), F.lit(19.0)).cast("int").alias("cell"))


def placed(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), (F.col("o_custkey") % 20).cast("int").alias("cell"))


PLACED = FIELD + ", ev AS (SELECT o_orderkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS day, (o_custkey % 20)::INTEGER AS cell FROM orders)"


@query(f"WITH {PLACED} SELECT id, value FROM ev JOIN field ON ev.cell = field.cell AND ev.day = field.dd")
def cell_join(spark, sf):
    return placed(spark, sf).withColumnRenamed("day", "dd").join(field(spark, sf), ["cell", "dd"]).select("id", "value")


@query(f"""WITH {PLACED}, m AS (SELECT id, dd, value, value - lag(value) OVER (PARTITION BY id ORDER BY dd) AS dv FROM ev JOIN field ON ev.cell = field.cell AND field.dd BETWEEN ev.day - 10 AND ev.day - 1)
  SELECT id, count(*) AS n, round(avg(value) + 0.0000123, 4) AS level, round(avg(abs(dv)) + 0.0000123, 4) AS rate FROM m GROUP BY id HAVING count(*) >= 3""")
def lag_window_sample(spark, sf):
    m = joins.lag_window(placed(spark, sf), field(spark, sf), ["cell"], "day", "dd", 1, 10)
    m = m.withColumn("dv", F.col("value") - F.lag("value").over(W.partitionBy("id").orderBy("dd")))
    g = m.groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("level"), F.avg(F.abs("dv")).alias("rate")).where("n >= 3")
    near = lambda c: F.round((F.col(c) + 0.0000123) * 10000.0) / 10000.0  # noqa: E731  # a value next to a tie goes as SQL takes it
    return g.select("id", "n", near("level").alias("level"), near("rate").alias("rate"))


@query(f"""WITH {PLACED}, a AS (SELECT e.id, f.value AS level, 1 AS source FROM ev e LEFT JOIN field f ON e.cell = f.cell AND e.day = f.dd), b AS (SELECT e.id, f.value AS level, 2 AS source FROM ev e LEFT JOIN field f ON (e.cell + 1) % 20 = f.cell AND e.day = f.dd)
  SELECT id, CASE WHEN a.level IS NULL THEN b.level ELSE a.level END AS level, CASE WHEN a.level IS NULL THEN b.source ELSE a.source END AS source FROM a JOIN b USING (id)""")
def field_fallback_merge(spark, sf):
    e = placed(spark, sf).withColumnRenamed("day", "dd")
    take = lambda ev, k: ev.join(field(spark, sf), ["cell", "dd"], "left").select("id", F.col("value").alias("level"), F.lit(k).alias("source"))
    return joins.merge_rows(take(e, 1), take(e.withColumn("cell", (F.col("cell") + 1) % 20), 2), ["id"], "level", ["level", "source"])


ASOF = """c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS pid, user_id, epoch_us(ts) AS pt FROM events WHERE event_type = 'purchase')"""


def _clicks(spark, sf):
    from pulseframe.functions.calendar import micros

    e = read(spark, sf, "events").withColumn("t", micros("ts"))
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", F.col("t").alias("pt"))


@query(f"WITH {ASOF} SELECT event_id, pid, pt FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.pt")
def asof_previous(spark, sf):
    c, p = _clicks(spark, sf)
    return joins.as_of(c, p, ["user_id"], "t", "pt", ["pid"]).select("event_id", "pid", "pt")


@query(f"WITH {ASOF} SELECT event_id, CASE WHEN t - pt <= 86400000000 THEN pid END AS pid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.pt")
def asof_tolerance(spark, sf):
    c, p = _clicks(spark, sf)
    return joins.as_of(c, p, ["user_id"], "t", "pt", ["pid"], F.lit(86_400_000_000)).select("event_id", "pid")


@query(f"""WITH {DAILY}, pts AS (SELECT dd, mx AS v FROM daily WHERE dd % 7 = 0), g AS (SELECT unnest(range((SELECT min(dd) FROM daily), (SELECT max(dd) + 1 FROM daily)))::INTEGER AS dd),
  w AS (SELECT g.dd, a.dd AS d0, a.v AS v0 FROM g ASOF LEFT JOIN pts a ON g.dd >= a.dd), z AS (SELECT w.*, b.dd AS d1, b.v AS v1 FROM w ASOF LEFT JOIN pts b ON w.dd <= b.dd)
  SELECT dd, round(coalesce(v0 + (v1 - v0) * (dd - d0) / nullif(d1 - d0, 0), v0, v1) + 0.0000123, 4) AS v FROM z""")
def lerp_join(spark, sf):
    d = daily(spark, sf)
    g = grid.densify(d, "dd").select("dd")
    return joins.interpolate(g, d.where("dd % 7 = 0").select("dd", F.col("mx").alias("v")), "dd", "v").select("dd", F.round(F.col("interpolated") + 0.0000123, 4).alias("v"))


@query(f"WITH {CAT}, h AS (SELECT hour, max(mag) AS top FROM cat GROUP BY hour) SELECT hour, coalesce(max((top >= 6.5)::INT) OVER (ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0)::INTEGER AS y FROM h")
def forward_label(spark, sf):
    h = catalog(spark, sf).groupBy("hour").agg(F.max("mag").alias("top"))
    return h.select("hour", joins.forward_label(h, F.col("top") >= 6.5, "hour", 24).alias("y"))


@query(f"WITH {CAT}, {big(0.995)} SELECT DISTINCT s::INTEGER AS slot FROM (SELECT unnest(range(hour - 6, hour)) AS s FROM big) WHERE s >= 0")
def slot_label_exclusive(spark, sf):
    return large(spark, sf, 0.995).select(F.explode(F.sequence(F.col("hour") - 6, F.col("hour") - 1)).alias("slot")).where("slot >= 0").distinct()


POOL = f"""{CAT}, {big(0.97)}, k AS (SELECT unnest(range(1, 9)) AS k), cand AS (SELECT id, lat, lon, b.hour AS t, (CASE WHEN k % 2 = 0 THEN b.hour + 24 * k ELSE b.hour - 24 * k END + id % 5)::INTEGER AS hour, k::INTEGER AS k FROM big b, k),
  inside AS (SELECT * FROM cand WHERE hour BETWEEN (SELECT min(hour) FROM cat) AND (SELECT max(hour) FROM cat)), quiet AS (SELECT * FROM inside c WHERE NOT EXISTS (SELECT 1 FROM big b WHERE abs(b.hour - c.hour) <= 6 AND {hav('c', 'b')} <= 300)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY id, k % 2 ORDER BY k) AS i FROM quiet), pool AS (SELECT id, hour, 0 AS is_case FROM ranked WHERE i <= 2 UNION ALL SELECT id, hour, 1 FROM big)"""


def _candidates(spark, sf):
    b = large(spark, sf, 0.97)
    k = F.col("k")
    c = b.select("id", "lat", "lon", "hour", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    moved = F.when(k % 2 == 0, F.col("hour") + 24 * k).otherwise(F.col("hour") - 24 * k) + F.col("id") % 5
    ends = F.broadcast(catalog(spark, sf).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")))  # one row
    return b, c.withColumn("hour", moved.cast("int")).crossJoin(ends).where("hour between lo and hi").drop("lo", "hi")


def _quiet(spark, sf):
    b, c = _candidates(spark, sf)
    keyed = c.withColumn("cid", F.col("id") * 100 + F.col("k"))
    busy = joins.near_pairs(keyed, joins.second(b, COLS), 300, (-6, 6)).select("cid").distinct()
    return b, keyed.join(busy, "cid", "left_anti")


def _pool(spark, sf):
    b, q = _quiet(spark, sf)
    i = F.row_number().over(W.partitionBy("id", F.col("k") % 2).orderBy("k"))
    return q.withColumn("i", i).where("i <= 2").select("id", "hour", F.lit(0).alias("is_case")).union(b.select("id", "hour", F.lit(1)))


@query(f"WITH {POOL} SELECT id, k, hour FROM quiet")
def quiet_anti_join(spark, sf):
    return _quiet(spark, sf)[1].select("id", "k", "hour")


@query(f"WITH {POOL} SELECT id, hour, is_case FROM pool")
def pool_candidates(spark, sf):
    return _pool(spark, sf)


SCORED = POOL + ", s AS (SELECT *, (hour * 7919 + id * 31) % 1009 AS score FROM pool), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hour, is_case) AS rk, count(*) OVER (PARTITION BY id) AS n FROM s)"


def _ranked(spark, sf):
    s = _pool(spark, sf).withColumn("score", (F.col("hour") * 7919 + F.col("id") * 31) % 1009)
    return s.withColumn("rk", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "hour", "is_case"))).withColumn("n", F.count("*").over(W.partitionBy("id")))


@query(f"WITH {SCORED} SELECT id, rk::INTEGER AS rk, n FROM r WHERE is_case = 1")
def pool_rank(spark, sf):
    return _ranked(spark, sf).where("is_case = 1").select("id", "rk", "n")


@query(f"WITH {SCORED} SELECT round(avg(1.0 / rk), 9) AS mrr, round(avg((rk = 1)::INT), 9) AS top1, round(avg(1.0 / n), 9) AS chance FROM r WHERE is_case = 1".replace("1.0 / rk", "1 / rk::DOUBLE").replace("1.0 / n", "1 / n::DOUBLE"))
def mean_reciprocal_rank(spark, sf):
    return _ranked(spark, sf).where("is_case = 1").agg(F.round(F.avg(1 / F.col("rk")), 9).alias("mrr"), F.round(F.avg((F.col("rk") == 1).cast("int")), 9).alias("top1"), F.round(F.avg(1 / F.col("n")), 9).alias("chance"))


@query(f"WITH {SCORED}, x AS (SELECT id, hour, row_number() OVER (PARTITION BY id ORDER BY (hour * 104729 + id) % 10007, hour, is_case) AS i FROM s) SELECT id, hour FROM x WHERE i = 1")
def pool_label_shuffle(spark, sf):
    s = _pool(spark, sf)
    lab = nulls.shuffle_labels(s, "id", F.struct((F.col("hour") * 104729 + F.col("id")) % 10007, "hour", "is_case"))
    return s.withColumn("c", lab).where("c = 1").select("id", "hour")


@query(f"WITH {SCORED}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hour DESC, is_case) AS i FROM s) SELECT id, hour, score, CASE WHEN id % 4 = 0 THEN (i = 1)::INTEGER ELSE is_case END AS is_case FROM w")
def inject_extreme(spark, sf):
    """All pools; in a quarter of them the case is moved to the row with the highest score."""
    s = _pool(spark, sf).withColumn("score", (F.col("hour") * 7919 + F.col("id") * 31) % 1009)
    return nulls.inject_extreme(s, "id", "is_case", [F.desc("score"), F.desc("hour"), F.col("is_case")], F.col("id") % 4 == 0).select("id", "hour", "score", "is_case")


SEASON = IND + """, ev AS (SELECT dd FROM ind WHERE y = 1), s AS (SELECT min(dd) AS t0, max(dd) - min(dd) + 1 AS span FROM ev), r AS (SELECT unnest(range(1, 401)) AS replicate)"""


@query(f"WITH {SEASON} SELECT replicate::INTEGER AS replicate, dd, (t0 + (((dd - t0 + round_even((1 + replicate * 7 % 5) * 365.25::DOUBLE, 0) + (dd * 13 + replicate * 29) % 31 - 15) % span) + span) % span)::INTEGER AS shifted FROM ev, s, r")
def season_shift(spark, sf):
    """Event days moved by whole years and a jitter of fifteen days at most, around the span, 400 times."""
    ev = indicator(spark, sf).where("y = 1").select("dd")
    s = ev.agg(F.min("dd").alias("t0"), (F.max("dd") - F.min("dd") + 1).alias("span"))
    x = ev.crossJoin(F.broadcast(s)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(400))))  # one row
    years, jitter = 1 + F.col("replicate") * 7 % 5, (F.col("dd") * 13 + F.col("replicate") * 29) % 31 - 15
    return x.select("replicate", "dd", nulls.season_shift(F.col("dd"), F.col("t0"), F.col("span"), years, jitter).cast("int").alias("shifted"))


THIN = IND + """, ev AS (SELECT dd, row_number() OVER (ORDER BY dd) AS i FROM ind WHERE y = 1), k AS (SELECT dd, i FROM ev WHERE i = 1 UNION ALL SELECT e.dd, e.i FROM k JOIN LATERAL (SELECT dd, i FROM ev WHERE ev.dd > k.dd + 5 ORDER BY dd LIMIT 1) e ON true)"""


@query(f"WITH RECURSIVE {THIN} SELECT dd FROM k")
def temporal_thinning(spark, sf):
    days = indicator(spark, sf).where("y = 1").groupBy(F.lit(1).alias("g")).agg(F.collect_list("dd").alias("days"))  # days of one series
    return days.select(F.explode(decluster.thin(F.col("days"), 5)).alias("dd"))


@query(f"WITH {IND}, ev AS (SELECT dd, coalesce((dd - lag(dd) OVER (ORDER BY dd) > 5)::INT, 1) AS new FROM ind WHERE y = 1), s AS (SELECT dd, sum(new) OVER (ORDER BY dd) AS session FROM ev) SELECT min(dd) AS lo, max(dd) AS hi, count(*) AS n FROM s GROUP BY session")
def gap_sessions(spark, sf):
    ev = indicator(spark, sf).where("y = 1").select("dd").withColumn("new", F.coalesce((F.col("dd") - F.lag("dd").over(grid.ordered("dd")) > 5).cast("int"), F.lit(1)))
    return ev.withColumn("session", F.sum("new").over(grid.ordered("dd"))).groupBy("session").agg(F.min("dd").alias("lo"), F.max("dd").alias("hi"), F.count("*").alias("n")).drop("session")


def _gk(spark, sf, q: float):
    """Events above a quantile, with the pairs in which a larger (or equal, earlier by id) one covers another."""
    b = large(spark, sf, q).select("id", "hour", "lat", "lon", F.round("mag", 9).alias("mag"))
    first = (F.col("mag") > F.col("mag2")) | ((F.col("mag") == F.col("mag2")) & (F.col("id") < F.col("id2")))
    near = joins.covering_pairs(b, geo.gk_km, geo.gk_days, first & (F.col("id") != F.col("id2")))
    return b, near.select(F.col("id2").alias("id"), F.col("id").alias("by"))


#: The greedy choice one event at a time, in the order i: an event stays unless one that stayed covers it.
GREEDY = """, bys AS MATERIALIZED (SELECT id, list(by_id) AS bys FROM covers GROUP BY id),
  r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT k + 1, CASE WHEN list_has_any(kept, coalesce(bys, [])) THEN kept ELSE list_append(kept, o.id) END FROM r JOIN ordered o ON o.i = r.k + 1 LEFT JOIN bys ON bys.id = o.id),
  last AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1) SELECT id, list_contains(kept, id) AS kept FROM ordered, last"""

GKC = f"""{CAT}, big AS MATERIALIZED (SELECT id, hour, lat, lon, round(mag, 9) AS mag FROM cat WHERE mag >= (SELECT quantile_cont(mag, 0.9) FROM cat)),
  covers AS MATERIALIZED (SELECT b.id AS id, a.id AS by_id FROM big a JOIN big b ON a.id <> b.id AND b.hour >= a.hour AND (a.mag > b.mag OR (a.mag = b.mag AND a.id < b.id)) AND {hav('a', 'b')} <= pow(10, 0.1238 * a.mag + 0.983) AND b.hour - a.hour <= CASE WHEN a.mag >= 6.5 THEN pow(10, 0.032 * a.mag + 2.7389) ELSE pow(10, 0.5409 * a.mag - 0.547) END)"""


@query(f"WITH RECURSIVE {GKC}, ordered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY mag DESC, id) AS i FROM big){GREEDY}")
def gk_decluster(spark, sf):
    b, covers = _gk(spark, sf, 0.9)
    return decluster.resolve(b, covers)


@query(f"WITH {GKC} SELECT id, by_id AS by FROM covers")
def gk_covering_pairs(spark, sf):
    return _gk(spark, sf, 0.9)[1]


@query(f"WITH {GKC}, big2 AS (SELECT * FROM big) SELECT c.id, arg_max(by_id, big2.mag * 1000000 - by_id / 1000000.0::DOUBLE) AS parent FROM covers c JOIN big2 ON big2.id = by_id GROUP BY c.id")
def parent_child(spark, sf):
    b, covers = _gk(spark, sf, 0.9)
    m = covers.join(b.select(F.col("id").alias("by"), "mag"), "by")
    return m.groupBy("id").agg(F.max_by("by", F.struct("mag", -F.col("by"))).alias("parent"))


MARCHITELLI = f"""{CAT}, {big(0.9)}, covers AS MATERIALIZED (SELECT b.id AS id, a.id AS by_id FROM big a JOIN big b ON a.mag >= b.mag AND (a.hour < b.hour OR (a.hour = b.hour AND a.id < b.id)) AND b.hour - a.hour <= 180 AND {hav('a', 'b')} <= 150),
  ordered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY hour, id) AS i FROM big)"""


@query(f"WITH RECURSIVE {MARCHITELLI}{GREEDY}")
def marchitelli_decluster(spark, sf):
    """In the order of time, an event goes if a kept one, as large at least, is within 150 km and 180 hours before."""
    b = large(spark, sf, 0.9)
    first = (F.col("mag") >= F.col("mag2")) & ((F.col("hour") < F.col("hour2")) | ((F.col("hour") == F.col("hour2")) & (F.col("id") < F.col("id2"))))
    covers = joins.near_pairs(b, joins.second(b, COLS), 150.0, (0, 180), first)
    return decluster.resolve(b, covers.select(F.col("id2").alias("id"), F.col("id").alias("by")))


OMORI = CAT + ", h AS (SELECT hour, count(*) AS cnt FROM cat GROUP BY hour)"


@query(f"WITH {OMORI} SELECT i.hour, round(sum(j.cnt * pow(i.hour - j.hour + 0.5, -1.1)), 6) AS rate FROM h i JOIN h j ON j.hour < i.hour AND j.hour >= i.hour - 240 GROUP BY i.hour")
def omori_rate(spark, sf):
    h = catalog(spark, sf).groupBy("hour").agg(F.count("*").alias("cnt"))
    j = h.select(F.col("cnt").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(240))).alias("dt"), (F.col("hour") + F.col("dt")).alias("hour"))
    return h.join(j, "hour").groupBy("hour").agg(F.round(F.sum(F.col("n") * F.pow(F.col("dt") + 0.5, F.lit(-1.1))), 6).alias("rate"))


@query(f"WITH {CAT}, {big(0.97)} SELECT b.id AS target, a.id AS ancestor, (b.hour - a.hour)::INTEGER AS dt, round(a.mag - b.mag, 6) AS dm, round({hav('a', 'b')}, 6) AS dr FROM big a JOIN big b ON b.hour - a.hour BETWEEN 1 AND 120 AND {hav('a', 'b')} <= 1000")
def etas_pairs(spark, sf):
    b = large(spark, sf, 0.97)
    p = joins.near_pairs(b, joins.second(b, COLS), 1000, (1, 120))
    return p.select(F.col("id2").alias("target"), F.col("id").alias("ancestor"), (F.col("hour2") - F.col("hour")).alias("dt"), F.round(F.col("mag") - F.col("mag2"), 6).alias("dm"), F.round("km", 6).alias("dr"))


KERNEL = f"WITH {CAT}, {big(0.97)}, pr AS (SELECT b.id AS id, sum(pow(10, 0.8 * (a.mag - 5)) * pow(b.hour - a.hour + 0.5, -1.1) * pow(pow({hav('a', 'b')}, 2) + 400, -1.5) * 400) AS k FROM big a JOIN big b ON b.hour - a.hour BETWEEN 1 AND 120 AND {hav('a', 'b')} <= 1000 GROUP BY b.id)"


def _kernel(spark, sf):
    b = large(spark, sf, 0.97)
    p = joins.near_pairs(b, joins.second(b, COLS), 1000, (1, 120))
    k = F.pow(F.lit(10.0), 0.8 * (F.col("mag") - 5)) * F.pow(F.col("hour2") - F.col("hour") + 0.5, F.lit(-1.1)) * F.pow(F.col("km") * F.col("km") + 400, F.lit(-1.5)) * 400
    return b, p.groupBy(F.col("id2").alias("id")).agg(F.sum(k).alias("k"))


def hours(spark, sf):
    """How many the catalogue spans."""
    return catalog(spark, sf).agg((F.max("hour") - F.min("hour") + 1).alias("n")).first()["n"] or 0


@query(KERNEL + " SELECT id, round(k, 9) AS k FROM pr")
def spatial_kernel(spark, sf):
    return _kernel(spark, sf)[1].select("id", F.round("k", 9).alias("k"))


@query(KERNEL + ", l AS (SELECT ln(0.001 + 0.01 * coalesce(k, 0)) AS l FROM big LEFT JOIN pr USING (id)) SELECT round(sum(l) - 0.001 * (SELECT max(hour) - min(hour) + 1 FROM cat) * count(*), 6) AS ll, round(avg(l - ln(0.001)), 6) AS gain FROM l")
def point_process_ll(spark, sf):
    b, k = _kernel(spark, sf)
    l = b.select("id").join(k, "id", "left").select(F.log(0.001 + 0.01 * F.coalesce("k", F.lit(0.0))).alias("l"))
    return l.agg(F.round(F.sum("l") - 0.001 * hours(spark, sf) * F.count("*"), 6).alias("ll"), F.round(F.avg(F.col("l") - math.log(0.001)), 6).alias("gain"))


@query(f"WITH {OMORI}, r AS (SELECT i.hour, sum(j.cnt * pow(i.hour - j.hour + 0.5, -1.1)) AS rate FROM h i JOIN h j ON j.hour < i.hour AND j.hour >= i.hour - 48 GROUP BY i.hour), t AS (SELECT quantile_cont(rate, 0.9) AS c90, quantile_cont(rate, 0.5) AS c50 FROM r), {big(0.97)} SELECT count(*) AS n, round(avg((rate >= c90)::INT), 9) AS hit10, round(avg((rate >= c50)::INT), 9) AS hit50 FROM big JOIN r USING (hour), t")
def molchan_hits(spark, sf):
    h = catalog(spark, sf).groupBy("hour").agg(F.count("*").alias("cnt"))
    j = h.select(F.col("cnt").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(48))).alias("dt"), (F.col("hour") + F.col("dt")).alias("hour"))
    r = h.join(j, "hour").groupBy("hour").agg(F.sum(F.col("n") * F.pow(F.col("dt") + 0.5, F.lit(-1.1))).alias("rate"))
    t = r.agg(F.percentile("rate", F.lit(0.9)).alias("c90"), F.percentile("rate", F.lit(0.5)).alias("c50"))
    x = large(spark, sf, 0.97).join(r, "hour").crossJoin(F.broadcast(t))  # one row
    hit = lambda c: F.round(F.avg((F.col("rate") >= F.col(c)).cast("int")), 9)
    return x.agg(F.count("*").alias("n"), hit("c90").alias("hit10"), hit("c50").alias("hit50"))


@query(f"WITH {CAT}, {big(0.97)}, e AS (SELECT a.id AS id, count(b.id) AS seen FROM big a LEFT JOIN cat b ON b.hour - a.hour BETWEEN 1 AND 24 AND {hav('a', 'b')} <= 50 GROUP BY a.id) SELECT count(*) AS n, sum(seen)::BIGINT AS seen, round(avg(seen), 6) AS mean FROM e")
def aftershock_counts(spark, sf):
    a = large(spark, sf, 0.97)
    p = joins.near_pairs(a, joins.second(catalog(spark, sf), COLS), 50.0, (1, 24)).groupBy("id").agg(F.count("*").alias("seen"))
    e = a.select("id").join(p, "id", "left").select(F.coalesce("seen", F.lit(0)).alias("seen"))
    return e.agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), F.round(F.avg("seen"), 6).alias("mean"))


@query(f"WITH {CAT} SELECT (floor((lat + 90) / 10) * 36 + floor((lon + 180) / 10))::INTEGER AS block, count(*) AS n, round(CASE WHEN count(*) >= 12 THEN {math.log10(math.e)!r}::DOUBLE / (avg(mag) - (5.0::DOUBLE - 0.05)) END, 6) AS b FROM cat WHERE mag >= 5 GROUP BY 1")
def b_value_by_cell(spark, sf):
    c = catalog(spark, sf).where("mag >= 5")
    return c.groupBy(geo.block_id(F.col("lat"), F.col("lon")).alias("block")).agg(F.count("*").alias("n"), F.round(stats.b_value(F.col("mag"), 5.0, 0.1, 12), 6).alias("b"))


PHASE = CAT + ", ph AS (SELECT id, kind, mag, (hour * 360.0::DOUBLE / 24.8) % 360 AS phase FROM cat)"


def phased(spark, sf):
    return catalog(spark, sf).withColumn("phase", F.pmod(F.col("hour") * 360.0 / 24.8, F.lit(360.0)))


@query(f"WITH {PHASE}, s AS (SELECT kind, count(*) AS n, sum(sin(radians(phase))) AS s, sum(cos(radians(phase))) AS c FROM ph GROUP BY kind) SELECT kind, n, round(sqrt(s*s + c*c) / n, 6) AS resultant, round(exp(-(s*s + c*c) / n), 6) AS p, round((degrees(atan2(s, c)) + 360) % 360, 4) AS direction FROM s")
def schuster_by_group(spark, sf):
    a = stats.schuster(F.col("phase"))
    return phased(spark, sf).groupBy("kind").agg(a["n"].alias("n"), F.round(a["resultant"], 6).alias("resultant"), F.round(a["p"], 6).alias("p"), F.round(a["direction"], 4).alias("direction"))


@query(f"WITH {PHASE} SELECT floor(phase / 30)::INTEGER AS bin, count(*) AS n, round(100 * (count(*) / (SELECT count(*) / 12.0::DOUBLE FROM ph) - 1), 6) AS excess FROM ph GROUP BY 1")
def phase_hist12(spark, sf):
    p = phased(spark, sf)
    c = p.groupBy(F.floor(F.col("phase") / 30).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(p.agg((F.count("*") / 12).alias("m")))).select("bin", "n", F.round(100 * (F.col("n") / F.col("m") - 1), 6).alias("excess"))  # one row


@query(f"WITH {PHASE} SELECT kind, round(avg(cos(radians(phase - 90))), 9) AS v, round(200 * avg(cos(radians(phase - 90))), 6) AS excess FROM ph GROUP BY kind")
def v_stat(spark, sf):
    return phased(spark, sf).groupBy("kind").agg(F.round(stats.v_stat(F.col("phase"), 90.0), 9).alias("v"), F.round(200 * stats.v_stat(F.col("phase"), 90.0), 6).alias("excess"))


@query(f"WITH {PHASE} SELECT kind, count(*) AS n, round(2.8 / sqrt(count(*)), 9) AS detectable FROM ph GROUP BY kind")
def rayleigh_detectable(spark, sf):
    return phased(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.round(2.8 / F.sqrt(F.count("*")), 9).alias("detectable"))


@query(f"WITH {PHASE}, f AS (SELECT id, unnest(['all', 'strong', 'tropical']) AS subset, unnest([true, mag >= 6, abs(phase - 180) <= 45]) AS inside FROM ph) SELECT subset, count(*) AS n FROM f WHERE inside GROUP BY subset")
def subset_families(spark, sf):
    p = phased(spark, sf)
    s = F.array(*[F.struct(F.lit(k).alias("subset"), c.alias("inside")) for k, c in (("all", F.lit(True)), ("strong", F.col("mag") >= 6), ("tropical", F.abs(F.col("phase") - 180) <= 45))])
    return p.select(F.inline(s)).where("inside").groupBy("subset").agg(F.count("*").alias("n"))
