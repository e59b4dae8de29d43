"""Forecasts by zones, alarms as streams with timers, polled streams and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import calendar, tables
from pulseframe.functions.calendar import slot
from pulseframe.plans import zones
from pulseframe.sources import polled
from pulseframe.sources.testbed import catalog, large, read
from pulseframe.streaming import alarms
from pulseframe.streaming import counterparts as st

from .base import CAT, big, query
from .files import folder

BOXES = [("north", 5.0, 30.0, 90.0, 140.0), ("south", -35.0, -5.0, 90.0, 140.0), ("west", -50.0, 10.0, -85.0, -60.0), ("middle", -20.0, 20.0, -30.0, 30.0), ("small", 9.0, 11.0, 19.0, 21.0), ("pole", 85.0, 89.0, 0.0, 10.0)]
LAW = zones.Triggering(m0=5.0, k=0.02, alpha=1.4, c=0.05, p=1.25, d=12.0, gamma=0.5, q=1.6)
POINTS, TAIL, MEMORY = 200, 0.01, 30.0


def _inverse(base: int, digits: int) -> str:
    return " + ".join(f"((i // {base**k}) % {base}) / {base ** (k + 1)}::DOUBLE" for k in range(digits))


@query(f"""WITH {CAT}, {big(0.9)}, z(zone, a, b, c, d) AS (VALUES {", ".join(f"('{z}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for z, a, b, c, d in BOXES)}), q AS (SELECT unnest(range({POINTS})) AS i),
  p AS (SELECT zone, (a + (b - a) * ({_inverse(2, 8)})) * 111.19::DOUBLE AS y, (c + (d - c) * ({_inverse(3, 5)})) * 111.19::DOUBLE AS x, (b - a) * (d - c) * 111.19::DOUBLE * 111.19::DOUBLE AS area FROM z, q),
  e AS (SELECT *, (t1 - hour) / 24::DOUBLE AS age, mag - 5 AS dm, lon * 111.19::DOUBLE AS ex, lat * 111.19::DOUBLE AS ey, 144 * pow(10, 0.5::DOUBLE * (mag - 5)) AS w FROM big, (SELECT max(hour) AS t1 FROM cat) WHERE mag >= 5 AND (t1 - hour) / 24::DOUBLE < {MEMORY}),
  m AS (SELECT zone, id, age, dm, w, area, pow(x - ex, 2) + pow(y - ey, 2) AS r2 FROM p, e),
  f AS (SELECT zone, id, sum(0.6::DOUBLE / (pi() * w) * pow(1 + r2 / w, -1.6::DOUBLE)) * any_value(area) / {POINTS} * any_value(0.02::DOUBLE * exp(1.4::DOUBLE * dm) * (pow(age + 7 + 0.05::DOUBLE, -0.25::DOUBLE) - pow(age + 0.05::DOUBLE, -0.25::DOUBLE)) / -0.25::DOUBLE) AS part
    FROM m WHERE sqrt(r2) <= sqrt(w) * sqrt(pow({TAIL}, 1 / -0.6::DOUBLE) - 1) GROUP BY zone, id),
  s AS (SELECT zone, sum(part) AS expected, count(*) AS events FROM f GROUP BY zone), t AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY round(part, 9) DESC, id) AS rank FROM f)
  SELECT z.zone, round(coalesce(expected, 0), 6) AS expected, coalesce(events, 0) AS events, rank::INTEGER AS rank, id, round(part, 6) AS part FROM z LEFT JOIN s USING (zone) LEFT JOIN (SELECT * FROM t WHERE rank <= 3) t ON t.zone = z.zone""")
def zone_forecast(spark, sf):
    """Events expected in each zone in the seven days after the catalogue, triggered by those of its last thirty days, and their three main drivers."""
    boxes = spark.createDataFrame(BOXES, "zone string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    b = large(spark, sf, 0.9).select("id", (F.col("hour") / 24).alias("day"), "lat", "lon", "mag")
    end = catalog(spark, sf).agg((F.max("hour") / 24).alias("t")).first()["t"] or 0.0
    found = zones.contributions(b, boxes, end, 7.0, LAW, n=POINTS, memory=MEMORY, tail=TAIL)
    return zones.forecast(found, boxes).select("zone", F.round("expected", 6).alias("expected"), "events", "rank", "id", F.round("part", 6).alias("part"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id AS id, event_type = 'purchase' AS up FROM events), w AS (SELECT (max(t) // 1000 - 6 * 3600000) * 1000 AS seen FROM e),
  s AS (SELECT *, coalesce((t > lag(t) OVER (PARTITION BY user_id ORDER BY t, id) + 129600000000)::INT, 1) AS new FROM e WHERE up), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM s),
  a AS (SELECT user_id, k, min(t) AS opened, min((t, id)) AS head, max(t) + 129600000000 AS closed, count(*) AS triggers FROM k GROUP BY user_id, k), g AS (SELECT *, opened - lag(closed) OVER (PARTITION BY user_id ORDER BY k) AS quiet FROM a)
  SELECT g.user_id, opened, closed, triggers, count(e.id) AS events, quiet FROM g JOIN w ON closed <= seen LEFT JOIN e ON e.user_id = g.user_id AND NOT e.up AND (e.t, e.id) > head AND e.t <= closed GROUP BY ALL""")
def streaming_alarms(spark, sf):
    """Alarms of 36 hours after each user's purchases, prolonged by further ones and closed by timers; those open when the stream ends aren't given."""
    e = st.source(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("trigger"))
    return st.replay(alarms.alarms(e, 36), timers=True)


@query("SELECT (epoch_us(ts) // 86400000000)::BIGINT AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def polled_days(spark, sf):
    """Daily sums of a stream that polls for whole days."""
    e = read(spark, sf, "events").select("event_id", "event_type", "value", slot("ts", 24).alias("day"))
    path = folder(spark, "polled")
    polled.add_periods(e, path, "day")
    out = st.replay(polled.poll(spark, path, "day long, event_id long, event_type string, value double", "day"))
    return out.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT o_custkey::VARCHAR AS file, o_orderkey AS order_key, count(l_orderkey) AS lines, round(sum(l_quantity), 4)::DOUBLE AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def multiline_records(spark, sf):
    """Orders as records over several lines, a report for each customer, read back by a table function in SQL."""
    o, i = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    file = F.col("o_custkey").cast("string").alias("file")
    heads = o.select(file, F.col("o_orderkey").alias("k"), F.lit(0).alias("j"), F.concat(F.lit("# order "), F.col("o_orderkey").cast("string")).alias("value"))
    body = i.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(file, F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("j"), F.concat_ws(" ", F.lit("  item"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    tables.register(spark)
    rows = heads.unionByName(body)
    found = spark.sql("SELECT * FROM multiline_records(TABLE(SELECT file, k, j, value FROM {rows}) PARTITION BY (file) ORDER BY (k, j), '# order')", rows=rows)
    return found.select("file", F.col("head").cast("long").alias("order_key"), "lines", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000)::INT, 1) AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM k GROUP BY user_id, k""")
def quiet_runs(spark, sf):
    """Stretches of a user's events without a pause of more than twelve hours, by a table function in SQL."""
    tables.register(spark)
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), calendar.micros("ts").alias("at"))
    found = spark.sql("SELECT * FROM quiet_runs(TABLE(SELECT * FROM {e}) PARTITION BY (key) ORDER BY (at), 43200000000)", e=e)
    return found.withColumnRenamed("key", "user_id")
