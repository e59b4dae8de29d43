"""Scans, grids and ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.calendar import slot
from pulseframe.operators import grid, spectral
from pulseframe.sources.testbed import bank, catalog, daily, field, read

from .base import BANK, CAT, DAILY, FIELD, query

DENSE = DAILY + ", span AS (SELECT min(dd) AS lo, max(dd) AS hi FROM daily), dense AS (SELECT g.dd::INTEGER AS dd, cnt, mx FROM (SELECT unnest(range(lo, hi + 1)) AS dd FROM span) g LEFT JOIN daily USING (dd))"


def dense(spark, sf):
    return grid.densify(daily(spark, sf), "dd")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 100")
def scan_filter_project(spark, sf):
    return read(spark, sf, "events").where("event_type = 'purchase' AND value >= 100").select("event_id", "user_id", "value")


@query("SELECT event_id, CASE WHEN value > 400 THEN NULL ELSE value END AS value, nullif(event_type, 'error') AS kind FROM events")
def sentinel_nulls(spark, sf):
    return read(spark, sf, "events").select("event_id", F.when(F.col("value") <= 400, F.col("value")).alias("value"), F.nullif("event_type", F.lit("error")).alias("kind"))


@query(f"WITH {CAT} SELECT id, hour, lat, lon FROM cat WHERE kind = 'click' AND mag >= 5 AND lat BETWEEN -30 AND 30 AND lon BETWEEN -100 AND 100")
def type_threshold_box(spark, sf):
    return catalog(spark, sf).where("kind = 'click' AND mag >= 5 AND lat BETWEEN -30 AND 30 AND lon BETWEEN -100 AND 100").select("id", "hour", "lat", "lon")


@query("SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS dd, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def daily_mean_grid(spark, sf):
    return read(spark, sf, "events").where("value IS NOT NULL").groupBy(F.unix_date(F.col("ts").cast("date")).alias("dd")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {DENSE} SELECT dd, coalesce(cnt, 0)::BIGINT AS cnt, (coalesce(cnt, 0) > 0)::INTEGER AS y FROM dense")
def daily_count_dense(spark, sf):
    return dense(spark, sf).select("dd", F.coalesce("cnt", F.lit(0)).alias("cnt"), (F.coalesce("cnt", F.lit(0)) > 0).cast("int").alias("y"))


@query("SELECT (epoch_us(ts) // 10800000000)::BIGINT AS slot, max(value) AS top FROM events GROUP BY 1")
def block_max_3h(spark, sf):
    return grid.block_reduce(read(spark, sf, "events"), slot("ts", 3).alias("slot"), [], top=F.max("value"))


GAPPY = DENSE + ", gap AS (SELECT dd, CASE WHEN dd % 3 = 0 THEN mx END AS v FROM dense)"


def gappy(spark, sf):
    return dense(spark, sf).select("dd", F.when(F.col("dd") % 3 == 0, F.col("mx")).alias("v"))


@query(f"WITH {GAPPY}, f AS (SELECT dd, last_value(v IGNORE NULLS) OVER (ORDER BY dd ROWS UNBOUNDED PRECEDING) AS f FROM gap) SELECT dd, coalesce(f, (SELECT quantile_cont(f, 0.5) FROM f), 0) AS filled FROM f")
def ffill_median(spark, sf):
    return grid.fill_with_median(gappy(spark, sf), "v", "dd", "filled").select("dd", "filled")


@query(f"WITH {DAILY} SELECT dd, round(coalesce(mx - lag(mx) OVER (ORDER BY dd), 0), 6) AS d FROM daily")
def backward_diff(spark, sf):
    return daily(spark, sf).select("dd", F.round(grid.backward_difference("mx", "dd"), 6).alias("d"))


@query(f"WITH {DAILY} SELECT dd, round(CASE WHEN lag(mx) OVER w IS NULL THEN lead(mx) OVER w - mx WHEN lead(mx) OVER w IS NULL THEN mx - lag(mx) OVER w ELSE (lead(mx) OVER w - lag(mx) OVER w) / 2 END, 6) AS d FROM daily WINDOW w AS (ORDER BY dd)")
def central_diff(spark, sf):
    return daily(spark, sf).select("dd", F.round(grid.central_difference("mx", "dd"), 6).alias("d"))


@query(f"WITH {DAILY} SELECT dd, round(sum(mx) OVER (ORDER BY dd ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS s FROM daily")
def box_smooth(spark, sf):
    return daily(spark, sf).select("dd", F.round(grid.box_smooth("mx", "dd", 7), 6).alias("s"))


@query(f"WITH {FIELD} SELECT cell, dd, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY cell ORDER BY dd ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 4) AS a FROM field")
def running_median_anomaly(spark, sf):
    return field(spark, sf).select("cell", "dd", F.round(grid.median_anomaly("value", "dd", 15, ["cell"]), 4).alias("a"))


@query(f"""WITH {FIELD}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER p AS n, first_value(value) OVER w AS v0, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1,
  sum(value) OVER (w ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS s FROM field WINDOW w AS (PARTITION BY cell ORDER BY dd), p AS (PARTITION BY cell))
  SELECT cell, dd, round(value - (s + greatest(0, 15 - (i - 1)) * v0 + greatest(0, 14 - (n - i)) * v1) / 30 + 0.0000123, 4) AS a FROM r""")
def running_mean_anomaly(spark, sf):
    return field(spark, sf).select("cell", "dd", F.round(grid.mean_anomaly("value", "dd", 30, ["cell"]) + 0.0000123, 4).alias("a"))


@query(f"WITH {FIELD}, g AS (SELECT cell, dd, CASE WHEN dd % 5 <> 0 THEN value END AS v FROM field) SELECT cell, dd, round(v - sum(coalesce(v, 0)) OVER (PARTITION BY cell ORDER BY dd ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30 + 0.0000123, 4) AS a FROM g")
def running_mean_nullzero(spark, sf):
    f = field(spark, sf).select("cell", "dd", F.when(F.col("dd") % 5 != 0, F.col("value")).alias("v"))
    return f.select("cell", "dd", F.round(grid.mean_anomaly_nullzero("v", "dd", 30, ["cell"]) + 0.0000123, 4).alias("a"))


@query(f"WITH {DENSE} SELECT dd, coalesce(sum(coalesce(cnt, 0)) OVER (ORDER BY dd ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past7, coalesce(sum(coalesce(cnt, 0)) OVER (ORDER BY dd ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past30 FROM dense")
def rolling_past_counts(spark, sf):
    d = dense(spark, sf).withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return d.select("dd", grid.past_sum("cnt", "dd", 7).alias("past7"), grid.past_sum("cnt", "dd", 30).alias("past30"))


@query(f"WITH {DENSE} SELECT dd, coalesce(least(dd - max(CASE WHEN mx >= 400000 THEN dd END) OVER (ORDER BY dd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 60), 60)::INTEGER AS since FROM dense")
def days_since_last(spark, sf):
    return dense(spark, sf).select("dd", grid.since_last(F.col("mx") >= 400000, "dd", 60).cast("int").alias("since"))


HOURLY = CAT + ", hourly AS (SELECT hour, count(*) AS cnt, max(mag) AS top FROM cat GROUP BY hour)"


def hourly(spark, sf):
    return catalog(spark, sf).groupBy("hour").agg(F.count("*").alias("cnt"), F.max("mag").alias("top"))


@query(f"WITH {HOURLY} SELECT hour, round(max(top) OVER w, 6) AS past_max, round(sum(pow(10, 0.7 * greatest(top - 6, 0))) OVER w, 6) AS productivity FROM hourly WINDOW w AS (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def rolling_max_productivity(spark, sf):
    h = hourly(spark, sf).withColumn("p", F.pow(F.lit(10.0), 0.7 * F.greatest(F.col("top") - 6, F.lit(0.0))))
    w = grid.ordered("hour").rowsBetween(-24, -1)
    return h.select("hour", F.round(F.max("top").over(w), 6).alias("past_max"), F.round(F.sum("p").over(w), 6).alias("productivity"))


@query(f"WITH {HOURLY} SELECT hour, round(max(top) OVER w, 6) AS w_max, round(avg(top) OVER w, 6) AS w_mean, round(stddev_pop(top) OVER w, 6) AS w_sd, round(last_value(top) OVER w, 6) AS w_last, round(last_value(top) OVER w - first_value(top) OVER w, 6) AS w_change, round(quantile_cont(top, 0.9) OVER w, 6) AS w_p90, round(min(top) OVER w, 6) AS w_min FROM hourly WINDOW w AS (ORDER BY hour ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)")
def window7_summaries(spark, sf):
    return hourly(spark, sf).select("hour", *[F.round(c, 6).alias(k) for k, c in grid.window_summaries("top", "hour", 48).items()])


@query(f"WITH {HOURLY} SELECT hour, array_to_string(list(cnt) OVER (ORDER BY hour ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), ',') AS lags FROM hourly WHERE true QUALIFY row_number() OVER (ORDER BY hour) > 48")
def lag_vector48(spark, sf):
    h = hourly(spark, sf).withColumn("lags", F.array_join(grid.lag_vector("cnt", "hour", 48).cast("array<string>"), ",")).withColumn("i", F.row_number().over(grid.ordered("hour")))
    return h.where("i > 48").select("hour", "lags")


@query(f"WITH {BANK} SELECT variable, dd, round((row_number() OVER (PARTITION BY variable ORDER BY value, dd) - 0.5) / count(*) OVER (PARTITION BY variable), 9) AS r FROM bank")
def rank_normalise(spark, sf):
    return bank(spark, sf).select("variable", "dd", F.round(grid.rank_normal("value", "dd", ["variable"]), 9).alias("r"))


@query(f"""WITH {BANK}, g AS (SELECT variable, dd, CASE WHEN dd BETWEEN 9200 AND 11000 THEN value ELSE 0 END AS value FROM bank),
  c AS (SELECT *, coalesce(value <> lag(value) OVER (PARTITION BY variable ORDER BY dd), false) AS ch FROM g),
  s AS (SELECT variable, min(CASE WHEN ch THEN dd END) AS lo, max(CASE WHEN ch THEN dd END) AS hi, sum(ch::INT) / (count(*) - 1)::DOUBLE AS share FROM c GROUP BY variable)
  SELECT variable, dd, CASE WHEN share >= 0.98 THEN true WHEN lo IS NULL THEN false ELSE dd BETWEEN lo - 1 AND hi END AS valid FROM c JOIN s USING (variable)""")
def valid_span_mask(spark, sf):
    g = bank(spark, sf).withColumn("value", F.when(F.col("dd").between(9200, 11000), F.col("value")).otherwise(0.0))
    return grid.valid_span(g, "value", "dd", ["variable"]).select("variable", "dd", "valid")


@query(f"""WITH {BANK} SELECT DISTINCT variable FROM bank WHERE variable IN (SELECT variable FROM bank GROUP BY variable HAVING count(*) FILTER (value IS NULL) = 0 AND max(value) - min(value) > 0)""")
def finite_varying_variables(spark, sf):
    b = bank(spark, sf)
    ok = b.groupBy("variable").agg(F.count_if(F.col("value").isNull()).alias("holes"), (F.max("value") - F.min("value")).alias("range")).where("holes = 0 and range > 0")
    return b.join(ok, "variable", "left_semi").select("variable").distinct()


@query(f"""WITH {DAILY}, m AS (SELECT avg(mx) AS m FROM daily), l AS (SELECT mx - m AS x, lead(mx) OVER (ORDER BY dd) - m AS nx FROM daily, m) SELECT round(sum(x * nx) / sum(x * x), 6) AS r FROM l""")
def autocorr_lag1(spark, sf):
    d = daily(spark, sf)
    m = d.crossJoin(F.broadcast(d.agg(F.avg("mx").alias("m"))))  # one row
    x = m.select((F.col("mx") - F.col("m")).alias("x"), (F.lead("mx").over(grid.ordered("dd")) - F.col("m")).alias("nx"))
    return x.agg(F.round(F.sum(F.col("x") * F.col("nx")) / F.sum(F.col("x") * F.col("x")), 6).alias("r"))


@query(f"WITH {DAILY} SELECT round(regr_r2(mx, dd), 9) AS r2, round(regr_slope(mx, dd), 6) AS slope FROM daily")
def trend_r2(spark, sf):
    return daily(spark, sf).agg(F.round(F.regr_r2("mx", "dd"), 9).alias("r2"), F.round(F.regr_slope("mx", "dd"), 6).alias("slope"))


@query(f"""WITH {DENSE}, z AS (SELECT pow(2, floor(log2(count(*))))::BIGINT AS n FROM dense), s AS (SELECT (dd - (SELECT lo FROM span))::INTEGER AS t, coalesce(cnt, 0)::DOUBLE AS v, n FROM dense, z WHERE dd - (SELECT lo FROM span) < n),
  f AS (SELECT k, pow(sum(v * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * t) % n) / n)), 2) AS p FROM s, (SELECT unnest(range(1, (SELECT n FROM z) // 2 + 1)) AS k) GROUP BY k),
  r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS i, sum(p) OVER () AS t FROM f) SELECT round(sum(p) FILTER (i <= 5) / max(t), 6) AS share FROM r""")
def spectral_top5(spark, sf):
    d = dense(spark, sf)
    lo = d.agg(F.min("dd").alias("lo"))
    s = d.crossJoin(F.broadcast(lo)).select((F.col("dd") - F.col("lo")).alias("t"), F.coalesce("cnt", F.lit(0)).alias("v"))  # one row
    p = spectral.power(s, "t", "v", []).select(F.col("power").alias("p"))
    top = p.select("p", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("p"))).alias("i"))  # half as many rows as days
    return top.agg(F.round(F.sum(F.when(F.col("i") <= 5, F.col("p"))) / F.sum("p"), 6).alias("share"))


@query(f"""WITH {DAILY}, p AS (SELECT dd, mx, 2 * pi() * ((dd * 100) % 365) / 365 AS a FROM daily), d AS (SELECT dd, a, coalesce(a - lag(a) OVER (ORDER BY dd), 0) AS da FROM p)
  SELECT dd, round(a + sum(CASE WHEN da > pi() THEN -2 * pi() WHEN da < -pi() THEN 2 * pi() ELSE 0 END) OVER (ORDER BY dd), 6) AS u FROM d""")
def unwrap_angle(spark, sf):
    from pulseframe.functions.circular import unwrap_step

    d = daily(spark, sf).select("dd", (2 * F.pi() * F.pmod(F.col("dd") * 100, F.lit(365)) / 365).alias("a"))
    d = d.withColumn("da", grid.backward_difference("a", "dd"))
    return d.select("dd", F.round(F.col("a") + F.sum(unwrap_step(F.col("da"))).over(grid.ordered("dd")), 6).alias("u"))


@query(f"""WITH {DAILY}, e AS (SELECT dd, mx, mx > lag(mx) OVER w AND mx >= lead(mx) OVER w AS top, mx < lag(mx) OVER w AND mx <= lead(mx) OVER w AS low FROM daily WINDOW w AS (ORDER BY dd)) SELECT dd, CASE WHEN top THEN 'top' ELSE 'low' END AS kind FROM e WHERE top OR low""")
def local_extremes(spark, sf):
    w = grid.ordered("dd")
    prev, nxt, v = F.lag("mx").over(w), F.lead("mx").over(w), F.col("mx")
    e = daily(spark, sf).select("dd", ((v > prev) & (v >= nxt)).alias("top"), ((v < prev) & (v <= nxt)).alias("low"))
    return e.where("top or low").select("dd", F.when(F.col("top"), "top").otherwise("low").alias("kind"))


@query(f"WITH {DAILY}, r AS (SELECT dd, mx, row_number() OVER (ORDER BY dd) AS i, count(*) OVER () AS n FROM daily) SELECT (i > n - n * 3 // 10)::BOOLEAN AS test, count(*) AS n, min(dd) AS lo, max(dd) AS hi FROM r GROUP BY 1")
def chronological_split(spark, sf):
    r = daily(spark, sf).select("dd", F.row_number().over(grid.ordered("dd")).alias("i"), F.count("*").over(W.partitionBy(F.lit(0))).alias("n"))
    return r.groupBy((F.col("i") > F.col("n") - F.floor(F.col("n") * 3 / 10)).alias("test")).agg(F.count("*").alias("n"), F.min("dd").alias("lo"), F.max("dd").alias("hi"))
