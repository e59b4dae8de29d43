"""Fits, repeated splits, generated series, baselines of alarms and daily summaries of fields."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators import joins, nulls, stats
from pulseframe.plans import audit, triggering
from pulseframe.plans.modulation import binned_bank, joined_bank
from pulseframe.sources.testbed import catalog, field, large, read
from pulseframe.streaming import counterparts as st

from .base import BINNED, CAT, FIELD, big, hav, query
from .events import COLS, KERNEL, _kernel, hours
from .resampling import SPAN, _span

#: Level that stands for a field's climatology.
NORMAL = 38000


@query(f"WITH {FIELD} SELECT dd, count(*) AS n, round(avg(value - {NORMAL}) + 0.0000123, 4) AS mean, round(avg(abs(value - {NORMAL})) + 0.0000123, 4) AS mean_abs, round(stddev_pop(value) + 0.0000123, 4) AS sd FROM field GROUP BY dd")
def field_daily_summary(spark, sf):
    v = F.col("value") - NORMAL
    out = lambda c: F.round(c + 0.0000123, 4)
    return field(spark, sf).groupBy("dd").agg(F.count("*").alias("n"), out(F.avg(v)).alias("mean"), out(F.avg(F.abs(v))).alias("mean_abs"), out(F.stddev_pop("value")).alias("sd"))


@query(f"""WITH {BINNED}, s AS (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM binned GROUP BY variable), r AS (SELECT unnest(range(0, 6))::INTEGER AS replicate),
  m AS (SELECT variable, replicate, (pos + replicate * 101) % n AS pos FROM binned JOIN s USING (variable), r WHERE y = 1)
  SELECT variable, replicate, round(avg((value - mu) / sd), 6) AS contrast FROM m JOIN binned USING (variable, pos) JOIN s USING (variable) GROUP BY variable, replicate""")
def position_shift_contrast(spark, sf):
    """Event days meet the bank at shifted positions; the contrast is the mean of standardised values there."""
    b = binned_bank(spark, sf)
    s = b.groupBy("variable").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    moved = b.where("y = 1").select("variable", "pos").join(s, "variable").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(5))))
    moved = moved.withColumn("pos", F.pmod(F.col("pos") + F.col("replicate") * 101, F.col("n")))
    met = moved.join(b.select("variable", "pos", "value"), ["variable", "pos"])
    return met.groupBy("variable", "replicate").agg(F.round(F.avg((F.col("value") - F.col("mu")) / F.col("sd")), 6).alias("contrast"))


@query(f"""WITH {CAT}, c AS (SELECT kind, count(*) AS n, count(*) FILTER (mag >= (SELECT quantile_cont(mag, 0.5) FROM cat)) AS k FROM cat GROUP BY kind), t AS (SELECT kind, n, k, unnest(range(k, n + 1)) AS i FROM c)
  SELECT kind, n, k, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE))), 6) AS p FROM t GROUP BY kind, n, k""")
def binomial_by_kind(spark, sf):
    """Chance of as many events above the median as each kind has; one row for each kind reaches the tail."""
    c = catalog(spark, sf)
    cut = F.broadcast(c.agg(F.percentile("mag", F.lit(0.5)).alias("cut")))  # one row
    g = c.crossJoin(cut).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("mag") >= F.col("cut")).alias("k")).select("kind", "n", "k")
    return stats.with_binomial_tail(g, F.col("k"), F.col("n"), F.lit(0.5), "p").withColumn("p", F.round("p", 6))


GRID_MU, GRID_K = (0.0005, 0.001, 0.002), (0.005, 0.01, 0.02, 0.05)


def _rates(spark, sf):
    """(k): each large event's sum of kernels, 0 without ancestors."""
    b, k = _kernel(spark, sf)
    return b.select("id").join(k, "id", "left").select(F.coalesce("k", F.lit(0.0)).alias("k"))


@query(KERNEL + f""", g AS (SELECT unnest({list(GRID_MU)})::DOUBLE AS mu), a AS (SELECT unnest({list(GRID_K)})::DOUBLE AS a),
  l AS (SELECT mu, a, sum(ln(mu + a * coalesce(k, 0))) - mu * (SELECT max(hour) - min(hour) + 1 FROM cat) * count(*) - a * sum(coalesce(k, 0)) AS ll FROM big LEFT JOIN pr USING (id), g, a GROUP BY mu, a)
  SELECT mu, a, round(ll, 6) AS ll, rank() OVER (ORDER BY round(ll, 6) DESC)::INTEGER AS place FROM l""")
def etas_grid_ll(spark, sf):
    """Log-likelihoods of background and productivity on a grid of parameters, in one aggregation."""
    r = _rates(spark, sf)
    cells, span = [(m, a) for m in GRID_MU for a in GRID_K], hours(spark, sf)
    ll = r.agg(*[audit.rate_ll(F.lit(m), F.lit(a), span).alias(f"c{i}") for i, (m, a) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(m).alias("mu"), F.lit(a).alias("a"), F.round(f"c{i}", 6).alias("ll")) for i, (m, a) in enumerate(cells)])
    return ll.select(F.inline(rows)).withColumn("place", F.rank().over(W.orderBy(F.desc("ll"))))  # a row for each cell of the grid


@query()
def etas_mle(spark, sf):
    """Background and productivity of greatest likelihood, by a simplex over their logarithms; then all five parameters in time, and all eight in time and space, by expectation-maximisation over all pairs."""
    mu, a, ll = audit.fit_rates(_rates(spark, sf), hours(spark, sf), rounds=25)
    b = large(spark, sf, 0.97)
    pairs = joins.near_pairs(b, joins.second(b, COLS), 1000, (1, 120)).select(F.col("id2").alias("id"), (F.col("hour2") - F.col("hour")).alias("dt"), (F.col("mag") - 6.0).alias("dm"), "km")
    targets = b.select("id", F.lit(1.0).alias("background"))
    ancestors = b.select(F.col("hour").alias("t"), (F.col("mag") - 6.0).alias("dm"))
    ends = catalog(spark, sf).agg(F.min("hour").alias("t0"), (F.max("hour") + 1).alias("t1")).first()
    rows = [("two", "mu", mu), ("two", "a", a), ("two", "ll", ll)]
    start = triggering.Parameters(0.1, 0.01, 1.0, 0.5, 1.25, 100.0, 0.5, 1.6)
    for name, spatial, names in (("five", False, ["mu", "k", "alpha", "c", "p"]), ("eight", True, ["mu", "k", "alpha", "c", "p", "d", "gamma", "q"])):
        found, lls = triggering.fit(targets, pairs, ancestors, float(ends["t0"] or 0), float(ends["t1"] or 1), 120.0, start, spatial, rounds=12)
        rows += [(name, n, getattr(found, n)) for n in names] + [(name, "ll", lls[-1] if lls else 0.0), (name, "gained", lls[-1] - lls[0] if lls else 0.0)]
    return spark.createDataFrame([(m, k, round(float(v), 4)) for m, k, v in rows], "model string, parameter string, value double")


SPLIT = "((vec_id * 7919 + s * 104729) % 100003) % 10 < 3"


@query(f"""WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT unnest(range(1, 61))::INTEGER AS s),
  m AS (SELECT s, label, i, avg(x) AS mu FROM v, s WHERE NOT ({SPLIT}) GROUP BY ALL),
  d AS (SELECT v.vec_id, v.label, m.s, m.label AS said, round(sum(pow(x - mu, 2)), 9) AS d FROM v JOIN m ON v.i = m.i WHERE {SPLIT.replace('s *', 'm.s *')} GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY s, vec_id ORDER BY d, said) AS place FROM d)
  SELECT s AS split, count(*) AS n, round(avg((said = label)::INT), 9) AS accuracy FROM b WHERE place = 1 GROUP BY s""")
def repeated_splits(spark, sf):
    """Held-out accuracy of the nearest centroid over repeated splits."""
    return audit.centroid_splits(read(spark, sf, "embeddings"), "vec_id", "embedding", "label", 60)


@query("""WITH RECURSIVE a AS (SELECT s_suppkey::BIGINT AS series, 0::INTEGER AS t, 0::DOUBLE AS x FROM supplier
  UNION ALL SELECT series, t + 1, exp(-0.1::DOUBLE) * x + (((t + 1) * 7919 + series * 104729) % 10007) / 10007.0::DOUBLE - 0.5::DOUBLE FROM a WHERE t < 200)
  SELECT series, t, round(x, 6) AS x FROM a WHERE t > 0""")
def ar1_series(spark, sf):
    """An autoregressive series for each supplier from a portable generator, whose memory falls to 1/e in ten steps; each is a fold, and series are independent rows."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("series"))
    noise = lambda t: nulls.lcg((t, 7919), (F.col("series"), 104729)) / F.lit(10007.0) - F.lit(0.5)
    step = lambda acc, t: F.concat(acc, F.array(math.exp(-0.1) * F.element_at(acc, -1) + noise(t)))
    xs = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.array(F.lit(0.0)), step)
    return s.select("series", F.posexplode(xs).alias("t", "x")).where("t > 0").select("series", "t", F.round("x", 6).alias("x"))


@query(f"""WITH {CAT}, {big(0.9)}, {big(0.99, 'huge')}, {SPAN}, r AS (SELECT unnest(range(0, 6))::INTEGER AS replicate),
  h AS (SELECT replicate, id, lat, lon, CASE WHEN replicate = 0 THEN hour ELSE t0 + (hour - t0 + 30 + (replicate * 7919) % (span - 60)) % span END AS hour FROM huge, s, r)
  SELECT replicate, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM big b WHERE h.hour - b.hour BETWEEN 1 AND 48 AND {hav('h', 'b')} <= 800))::INT), 9) AS rate FROM h GROUP BY replicate""")
def alarm_baseline(spark, sf):
    """Share of targets inside alarms, as they are (replicate 0) and with their times shifted."""
    h = large(spark, sf, 0.99).crossJoin(_span(catalog(spark, sf))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(5))))
    moved = nulls.free_shift(F.col("hour"), F.col("t0"), F.col("span"), F.col("replicate") * 7919, 30).cast("int")
    h = h.withColumn("hour", F.when(F.col("replicate") == 0, F.col("hour")).otherwise(moved)).select("replicate", *COLS)
    met = joins.near_pairs(h, joins.second(large(spark, sf, 0.9), COLS), 800, (-48, -1)).select("replicate", "id").distinct().withColumn("hit", F.lit(1))
    all_ = h.select("replicate", "id").join(met, ["replicate", "id"], "left")
    return all_.groupBy("replicate").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("rate"))


@query("SELECT event_id FROM events")
def streaming_dedup(spark, sf):
    """Each event once, from a stream that carries every event twice."""
    e = st.source(spark, sf, "events").select("ts", "event_id")
    return st.replay(st.deduplicated(e.unionByName(st.source(spark, sf, "events").select("ts", "event_id")), "event_id")).select("event_id")


@query()
def forest_classes(spark, sf):
    """Classes that a forest gives to held-out vectors."""
    v = read(spark, sf, "embeddings").where("label is not null and embedding is not null")
    return audit.forest_classes(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "embedding", "label").select("vec_id", "label", "said")


@query()
def lagged_network(spark, sf):
    """Scores of a feed-forward network over the last thirty days of the bank; the last 30 % of days are held out."""
    names = ["price", "discount", "quantity", "season"]
    wide = joined_bank(spark, sf).groupBy("dd").pivot("variable", names).agg(F.first("value")).join(joined_bank(spark, sf).select("dd", "y").distinct(), "dd")
    w = W.orderBy("dd")  # a calendar bounds the rows
    lagged = wide.select("dd", "y", *[F.lag(c, k).over(w).alias(f"{c}_{k}") for c in names for k in range(1, 31)], F.percent_rank().over(w).alias("share")).na.drop()
    return audit.network_scores(lagged.where("share < 0.7"), lagged.where("share >= 0.7"), [f"{c}_{k}" for c in names for k in range(1, 31)], "y").select("dd", "y", F.round("score", 6).alias("score"))


