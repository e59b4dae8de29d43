"""Fingerprints, learners and streams. SQL expresses the streams' results, which batch and stream share."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from pulseframe.plans import attribution, audit, boosting, fingerprint
from pulseframe.plans.modulation import joined_bank
from pulseframe.session import cut, shared_folder
from pulseframe.sources import files
from pulseframe.sources.testbed import indicator, read
from pulseframe.streaming import counterparts as st

from .base import BANK, EDGES, IND, query, xorshift
from .scores import scored


def claims_of(spark, sf):
    return joined_bank(spark, sf).select(F.col("variable").alias("claim"), F.col("dd").alias("pos"), F.col("value").alias("x"), "y")


@query()
def fingerprint_vector(spark, sf):
    """All sixteen axes; fingerprint_axes has SQL for ten."""
    f = fingerprint.fingerprints(claims_of(spark, sf))
    return f.select("claim", *[F.round(a, 6).alias(a) for a in fingerprint.AXES])


TEN = ["stat", "p_shift", "log_p", "detect_ratio", "half_gap", "ac1", "trend_x", "trend_y", "spectral", "null_fpr"]
SEED, TURNS = fingerprint.SEED, "(30 + floor(x / 4294967296.0::DOUBLE * (n - 60)))::INTEGER"


@query(f"""WITH RECURSIVE {IND}, {BANK}, j AS MATERIALIZED (SELECT b.variable AS claim, b.value AS x, i.y::DOUBLE AS y, (row_number() OVER (PARTITION BY b.variable ORDER BY b.dd) - 1)::INTEGER AS t, (count(*) OVER (PARTITION BY b.variable))::INTEGER AS n FROM bank b JOIN ind i ON b.dd = i.dd),
  h AS (SELECT claim, 0 AS part, t, n, x, y FROM j UNION ALL SELECT claim, CASE WHEN t < n // 2 THEN 1 ELSE 2 END, t, n, x, y FROM j), e AS (SELECT claim, part, quantile_cont(x, {EDGES}) AS e, avg(y) AS base FROM h GROUP BY ALL),
  bn AS MATERIALIZED (SELECT h.claim, h.part, h.t, h.n, h.y, e.base, greatest(least(len(list_filter(e.e, lambda v: v <= h.x)) - 1, 9), 0) AS bin FROM h JOIN e ON h.claim = e.claim AND h.part = e.part),
  r AS (SELECT claim, part, base, bin, avg(y) AS rate FROM bn GROUP BY ALL), s AS (SELECT claim, part, max(abs(rate - base)) / any_value(base) AS stat FROM r GROUP BY ALL),
  hg AS (SELECT claim, abs(max(stat) FILTER (part = 1) - max(stat) FILTER (part = 2)) / (max(stat) FILTER (part = 1) + max(stat) FILTER (part = 2)) AS half_gap FROM s GROUP BY claim),
  sz AS (SELECT claim, bin, n, base, count(*) AS size FROM bn WHERE part = 0 GROUP BY ALL),
  hit AS (SELECT a.claim, (b.t - a.t + a.n) % a.n AS shift, b.bin, count(*) AS hits FROM bn a JOIN bn b ON a.claim = b.claim AND a.part = 0 AND b.part = 0 AND a.y = 1 GROUP BY ALL),
  tab AS MATERIALIZED (SELECT g.claim, g.shift, g.n, max(abs(coalesce(hits, 0) / size::DOUBLE - base)) / any_value(base) AS stat FROM (SELECT *, unnest(range(n))::INTEGER AS shift FROM sz) g LEFT JOIN hit ON hit.claim = g.claim AND hit.shift = g.shift AND hit.bin = g.bin GROUP BY ALL),
  own AS (SELECT claim, n, stat AS own FROM tab WHERE shift = 0), {xorshift("d0", f"SELECT 0 AS s, {SEED}::BIGINT AS x", fingerprint.TURNS - 1)}, {xorshift("d1", f"SELECT 0 AS s, {SEED + 1}::BIGINT AS x", 59)}, {xorshift("d2", f"SELECT k AS s, ({SEED + 7} + k)::BIGINT AS x FROM range(60) q(k)", 59)},
  nl AS (SELECT own.claim, own, tab.stat FROM own JOIN d0 ON i >= 0 JOIN tab ON tab.claim = own.claim AND tab.shift = {TURNS.replace("(n -", "(own.n -")}),
  p AS (SELECT claim, any_value(own) AS stat, (count(*) FILTER (stat >= own) + 1) / (count(*) + 1)::DOUBLE AS p_shift, any_value(own) / quantile_cont(stat, 0.95) AS detect_ratio FROM nl GROUP BY claim),
  tr AS (SELECT own.claim, own.n, i, {TURNS} AS k FROM own, d1 WHERE i >= 0), ag AS (SELECT tr.claim, tr.i, tr.k, (tr.k + {TURNS.replace("x /", "d2.x /")}) % n AS shift FROM tr JOIN d2 ON d2.s = tr.i AND d2.i >= 0),
  pp AS (SELECT ag.claim, ag.i, (count(*) FILTER (a.stat >= o.stat) + 1) / (count(*) + 1)::DOUBLE AS p FROM ag JOIN tab a ON a.claim = ag.claim AND a.shift = ag.shift JOIN tab o ON o.claim = ag.claim AND o.shift = ag.k GROUP BY ALL),
  fp AS (SELECT claim, avg((p < 0.05)::INT) AS null_fpr FROM pp GROUP BY claim),
  m AS (SELECT claim, avg(x) AS mu, regr_r2(x, t) AS trend_x FROM j GROUP BY claim), l AS (SELECT j.claim, x - mu AS d, lag(x - mu) OVER (PARTITION BY j.claim ORDER BY t) AS p FROM j JOIN m ON j.claim = m.claim),
  ac AS (SELECT claim, sum(d * p) / sum(d * d) AS ac1 FROM l GROUP BY claim), sm AS (SELECT claim, t, sum(y) OVER (PARTITION BY claim ORDER BY t ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) / 365 AS y FROM j), ty AS (SELECT claim, regr_r2(y, t) AS trend_y FROM sm GROUP BY claim),
  z AS (SELECT claim, t, x, pow(2, floor(log2(n)))::BIGINT AS n FROM j WHERE t < pow(2, floor(log2(n)))), f AS (SELECT claim, k, pow(sum(x * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * t) % n) / n)), 2) AS p FROM z, LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS k) GROUP BY claim, k),
  sp AS (SELECT claim, sum(p) FILTER (i <= 5) / sum(p) AS spectral FROM (SELECT claim, p, row_number() OVER (PARTITION BY claim ORDER BY p DESC) AS i FROM f) GROUP BY claim)
  SELECT claim, {", ".join(f"round({a}, 6) AS {a}" for a in TEN if a != "log_p")}, round(-log10(greatest(p_shift, 1e-4)), 6) AS log_p FROM p JOIN hg USING (claim) JOIN fp USING (claim) JOIN m USING (claim) JOIN ac USING (claim) JOIN ty USING (claim) JOIN sp USING (claim)""")
def fingerprint_axes(spark, sf):
    """The axes that SQL expresses, from the fingerprint itself."""
    f = fingerprint.fingerprints(claims_of(spark, sf))
    return f.select("claim", *[F.round(a, 6).alias(a) for a in TEN])


@query()
def claim_examples(spark, sf):
    """Claims of seven kinds made on the indicator's grid, with their axes."""
    made = cut(fingerprint.examples(indicator(spark, sf).select("dd", "y"), 2))
    kinds = made.select("claim", "kind", "index").distinct()
    return kinds.join(fingerprint.fingerprints(made), "claim").select("kind", "index", *[F.round(a, 6).alias(a) for a in fingerprint.AXES])


@query()
def claim_attribution(spark, sf):
    """The kind of each held-out claim: boosted trees for seven classes, prediction sets per class, and abstention far out."""
    made = cut(fingerprint.examples(indicator(spark, sf).select("dd", "y"), 12))
    rows = cut(made.select("claim", "kind", "index").distinct().join(fingerprint.fingerprints(made), "claim"))
    return attribution.attribute(rows, fingerprint.AXES, "kind", F.col("index") % 12 < 6, F.col("index") % 12 < 11, {"REAL": 0.01}).select("kind", "index", "said", "kinds", F.round("probability", 6).alias("probability"))


#: A first tree of two levels over documents: quantile codes, the best split of the root, and of both its children.
FEATURES = ["n_chars", "pieces", "mean_length"]
LEVEL = """c{k} AS (SELECT node, j, code, sum(g) AS g, sum(h) AS h, count(*) AS n FROM long{k} GROUP BY ALL),
  s{k} AS (SELECT *, sum(CASE WHEN code IS NOT NULL THEN g ELSE 0 END) OVER w AS gi, sum(CASE WHEN code IS NOT NULL THEN h ELSE 0 END) OVER w AS hi, sum(CASE WHEN code IS NOT NULL THEN n ELSE 0 END) OVER w AS ni,
    sum(g) OVER v AS ga, sum(h) OVER v AS ha, sum(n) OVER v AS na, coalesce(sum(g) FILTER (code IS NULL) OVER v, 0) AS gm, coalesce(sum(h) FILTER (code IS NULL) OVER v, 0) AS hm, coalesce(sum(n) FILTER (code IS NULL) OVER v, 0) AS nm
    FROM c{k} WINDOW w AS (PARTITION BY node, j ORDER BY code NULLS FIRST ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY node, j)),
  m{k} AS (SELECT node, j, code, m, gi + m * gm AS gl, hi + m * hm AS hl, ni + m * nm AS nl, ga, ha, na FROM s{k}, (VALUES (0), (1)) AS t(m) WHERE code IS NOT NULL),
  g{k} AS (SELECT *, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 6) AS gain FROM m{k} WHERE nl >= 20 AND na - nl >= 20),
  b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, code, m) AS i FROM g{k} WHERE gain > 0) WHERE i = 1)"""
TREE = """base AS (SELECT d.doc_id, n_chars::DOUBLE AS n_chars, CASE WHEN d.doc_id % 7 <> 0 THEN len(string_split(text, ' '))::DOUBLE END AS pieces, n_chars::DOUBLE / len(string_split(text, ' ')) AS mean_length, quality AS y FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
  p0 AS (SELECT avg(y) AS p FROM base), x AS (SELECT doc_id, y, j, [n_chars, pieces, mean_length][j + 1] AS v FROM base, (VALUES (0), (1), (2)) AS t(j)),
  e AS (SELECT j, list_sort(list_distinct(quantile_cont(v, [QS]))) AS e FROM x GROUP BY j),
  long0 AS (SELECT '' AS node, doc_id, j, CASE WHEN v IS NOT NULL THEN len(list_filter(e, lambda t: t < v)) END AS code, p - y AS g, p * (1 - p) AS h FROM x JOIN e USING (j), p0), """.replace("QS", ", ".join(str(k / 32) for k in range(1, 32))) + LEVEL.format(k=0) + """,
  long1 AS (SELECT CASE WHEN coalesce(o.code <= b0.code, b0.m = 1) THEN 'L' ELSE 'R' END AS node, l.doc_id, l.j, l.code, l.g, l.h FROM long0 l JOIN b0 ON true JOIN long0 o ON o.doc_id = l.doc_id AND o.j = b0.j), """ + LEVEL.format(k=1) + """,
  leaf AS (SELECT l.doc_id, l.node || CASE WHEN b1.node IS NULL THEN '' WHEN coalesce(o.code <= b1.code, b1.m = 1) THEN 'L' ELSE 'R' END AS path, l.g, l.h FROM (SELECT DISTINCT node, doc_id, g, h FROM long1) l LEFT JOIN b1 ON b1.node = l.node LEFT JOIN long1 o ON o.doc_id = l.doc_id AND o.j = b1.j),
  value AS (SELECT path, -0.1 * sum(g) / (sum(h) + 1) AS value FROM leaf GROUP BY path)"""


def quality_features(spark, sf):
    pieces = F.size(F.split("text", " "))
    docs = read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.when(F.col("doc_id") % 7 != 0, pieces.cast("double")).alias("pieces"), (F.col("n_chars") / pieces).alias("mean_length"))
    return docs.join(read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id")


FIRST = boosting.Settings(rounds=1, rate=0.1, levels=2)


@query(f"""WITH {TREE}, b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1) SELECT node AS path, ['n_chars', 'pieces', 'mean_length'][j + 1] AS feature, round(e[code + 1], 6) AS threshold, m AS missing_left FROM b JOIN e USING (j)""")
def boosted_first_tree(spark, sf):
    """The splits of a first tree over whole tables."""
    bundle, _ = boosting.fit(quality_features(spark, sf), FEATURES, "y", FIRST)
    return spark.createDataFrame([(path, f, None if t == float("inf") else round(t, 6), m) for _, _, path, f, t, m, _ in boosting.nodes(bundle) if f], "path string, feature string, threshold double, missing_left int")


@query(f"WITH {TREE} SELECT doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + value))), 9) AS p FROM leaf JOIN value USING (path), p0")
def exported_trees(spark, sf):
    """A fitted tree, exported and walked as an expression; the export is refused unless it agrees with the fitted scores to 1e-9."""
    docs = quality_features(spark, sf)
    bundle, fitted = boosting.fit(docs, FEATURES, "y", FIRST, key="doc_id")
    mine = docs.select("doc_id", boosting.scores(bundle, F.array(*FEATURES)).alias("mine"))
    apart = mine.join(fitted, mine["doc_id"] == fitted["key"]).where(F.abs(F.get("mine", F.lit(0)) - F.get("raw", F.lit(0))) > 1e-9)
    files.write_json_if(spark.createDataFrame([(json.dumps(bundle),)], "bundle string"), f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}", lambda _: apart.isEmpty())
    return mine.select("doc_id", F.round(F.get(boosting.softmax(F.col("mine")), F.lit(1)), 9).alias("p"))


@query()
def gbt_scores(spark, sf):
    """Boosted trees over all rows that aren't held out, scored as an expression over those that are."""
    s = quality_features(spark, sf)
    bundle, _ = boosting.fit(s.where("doc_id % 5 <> 0"), FEATURES, "y", boosting.Settings(rounds=10))
    p = F.get(boosting.softmax(boosting.scores(bundle, F.array(*FEATURES))), F.lit(1))
    return s.where("doc_id % 5 = 0").select("doc_id", F.col("y").cast("double").alias("y"), F.round(p, 6).alias("score"))


@query()
def logistic_gd(spark, sf):
    w = audit.logistic_gd(scored(spark, sf).withColumn("log_chars", F.log1p("n_chars")), ["n_chars", "log_chars"], "y")
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(w)], "i int, weight double")


@query()
def ridge_date(spark, sf):
    """The date from the bank: R2 on later days, with missing values filled and the penalty chosen by cross-validation."""
    w = joined_bank(spark, sf).groupBy("dd").pivot("variable", ["price", "discount", "quantity", "season"]).agg(F.first("value"))
    r2, penalty = audit.ridge_r2(w.withColumn("t", F.col("dd").cast("double")), ["price", "discount", "quantity", "season"], "t")
    return spark.createDataFrame([(round(float(r2), 6), float(penalty))], "r2 double, penalty double")


@query("WITH d AS (SELECT DISTINCT (epoch_us(ts) // 86400000000)::BIGINT AS day FROM events), c AS (SELECT (epoch_us(ts) // 86400000000)::BIGINT AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1) SELECT d.day, sum(c.n)::BIGINT AS n, round(sum(c.v * exp(-(d.day - c.day) / 10.0::DOUBLE)), 4) AS rate FROM d JOIN c ON c.day BETWEEN d.day - 499 AND d.day GROUP BY d.day")
def streaming_live_index(spark, sf):
    """A day's index over the 500 days before it, from a stream of events: each batch brings its days' sums up to date, and late ones too."""
    return st.live_index(st.source(spark, sf, "events"), 500, 10.0).select("day", "n", F.round("rate", 4).alias("rate"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def streaming_upsert(spark, sf):
    """The last event of each user from a stream that brings every event twice, kept by an upsert that nothing repeated changes."""
    e = st.source(spark, sf, "events").select("ts", "event_id", "user_id")
    return st.upserted(e.unionByName(st.source(spark, sf, "events").select("ts", "event_id", "user_id")), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT (epoch_us(ts) // 10800000000)::BIGINT AS slot, max(value) AS top, count(*) AS n FROM events GROUP BY 1")
def streaming_tumbling_max(spark, sf):
    out = st.replay(st.tumbling(st.source(spark, sf, "events"), "3 hours"), "complete")
    return out.select(F.floor(F.unix_micros("window.start") / F.lit(10_800_000_000)).alias("slot"), "top", "n")


@query("WITH s AS (SELECT unnest(range(epoch_us(ts) // 10800000000 - 15, epoch_us(ts) // 10800000000 + 1)) AS slot, value FROM events) SELECT slot::BIGINT AS slot, max(value) AS top FROM s GROUP BY slot")
def streaming_sliding_max(spark, sf):
    out = st.replay(st.sliding(st.source(spark, sf, "events"), "48 hours", "3 hours"), "complete")
    return out.select(F.floor(F.unix_micros("window.start") / F.lit(10_800_000_000)).alias("slot"), "top")


@query("""WITH e AS (SELECT user_id, ts, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR)::INT, 1) AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def streaming_sessions(spark, sf):
    out = st.replay(st.sessions(st.source(spark, sf, "events"), "6 hours"), "complete")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


@query("SELECT a.user_id, a.event_id AS cause, b.event_id AS effect FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR")
def streaming_interval_join(spark, sf):
    a, b = (st.source(spark, sf, "events").where(F.col("event_type") == k) for k in ("view", "purchase"))
    return st.replay(st.triggered(a, b, 12))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), k AS (
  SELECT user_id, event_id, t FROM e WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.t FROM k JOIN LATERAL (SELECT * FROM e WHERE e.user_id = k.user_id AND e.t > k.t + 86400000000 ORDER BY i LIMIT 1) n ON true)
  SELECT user_id, event_id FROM k""")
def streaming_equiv(spark, sf):
    """Greedy thinning with state, a day apart for each user."""
    return st.replay(st.thin_by_user(st.source(spark, sf, "events"), 24))
