"""Scores, vectors, sets and nested data."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators import joins, stats
from pulseframe.sources.testbed import catalog, large, read

from .base import CAT, big, query

SC = "sc AS (SELECT d.doc_id, n_chars, quality AS y, 1 / (1 + exp(-(ln(1 + n_chars) - 7))) AS p FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"


def scored(spark, sf):
    l = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("y"))
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(l, "doc_id")
    return d.withColumn("p", 1 / (1 + F.exp(-(F.log(1 + F.col("n_chars")) - 7))))


@query(f"WITH {SC}, r AS (SELECT y, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM sc) SELECT round((sum(r * y)::DOUBLE - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 9) AS auc FROM r")
def rank_auc(spark, sf):
    return stats.rank_auc(scored(spark, sf), "n_chars", "y", "doc_id").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SC}, r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM sc) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 9) AS auc FROM r")
def auc_tie_averaged(spark, sf):
    return stats.rank_auc(scored(spark, sf), "n_chars", "y", "doc_id", averaged=True).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SC} SELECT round(avg(pow(p - y, 2)), 9) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 9) AS log_loss FROM sc")
def brier(spark, sf):
    y, p = F.col("y"), F.col("p")
    return scored(spark, sf).agg(F.round(F.avg(F.pow(p - y, F.lit(2))), 9).alias("brier"), F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 9).alias("log_loss"))


@query(f"WITH {SC}, b AS (SELECT avg(y) AS base FROM sc) SELECT round(avg(CASE WHEN y = 1 THEN ln(p) - ln(base) ELSE ln(1 - p) - ln(1 - base) END), 9) AS gain FROM sc, b")
def info_gain(spark, sf):
    s = scored(spark, sf)
    b = s.crossJoin(F.broadcast(s.agg(F.avg("y").alias("base"))))  # one row
    return b.agg(F.round(stats.log_gain(F.col("y"), F.col("p"), F.col("base")), 9).alias("gain"))


@query(f"WITH {SC}, c AS (SELECT sum((p >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::INT)::BIGINT AS fp, sum((p < 0.5 AND y = 1)::INT)::BIGINT AS fn, sum((p < 0.5 AND y = 0)::INT)::BIGINT AS tn FROM sc) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM c")
def prf_confusion(spark, sf):
    hit, pos = F.col("p") >= 0.5, F.col("y") == 1
    c = scored(spark, sf).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", F.round(tp / (tp + fp), 9).alias("precision"), F.round(tp / (tp + fn), 9).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 9).alias("f1"))


@query(f"WITH {SC}, e AS (SELECT quantile_cont(p, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM sc), b AS (SELECT unnest(range(1, 6)) AS i) SELECT i::INTEGER AS bin, count(*) AS n, round(avg(p), 9) AS said, round(avg(y), 9) AS seen FROM sc, e, b WHERE p >= e[i] AND p <= e[i + 1] GROUP BY i")
def calibration_bins(spark, sf):
    """Bins closed at both ends; a row on an edge counts in both."""
    s = scored(spark, sf)
    e = s.agg(F.percentile("p", F.array(*[F.lit(i / 5) for i in range(6)])).alias("e"))
    x = s.crossJoin(F.broadcast(e)).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(5))))  # one row
    inside = x.where(F.col("p").between(F.get("e", F.col("bin") - 1), F.get("e", F.col("bin"))))
    return inside.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("said"), F.round(F.avg("y"), 9).alias("seen"))


EMB = "v AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def components(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).withColumn("i", F.col("i") + 1)


@query(f"WITH {EMB} SELECT label, i::INTEGER AS i, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS sd FROM v GROUP BY ALL")
def class_centroids(spark, sf):
    return components(spark, sf).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("sd"))


MAHA = EMB + ", m AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS s2 FROM v GROUP BY ALL), q AS (SELECT vec_id, v.label, sqrt(sum(pow(x - mu, 2) / (s2 + 0.001))) AS d FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY ALL)"


def mahalanobis(spark, sf):
    v = components(spark, sf)
    m = v.groupBy("label", "i").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("s2"))
    z = F.pow(F.col("x") - F.col("mu"), F.lit(2)) / (F.col("s2") + 0.001)
    return v.join(m, ["label", "i"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum(z)).alias("d"))


@query(f"WITH {MAHA} SELECT vec_id, round(d, 6) AS d FROM q")
def mahalanobis_diag(spark, sf):
    return mahalanobis(spark, sf).select("vec_id", F.round("d", 6).alias("d"))


@query(f"""WITH {MAHA}, k AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS i, count(*) OVER (PARTITION BY label) AS n FROM q), c AS (SELECT label, d AS q FROM k WHERE i = least(greatest(ceil((n + 1) * 0.9::DOUBLE), 1), n))
  SELECT label, round(q, 6) AS q, (SELECT count(*) FROM q q2 WHERE q2.label = c.label AND q2.d <= c.q) AS covered FROM c""")
def conformal_sets(spark, sf):
    d = mahalanobis(spark, sf)
    q = stats.conformal_quantile("d", ["label"], 0.1, d)
    return d.join(q, "label").groupBy("label", "q").agg(F.count_if(F.col("d") <= F.col("q")).alias("covered")).select("label", F.round("q", 6).alias("q"), "covered")


@query(f"WITH {CAT}, pl AS (SELECT DISTINCT lat, lon FROM cat), p AS (SELECT a.lat, a.lon, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d, row_number() OVER (PARTITION BY a.lat, a.lon ORDER BY sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS i FROM pl a JOIN pl b ON a.lat <> b.lat OR a.lon <> b.lon) SELECT pl.lat, pl.lon, round(d, 6) AS width FROM pl LEFT JOIN p ON p.lat = pl.lat AND p.lon = pl.lon AND i = 8")
def knn_bandwidth(spark, sf):
    """Distance to the eighth neighbour; null where there are fewer."""
    pl = catalog(spark, sf).select(F.col("lat").alias("x"), F.col("lon").alias("y")).distinct()
    return joins.kth_neighbour(pl, 8, 20.0).select(F.col("x").alias("lat"), F.col("y").alias("lon"), F.round("width", 6).alias("width"))


@query(f"""WITH {CAT}, {big(0.97)}, pl AS (SELECT lat, lon, count(*) AS n FROM cat GROUP BY ALL), p AS (SELECT a.lat, a.lon, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d, row_number() OVER (PARTITION BY a.lat, a.lon ORDER BY sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS i FROM pl a JOIN pl b ON a.lat <> b.lat OR a.lon <> b.lon),
  w AS (SELECT lat, lon, greatest(d, 2.0) AS w FROM p WHERE i = 8), k AS (SELECT big.id, sqrt(pow(big.lat - w.lat, 2) + pow(big.lon - w.lon, 2)) AS d, w FROM big, w)
  SELECT big.id, round(coalesce(sum(exp(-d * d / (2 * w * w)) / (2 * pi() * w * w)) FILTER (d <= 6 * w), 0) / (SELECT count(*) FROM w), 12) AS density FROM big LEFT JOIN k USING (id) GROUP BY big.id""")
def adaptive_density(spark, sf):
    """Background density at all large events, from places whose kernels are as wide as the way to their eighth neighbour."""
    pl = catalog(spark, sf).select(F.col("lat").alias("x"), F.col("lon").alias("y")).distinct()
    s = joins.kth_neighbour(pl, 8, 20.0).where("width is not null").withColumn("width", F.greatest("width", F.lit(2.0)))
    t = large(spark, sf, 0.97).select("id", F.col("lat").alias("x"), F.col("lon").alias("y"))
    return joins.kernel_density(s, t).select("id", F.round("density", 12).alias("density"))


@query("SELECT 'event' AS kind, event_id AS id, value, NULL::VARCHAR AS note FROM events UNION ALL SELECT 'order', o_orderkey, NULL, o_orderpriority FROM orders")
def union_by_name(spark, sf):
    a = read(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "value")
    b = read(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {CAT} SELECT DISTINCT lat, lon FROM cat")
def distinct_cells(spark, sf):
    return catalog(spark, sf).select("lat", "lon").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_membership(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_membership(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("(SELECT user_id AS id, 'both' AS side FROM events INTERSECT SELECT c_custkey, 'both' FROM customer) UNION ALL (SELECT c_custkey, 'customer' FROM customer EXCEPT SELECT user_id, 'customer' FROM events)")
def except_intersect(spark, sf):
    e, c = read(spark, sf, "events").select(F.col("user_id").alias("id")), read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return e.intersect(c).withColumn("side", F.lit("both")).union(c.subtract(e).withColumn("side", F.lit("customer")))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def topk_per_group(spark, sf):
    i = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return read(spark, sf, "events").withColumn("i", i).where("i <= 3").select("user_id", "event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top_ten(spark, sf):
    return read(spark, sf, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("SELECT event_type, arg_max(event_id, value * 1000000 - event_id / 1000000.0::DOUBLE) AS best, arg_min(event_id, value * 1000000 + event_id / 1000000.0::DOUBLE) AS least FROM events GROUP BY event_type")
def argmax_per_group(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("least"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, CASE WHEN (props->>'$.k')::INTEGER >= 50 THEN 'high' ELSE 'low' END AS level FROM events")
def json_props(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf, "events").select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("level"))


@query("SELECT event_id, CASE WHEN value >= 200 THEN 'alert' WHEN value >= 100 THEN 'raised' WHEN value >= 40 THEN 'watch' ELSE 'calm' END AS status FROM events")
def status_buckets(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", F.when(v >= 200, "alert").when(v >= 100, "raised").when(v >= 40, "watch").otherwise("calm").alias("status"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def regex_offsets(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("long").alias("links"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS path, sum((role = 'user')::INT)::BIGINT AS asks FROM conversations GROUP BY conv_id")
def turn_sequences(spark, sf):
    c = read(spark, sf, "conversations")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), path.alias("path"), F.count_if(F.col("role") == "user").alias("asks"))


@query("SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def dimension_counts(spark, sf):
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"))
    s = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))
    out = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").join(s, n["n_nationkey"] == s["s_nationkey"], "left")
    return out.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p_brand, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def median_range(spark, sf):
    j = read(spark, sf, "lineitem").select("l_partkey", "l_extendedprice").join(read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("med"), F.round(F.max("l_extendedprice") - F.min("l_extendedprice"), 4).alias("range"))


@query(f"WITH {CAT}, p AS (SELECT id, ((hour * 7919) % 1000 + 0.5::DOUBLE) / 1000 AS u FROM cat), r AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM p) SELECT round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 9) AS ks FROM r")
def ks_uniform(spark, sf):
    u = catalog(spark, sf).select((((F.col("hour") * 7919) % 1000 + 0.5) / 1000).alias("u"))
    return stats.ks_uniform(u, "u").select(F.round("ks", 9).alias("ks"))


@query(f"WITH {CAT}, z AS (SELECT kind, (avg(mag) - (SELECT avg(mag) FROM cat)) / ((SELECT stddev_pop(mag) FROM cat) / sqrt(count(*))) AS z FROM cat GROUP BY kind), t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z) SELECT kind, round(z, 6) AS z, round(0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429::DOUBLE)))) * exp(-x * x))), 6) AS p FROM t")
def normal_tail_by_kind(spark, sf):
    c = catalog(spark, sf)
    all_ = c.agg(F.avg("mag").alias("m"), F.stddev_pop("mag").alias("s"))
    g = c.groupBy("kind").agg(F.avg("mag").alias("gm"), F.count("*").alias("n")).crossJoin(F.broadcast(all_))  # one row
    z = (F.col("gm") - F.col("m")) / (F.col("s") / F.sqrt("n"))
    return g.select("kind", F.round(z, 6).alias("z"), F.round(stats.normal_cdf(z), 6).alias("p"))


@query("SELECT doc_id, round(1 / (1 + exp(-(" + " + ".join(f"CASE WHEN n_chars <= {t} THEN {a} ELSE {b} END" for t, a, b in [(500, -0.4, 0.3), (2000, -0.1, 0.2), (8000, 0.05, -0.3)]) + "))), 9) AS p FROM documents")
def tree_walk(spark, sf):
    """An exported ensemble, flat arrays of stumps, walked by a fold."""
    from pulseframe.plans.boosting import scores

    trees = [{"feature": [0, -1, -1], "threshold": [float(t), 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "missing_left": [0, 0, 0], "value": [0.0, a, b]} for t, a, b in [(500, -0.4, 0.3), (2000, -0.1, 0.2), (8000, 0.05, -0.3)]]
    raw = F.get(scores({"baseline": [0.0], "trees": [[t] for t in trees]}, F.array(F.col("n_chars").cast("double"))), F.lit(0))
    return read(spark, sf, "documents").select("doc_id", F.round(1 / (1 + F.exp(-raw)), 9).alias("p"))


PFR = "r AS (SELECT event_id, lpad(event_id::VARCHAR, 8, '0') || strftime(ts, '%Y%m%d%H') || lpad(round(value * 100)::BIGINT::VARCHAR, 7, '0') AS line FROM events)"


@query(f"WITH {PFR} SELECT line[1:8]::BIGINT AS id, line[9:16]::INTEGER AS day, line[17:18]::INTEGER AS hour, round(line[19:25]::DOUBLE / 100, 2) AS value FROM r")
def parse_fixed_records(spark, sf):
    from pulseframe.sources.text import fixed

    e = read(spark, sf, "events")
    line = F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.date_format("ts", "yyyyMMddHH"), F.lpad(F.round(F.col("value") * 100).cast("long").cast("string"), 7, "0"))
    out = fixed(e.select(line.alias("line")), "line", {"id": (1, 8, "long"), "day": (9, 8, "int"), "hour": (17, 2, "int"), "value": (19, 7, "double")})
    return out.withColumn("value", F.round(F.col("value") / 100, 2))


@query("SELECT event_id AS id, event_type AS kind, value FROM events WHERE value >= 0")
def parse_whitespace(spark, sf):
    from pulseframe.sources.text import whitespace

    e = read(spark, sf, "events")
    lines = e.select(F.concat_ws("   ", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string")).alias("line"))
    return whitespace(lines, "line", {"id": (0, "long"), "kind": (1, "string"), "value": (2, "double")}).where("value >= 0")
