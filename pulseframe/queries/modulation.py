"""Bins, the modulation statistic, its nulls and corrections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.rng import below, stream, step
from pulseframe.operators import binning, nulls, stats
from pulseframe.plans.modulation import SHIFT_SEED, binned_bank, joined_bank, positions, shift_table
from pulseframe.session import cut
from pulseframe.sources.testbed import bank, indicator, read

from .base import BANK, BINNED, EDGES, IND, query, xorshift

XOR = """x0 AS (SELECT 0 AS i, {seed}::BIGINT AS x UNION ALL SELECT i + 1, xor(z, (z << 5) & 4294967295) FROM (SELECT i, xor(y, y >> 17) AS z FROM (SELECT i, xor(x, (x << 13) & 4294967295) AS y FROM x0 WHERE i < {n})))"""


def xor(seed: int, n: int) -> str:
    return XOR.format(seed=seed, n=n)


SHIFTS = xor(SHIFT_SEED, 400) + ", nn AS (SELECT (max(pos) + 1)::BIGINT AS n FROM binned), shifts AS (SELECT i::INTEGER AS replicate, (1 + floor(x / 4294967296.0::DOUBLE * (n - 1)))::BIGINT AS shift FROM x0, nn WHERE i > 0)"
STAT = "{name} AS (SELECT {keys}, max(CASE WHEN n >= floor(t * 0.015) THEN abs(hits / n::DOUBLE - base) END) AS stat FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS t, sum(hits) OVER (PARTITION BY {keys}) / sum(n) OVER (PARTITION BY {keys})::DOUBLE AS base FROM {src}) GROUP BY {keys})"
OBS = STAT.format(name="obs", keys="family, variable", src="counted")
NULLS = f"""WITH RECURSIVE {BINNED}, {SHIFTS}, ev AS (SELECT DISTINCT pos FROM binned WHERE y = 1),
moved AS (SELECT replicate, (pos + shift) % n AS pos FROM ev, shifts, nn),
sizes AS (SELECT family, variable, bin, count(*) AS n FROM binned GROUP BY ALL),
got AS (SELECT family, variable, replicate, bin, count(*) AS hits FROM moved JOIN binned USING (pos) GROUP BY ALL),
cells AS (SELECT s.family, s.variable, replicate, s.bin, s.n, coalesce(hits, 0) AS hits FROM sizes s CROSS JOIN shifts LEFT JOIN got USING (family, variable, replicate, bin)),
{OBS}, {STAT.format(name="nul", keys="family, variable, replicate", src="cells")}"""


@query(f"WITH {BANK} SELECT variable, array_to_string(list_transform(quantile_cont(value, {EDGES}), lambda x: printf('%.6f', x)), ' ') AS edges FROM bank GROUP BY variable")
def percentile_edges(spark, sf):
    e = binning.edges(bank(spark, sf), "value", ["variable"])
    return e.select("variable", F.array_join(F.transform("edges", lambda x: F.format_string("%.6f", x)), " ").alias("edges"))


@query(f"WITH {BINNED} SELECT variable, dd, bin FROM binned")
def decile_bins_unique(spark, sf):
    return binned_bank(spark, sf).select("variable", "dd", "bin")


@query(f"""WITH {IND}, {BANK}, j AS (SELECT b.* FROM bank b JOIN ind i ON b.dd = i.dd), e AS (SELECT variable, quantile_cont(value, {EDGES}) AS e FROM j GROUP BY variable)
  SELECT variable, dd, least(greatest(len(list_filter(e, lambda x: x <= value)) - 1, 0), 9)::INTEGER AS bin FROM j JOIN e USING (variable)""")
def decile_bins_fixed(spark, sf):
    return binning.assign(joined_bank(spark, sf), "value", ["variable"], unique=False).select("variable", "dd", "bin")


@query(f"WITH {BINNED} SELECT family, variable, bin, n, hits, round(hits / n::DOUBLE, 6) AS rate FROM counted")
def decile_rates(spark, sf):
    c = binning.rates(binned_bank(spark, sf), "y", ["family", "variable"])
    return c.withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


@query(f"WITH {BINNED}, {OBS} SELECT family, variable, round(stat, 9) AS stat FROM obs")
def max_deviation_stat(spark, sf):
    c = binning.rates(binned_bank(spark, sf), "y", ["family", "variable"])
    return binning.max_deviation(c, ["family", "variable"]).select("family", "variable", F.round("stat", 9).alias("stat"))


@query(f"WITH {BINNED} SELECT variable, round(max(abs(hits / n::DOUBLE - base) / base), 9) AS stat FROM (SELECT *, sum(hits) OVER (PARTITION BY variable) / sum(n) OVER (PARTITION BY variable)::DOUBLE AS base FROM counted) GROUP BY variable")
def relative_max_deviation(spark, sf):
    c = binning.rates(binned_bank(spark, sf), "y", ["variable"])
    return binning.max_deviation(c, ["variable"], least=0.0, relative=True).select("variable", F.round("stat", 9).alias("stat"))


@query(f"WITH {BINNED}, s AS (SELECT *, sum(hits) OVER (PARTITION BY variable) / sum(n) OVER (PARTITION BY variable)::DOUBLE AS m FROM counted WHERE n >= 5) SELECT variable, round(sqrt(sum(n * pow(hits / n::DOUBLE - m, 2)) / sum(n)), 9) AS stat FROM s GROUP BY variable")
def spread_stat(spark, sf):
    return binning.spread(binning.rates(binned_bank(spark, sf), "y", ["variable"]), ["variable"]).select("variable", F.round("stat", 9).alias("stat"))


def null_stats(spark, sf):
    b = cut(binned_bank(spark, sf))
    ev = b.where("y = 1").select("pos").distinct()
    n = positions(b)
    obs = binning.max_deviation(binning.rates(b, "y", ["family", "variable"]), ["family", "variable"])
    return obs, nulls.shifted_statistic(b, ev, shift_table(spark, n), n, ["family", "variable"])


@query(NULLS + " SELECT family, variable, replicate, round(stat, 9) AS stat FROM nul")
def circular_shift_null(spark, sf):
    return null_stats(spark, sf)[1].select("family", "variable", "replicate", F.round("stat", 9).alias("stat"))


def _null_vs(spark, sf):
    obs, nul = null_stats(spark, sf)
    r = lambda d: d.withColumn("stat", F.round("stat", 9))
    return r(obs).withColumnRenamed("stat", "o"), r(nul)


VS = NULLS + ", o AS (SELECT family, variable, round(stat, 9) AS o FROM obs), z AS (SELECT family, variable, replicate, round(stat, 9) AS stat FROM nul)"


@query(VS + " SELECT variable, round((sum((stat >= o)::INT) + 1) / (count(*) + 1)::DOUBLE, 9) AS p_add_one, round(avg((stat >= o)::INT), 9) AS p_plain FROM z JOIN o USING (family, variable) GROUP BY variable")
def shift_pvalue_addone(spark, sf):
    o, z = _null_vs(spark, sf)
    return z.join(o, ["family", "variable"]).groupBy("variable").agg(F.round(stats.p_add_one("stat", "o"), 9).alias("p_add_one"), F.round(stats.p_plain("stat", "o"), 9).alias("p_plain"))


@query(VS + ", m AS (SELECT replicate, max(stat) AS m FROM z GROUP BY replicate) SELECT round(quantile_cont(m, 0.95), 9) AS threshold FROM m")
def shift_threshold95(spark, sf):
    m = _null_vs(spark, sf)[1].groupBy("replicate").agg(F.max("stat").alias("m"))
    return m.agg(F.round(F.percentile("m", F.lit(0.95)), 9).alias("threshold"))


@query(VS + ", m AS (SELECT family, replicate, max(stat) AS m FROM z GROUP BY ALL), om AS (SELECT family, max(o) AS o FROM o GROUP BY family) SELECT family, round(max(o), 9) AS stat, round(avg((m >= o)::INT), 9) AS p FROM m JOIN om USING (family) GROUP BY family")
def max_stat_by_family(spark, sf):
    o, z = _null_vs(spark, sf)
    m, om = z.groupBy("family", "replicate").agg(F.max("stat").alias("m")), o.groupBy("family").agg(F.max("o").alias("o"))
    return m.join(om, "family").groupBy("family").agg(F.round(F.max("o"), 9).alias("stat"), F.round(stats.p_plain("m", "o"), 9).alias("p"))


@query(VS + ", m AS (SELECT replicate, max(stat) AS m FROM z GROUP BY ALL) SELECT round((SELECT max(o) FROM o), 9) AS stat, round(avg((m >= (SELECT max(o) FROM o))::INT), 9) AS p FROM m")
def joint_max_stat(spark, sf):
    o, z = _null_vs(spark, sf)
    m = z.groupBy("replicate").agg(F.max("stat").alias("m")).crossJoin(F.broadcast(o.agg(F.max("o").alias("o"))))  # one row
    return m.agg(F.round(F.max("o"), 9).alias("stat"), F.round(stats.p_plain("m", "o"), 9).alias("p"))


@query(VS + """, s AS (SELECT variable, avg(stat) AS mu, stddev_pop(stat) AS sd FROM z GROUP BY variable), zz AS (SELECT replicate, max(abs(stat - mu) / sd) AS m FROM z JOIN s USING (variable) GROUP BY replicate),
  oz AS (SELECT max(abs(o - mu) / sd) AS m FROM o JOIN s USING (variable)) SELECT round((SELECT m FROM oz), 6) AS z, round(avg((zz.m >= (SELECT m FROM oz))::INT), 6) AS p FROM zz""")
def studentised_max(spark, sf):
    o, z = _null_vs(spark, sf)
    s = z.groupBy("variable").agg(F.avg("stat").alias("mu"), F.stddev_pop("stat").alias("sd"))
    m = z.join(s, "variable").groupBy("replicate").agg(F.max(F.abs(F.col("stat") - F.col("mu")) / F.col("sd")).alias("m"))
    oz = o.join(s, "variable").agg(F.max(F.abs(F.col("o") - F.col("mu")) / F.col("sd")).alias("o"))
    return m.crossJoin(F.broadcast(oz)).agg(F.round(F.max("o"), 6).alias("z"), F.round(stats.p_plain("m", "o"), 6).alias("p"))  # one row


@query(VS + """, f AS (SELECT family, replicate, max(stat) AS m FROM z GROUP BY ALL), fo AS (SELECT family, max(o) AS o FROM o GROUP BY family),
  rp AS (SELECT replicate, family, (count(*) OVER (PARTITION BY family ORDER BY m DESC RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER (PARTITION BY family) - 1)::DOUBLE AS p FROM f),
  op AS (SELECT family, avg((m >= o)::INT) AS p FROM f JOIN fo USING (family) GROUP BY family), mp AS (SELECT replicate, min(p) AS p FROM rp GROUP BY replicate)
  SELECT round((SELECT min(p) FROM op), 9) AS min_p, round(avg((mp.p <= (SELECT min(p) FROM op))::INT), 9) AS joint FROM mp""")
def min_p_joint(spark, sf):
    o, z = _null_vs(spark, sf)
    f, fo = z.groupBy("family", "replicate").agg(F.max("stat").alias("m")), o.groupBy("family").agg(F.max("o").alias("o"))
    at_least = F.count("*").over(W.partitionBy("family").orderBy(F.desc("m")).rangeBetween(W.unboundedPreceding, 0))
    rp = f.select("replicate", ((at_least - 1) / (F.count("*").over(W.partitionBy("family")) - 1)).alias("p"))
    op = f.join(fo, "family").groupBy("family").agg(stats.p_plain("m", "o").alias("p")).agg(F.min("p").alias("o"))
    mp = rp.groupBy("replicate").agg(F.min("p").alias("p")).crossJoin(F.broadcast(op))  # one row
    return mp.agg(F.round(F.max("o"), 9).alias("min_p"), F.round(F.avg((F.col("p") <= F.col("o")).cast("int")), 9).alias("joint"))


LAGGED = f"""WITH {IND}, {BANK}, ks AS (SELECT unnest([0, 1, 3, 7, 14]) AS k), first_day AS (SELECT min(dd) + 14 AS d0 FROM bank),
  j AS (SELECT family, variable, k, b.value, i.y, i.dd FROM bank b, ks, first_day JOIN ind i ON i.dd = b.dd + k WHERE i.dd >= d0),
  e AS (SELECT variable, k, list_sort(list_distinct(quantile_cont(value, {EDGES}))) AS e FROM j GROUP BY ALL),
  bb AS (SELECT family, variable, k, dd, y, len(list_filter(e[2:len(e)-1], lambda x: x <= value))::INTEGER AS bin FROM j JOIN e USING (variable, k)),
  counted AS (SELECT family, variable, k, bin, count(*) AS n, sum(y)::BIGINT AS hits FROM bb GROUP BY ALL), {STAT.format(name="obs", keys="family, variable, k", src="counted")}"""


def lagged_stats(spark, sf):
    b = bank(spark, sf)
    first = b.agg((F.min("dd") + 14).alias("d0"))
    x = b.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 1, 3, 7, 14)]))).withColumn("dd", F.col("dd") + F.col("k"))
    j = x.join(indicator(spark, sf).select("dd", "y"), "dd").crossJoin(F.broadcast(first)).where("dd >= d0")  # one row
    return binning.max_deviation(binning.rates(binning.assign(j, "value", ["variable", "k"]), "y", ["family", "variable", "k"]), ["family", "variable", "k"])


@query(LAGGED + " SELECT family, variable, k, round(stat, 9) AS stat FROM obs")
def lag_sweep_grid(spark, sf):
    return lagged_stats(spark, sf).select("family", "variable", "k", F.round("stat", 9).alias("stat"))


@query(LAGGED + " SELECT family, variable, k, round(stat, 9) AS stat FROM obs QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(stat, 9) DESC, variable, k) = 1")
def best_lag_per_family(spark, sf):
    s = lagged_stats(spark, sf).withColumn("stat", F.round("stat", 9))
    best = F.row_number().over(W.partitionBy("family").orderBy(F.desc("stat"), "variable", "k"))
    return s.withColumn("i", best).where("i = 1").select("family", "variable", "k", "stat")


@query(f"""WITH {BINNED}, h AS (SELECT variable, (pos >= m // 2)::INTEGER AS half, bin, count(*) AS n, sum(y)::BIGINT AS hits FROM (SELECT *, count(*) OVER (PARTITION BY variable) AS m FROM binned) GROUP BY ALL),
  {STAT.format(name="s", keys="variable, half", src="h")} SELECT variable, round(max(stat) - min(stat), 9) AS gap FROM s GROUP BY variable""")
def half_split_stability(spark, sf):
    b = binned_bank(spark, sf).withColumn("half", (F.col("pos") >= F.floor(F.count("*").over(W.partitionBy("variable")) / 2)).cast("int"))
    s = binning.max_deviation(binning.rates(b, "y", ["variable", "half"]), ["variable", "half"])
    return s.groupBy("variable").agg(F.round(F.max("stat") - F.min("stat"), 9).alias("gap"))


SEEDED = xorshift("x0", "SELECT c_custkey AS s, (c_custkey + 777)::BIGINT AS x FROM customer", 10)


@query(f"WITH RECURSIVE {SEEDED} SELECT s AS custkey, (i + 1)::INTEGER AS i, x AS draw FROM x0 WHERE i >= 0")
def xorshift_stream(spark, sf):
    """Eleven draws of a generator that each customer seeds."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return c.select("custkey", F.posexplode(stream(F.col("custkey") + 777, 11)).alias("i", "draw")).select("custkey", (F.col("i") + 1).alias("i"), "draw")


@query(f"""WITH RECURSIVE {SEEDED}, d AS (SELECT s, i, floor(x / 4294967296.0::DOUBLE * (12 - i))::BIGINT AS j FROM x0 WHERE i >= 0),
  p AS (SELECT c_custkey AS s, 12::BIGINT AS k, range(0, 12) AS a FROM customer UNION ALL SELECT p.s, k - 1, list_transform(a, lambda v, ix: CASE WHEN ix = k THEN a[j + 1] WHEN ix = j + 1 THEN a[k] ELSE v END) FROM p JOIN d ON d.s = p.s AND d.i = 12 - k WHERE k > 1)
  SELECT s AS custkey, (pl - 1)::INTEGER AS pos, v::INTEGER AS value FROM (SELECT s, unnest(range(1, 13)) AS pl, unnest(a) AS v FROM p WHERE k = 1)""")
def fisher_yates_perm(spark, sf):
    """The permutation of twelve that each customer seeds."""
    n = 12
    start = F.struct((F.col("c_custkey") + 777).cast("long").alias("x"), F.sequence(F.lit(0), F.lit(n - 1)).alias("a"))

    def swap(acc, k):
        x = step(acc["x"])
        j = below(x, k + 1).cast("int")
        a = acc["a"]
        return F.struct(x.alias("x"), F.transform(a, lambda v, i: F.when(i == k, F.get(a, j)).when(i == j, F.get(a, k)).otherwise(v)).alias("a"))

    perm = F.aggregate(F.sequence(F.lit(n - 1), F.lit(1), F.lit(-1)), start, swap, lambda acc: acc["a"])
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.posexplode(perm).alias("pos", "value"))


@query(f"WITH {BINNED}, r AS (SELECT dd, family, variable, (row_number() OVER (PARTITION BY variable ORDER BY value, dd) - 0.5) / count(*) OVER (PARTITION BY variable) AS r FROM binned) SELECT dd, sum((abs(r - 0.5) >= 0.45)::INT)::BIGINT AS n_extreme, count(DISTINCT CASE WHEN abs(r - 0.5) >= 0.45 THEN family END) AS families, round(max(abs(r - 0.5)), 9) AS top FROM r GROUP BY dd")
def coextreme_count(spark, sf):
    from pulseframe.operators.grid import rank_normal

    r = joined_bank(spark, sf).select("dd", "family", F.abs(rank_normal("value", "dd", ["variable"]) - 0.5).alias("x"))
    ext = F.col("x") >= 0.45
    return r.groupBy("dd").agg(F.sum(ext.cast("long")).alias("n_extreme"), F.count_distinct(F.when(ext, F.col("family"))).alias("families"), F.round(F.max("x"), 9).alias("top"))


@query(f"WITH {BINNED} SELECT variable, round(avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0), 6) AS contrast FROM binned GROUP BY variable")
def contrast_means(spark, sf):
    return joined_bank(spark, sf).groupBy("variable").agg(F.round(stats.contrast(F.col("value"), F.col("y") == 1), 6).alias("contrast"))


@query(f"WITH {BINNED} SELECT variable, round(avg(y) FILTER (bin >= 8) / avg(y) FILTER (bin < 8), 9) AS ratio FROM binned GROUP BY variable")
def rate_ratio(spark, sf):
    return binned_bank(spark, sf).groupBy("variable").agg(F.round(stats.rate_ratio(F.col("bin") >= 8, F.col("y")), 9).alias("ratio"))


@query(f"WITH {BINNED}, t AS (SELECT variable, unnest([0.5, 0.75, 0.9, 0.95]) AS q, unnest(quantile_cont(value, [0.5, 0.75, 0.9, 0.95])) AS c FROM binned GROUP BY variable) SELECT b.variable, q::DOUBLE AS q, count(*) AS n, round(avg(y), 9) AS rate FROM binned b JOIN t ON b.variable = t.variable AND value >= c GROUP BY b.variable, q")
def tail_rates(spark, sf):
    j = joined_bank(spark, sf)
    qs = [0.5, 0.75, 0.9, 0.95]
    t = j.groupBy("variable").agg(F.percentile("value", F.array(*map(F.lit, qs))).alias("c")).select("variable", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), "c")).alias("t")).select("variable", "t.q", "t.c")
    return j.join(t, "variable").where("value >= c").groupBy("variable", "q").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"))


@query(f"WITH {BINNED} SELECT round(corr(a.value, b.value), 6) AS r, round(pow(corr(a.value, b.value), 2), 6) AS r2 FROM binned a JOIN binned b ON a.dd = b.dd AND a.variable = 'price' AND b.variable = 'quantity'")
def pearson_retention(spark, sf):
    j = joined_bank(spark, sf)
    w = j.groupBy("dd").agg(F.max(F.when(F.col("variable") == "price", F.col("value"))).alias("a"), F.max(F.when(F.col("variable") == "quantity", F.col("value"))).alias("b"))
    return w.agg(F.round(F.corr("a", "b"), 6).alias("r"), F.round(F.pow(F.corr("a", "b"), 2), 6).alias("r2"))


@query(f"WITH {BINNED}, r AS (SELECT bin, hits / n::DOUBLE AS rate FROM counted WHERE variable = 'price'), k AS (SELECT bin, row_number() OVER (ORDER BY rate, bin) AS k FROM r) SELECT round(corr(bin, k), 9) AS rho FROM k")
def spearman_deciles(spark, sf):
    c = binning.rates(binned_bank(spark, sf).where("variable = 'price'"), "y", []).withColumn("rate", F.col("hits") / F.col("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rate", "bin"))).agg(F.round(F.corr("bin", "k"), 9).alias("rho"))  # ten rows


@query(f"WITH {BINNED} SELECT coalesce(family, '*') AS family, coalesce(variable, '*') AS variable, count(*) AS n, sum(y)::BIGINT AS hits FROM binned GROUP BY ROLLUP (family, variable)")
def rollup_family(spark, sf):
    return joined_bank(spark, sf).rollup("family", "variable").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).select(F.coalesce("family", F.lit("*")).alias("family"), F.coalesce("variable", F.lit("*")).alias("variable"), "n", "hits")


@query(f"WITH {BINNED} SELECT variable, dd, value, (pos + 7919) % count(*) OVER (PARTITION BY variable) AS shifted FROM binned")
def block_rotation(spark, sf):
    """Each whole series turned by one offset."""
    b = binned_bank(spark, sf).withColumn("n", F.count("*").over(W.partitionBy("variable")))
    return nulls.rotate(b, "pos", F.col("n"), F.lit(7919)).select("variable", "dd", "value", F.col("pos").alias("shifted"))


@query(f"WITH {BINNED}, b AS (SELECT variable, dd, pos, (max(pos) OVER (PARTITION BY variable) + 1) // 30 AS blocks FROM binned) SELECT variable, dd, (CASE WHEN pos < blocks * 30 THEN (pos // 30 + 7919) % blocks * 30 + pos % 30 ELSE pos END)::BIGINT AS moved FROM b")
def block_permutation(spark, sf):
    """Whole blocks of 30 days moved by an affine map; what is left over at the end stays."""
    b = binned_bank(spark, sf).withColumn("blocks", F.floor((F.max("pos").over(W.partitionBy("variable")) + 1) / 30))
    moved = F.when(F.col("pos") < F.col("blocks") * 30, nulls.permute_blocks(F.col("pos"), 30, F.col("blocks"), 1, 7919)).otherwise(F.col("pos"))
    return b.select("variable", "dd", moved.cast("long").alias("moved"))


@query(f"WITH {BINNED}, b AS (SELECT variable, dd, pos, value, pos // 30 AS block, (pos * 7919) % 104729 AS r FROM binned), x AS (SELECT *, row_number() OVER (PARTITION BY variable, block ORDER BY pos) AS i FROM b), z AS (SELECT variable, block, value, row_number() OVER (PARTITION BY variable, block ORDER BY r, pos) AS i FROM b) SELECT x.variable, x.dd, z.value AS permuted FROM x JOIN z USING (variable, block, i)")
def block_permute(spark, sf):
    b = binned_bank(spark, sf).withColumn("block", F.concat_ws(":", "variable", F.floor(F.col("pos") / 30))).withColumn("r", F.pmod(F.col("pos") * 7919, F.lit(104729)))
    return nulls.permute_within(b, "block", "pos", F.col("r"), "value").select("variable", "dd", "permuted")
