"""Claims that one series moves with another: sixteen axes of how each was made, as aggregates over all claims at once, and
generators of claims of known kinds.

All nulls turn the events against the series. The statistic of every turn of every claim comes from one sparse correlation:
events meet their claim's bins, and pairs are counted by their difference of positions modulo the length. The rest are windows
and grouped sums. Draws are portable: xorshift streams for turns, checksums of names for generated series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import rng
from pulseframe.operators import binning, decluster, spectral
from pulseframe.session import cut

# The axes and kinds, bins, turns of a null, days that a turn stays away from none, and the seed of all draws.
AXES = ["stat", "p_shift", "log_p", "detect_ratio", "auc_chrono", "auc_random", "split_delta", "date_r2", "half_gap", "ac1", "trend_x", "trend_y", "z_full", "z_dec", "spectral", "null_fpr"]
KINDS = ["REAL", "NULL", "CALENDAR", "CLUSTER", "LOOKAHEAD", "SEARCH", "GROWTH"]
BINS, TURNS, MARGIN, SEED = 10, 200, 30, 20260819
TRIES, RIDGE, NEWTON = 60, 0.01, 6


def every_turn(binned: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """(key.., shift, stat): for every turn of the events (key.., t) against bins (key.., t, bin, n), the largest relative deviation of a bin's rate.

    A key's bins travel as one array, as long as its series of days; each event meets all of them, and only counts are shuffled.
    """
    lists = binned.groupBy(*key, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "bin"))), lambda r: r["bin"]).alias("bins"))
    sizes = binned.groupBy(*key, "bin").agg(F.count("*").alias("size"))
    total = sizes.groupBy(*key).agg(F.count("*").alias("filled"), F.sum("size").alias("n")).join(events.groupBy(*key).agg(F.count("*").alias("ny")), key)
    met = events.select(*key, F.col("t").alias("at")).join(lists, key).select(*key, "n", "at", F.posexplode("bins").alias("pos", "bin"))
    hits = met.groupBy(*key, F.pmod(F.col("pos") - F.col("at"), F.col("n")).cast("int").alias("shift"), "bin").agg(F.count("*").alias("hits"))
    apart = F.abs(F.col("hits") / F.col("size") / (F.col("ny") / F.col("n")) - 1)
    both = hits.join(sizes, [*key, "bin"]).join(total, key)
    stat = both.groupBy(*key, "shift").agg(F.max(apart).alias("most"), F.count("*").alias("met"), F.first("filled").alias("filled"))
    return stat.select(*key, "shift", F.when(F.col("met") < F.col("filled"), F.greatest("most", F.lit(1.0))).otherwise(F.col("most")).alias("stat"))


def turns(claims: DataFrame, seed: int, count: int) -> DataFrame:
    """(claim, n, i, shift): portable draws of turns at least MARGIN away from none."""
    drawn = claims.select("claim", "n", F.posexplode(rng.stream(seed, count)).alias("i", "draw"))
    return drawn.select("claim", "n", "i", (MARGIN + rng.below(F.col("draw"), F.col("n") - 2 * MARGIN)).cast("int").alias("shift"))


def _shift_axes(claims: DataFrame, table: DataFrame, few: DataFrame) -> list[DataFrame]:
    own = table.where("shift = 0").select("claim", F.col("stat").alias("own"))
    null = turns(claims, SEED, TURNS).join(table, ["claim", "shift"]).join(own, "claim").groupBy("claim")
    first = null.agg(F.first("own").alias("stat"), ((F.count_if(F.col("stat") >= F.col("own")) + 1) / (F.count("*") + 1)).alias("p_shift"), F.percentile("stat", F.lit(0.95)).alias("_most"))  # a claim's own turns
    first = first.select("claim", "stat", "p_shift", (-F.log10(F.greatest("p_shift", F.lit(1e-4)))).alias("log_p"), (F.col("stat") / F.nullif("_most", F.lit(0.0))).alias("detect_ratio"))

    def z(t: DataFrame, name: str) -> DataFrame:
        some = turns(claims, SEED + 2, 100).join(t, ["claim", "shift"]).join(t.where("shift = 0").select("claim", F.col("stat").alias("own")), "claim")
        return some.groupBy("claim").agg(((F.first("own") - F.avg("stat")) / F.nullif(F.stddev_pop("stat"), F.lit(0.0))).alias(name))

    z_dec = z(few, "z_dec")
    z_full = z(table.join(few.select("claim").distinct(), "claim", "left_semi"), "z_full")  # both or neither
    tries = turns(claims, SEED + 1, TRIES).select("claim", "n", "i", F.col("shift").alias("k"))
    again = tries.select("*", F.posexplode(rng.stream((F.col("i") + SEED + 7).cast("long"), TRIES)).alias("_j", "draw"))
    again = again.select("claim", "i", "k", F.pmod(F.col("k") + MARGIN + rng.below(F.col("draw"), F.col("n") - 2 * MARGIN), F.col("n")).cast("int").alias("shift"))
    pretended = table.select("claim", F.col("shift").alias("k"), F.col("stat").alias("own"))
    p = again.join(table, ["claim", "shift"]).join(pretended, ["claim", "k"]).groupBy("claim", "i").agg(((F.count_if(F.col("stat") >= F.col("own")) + 1) / (F.count("*") + 1)).alias("p"))
    return [first, z_full, z_dec, p.groupBy("claim").agg(F.avg((F.col("p") < 0.05).cast("double")).alias("null_fpr"))]


def _newton(rows: DataFrame) -> DataFrame:
    """(claim, split, w0, w1, w2): ridge-penalised logistic weights of (claim, split, a, b, y); a 3 x 3 system a step, solved in closed form."""
    key = ["claim", "split"]
    w = rows.select(*key).distinct().select(*key, *[F.lit(0.0).alias(f"w{i}") for i in range(3)])
    for _ in range(NEWTON):
        x = [F.lit(1.0), F.col("a"), F.col("b")]
        p = 1 / (1 + F.exp(-(F.col("w0") + F.col("w1") * x[1] + F.col("w2") * x[2])))
        d = rows.join(w, key).withColumn("_p", p)
        sums = {f"g{i}": F.avg((F.col("_p") - F.col("y")) * x[i]) for i in range(3)} | {f"h{i}{j}": F.avg(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i in range(3) for j in range(i, 3)}
        t = d.groupBy(*key, "w0", "w1", "w2").agg(*[v.alias(k) for k, v in sums.items()])
        h = lambda i, j: F.col(f"h{min(i, j)}{max(i, j)}") + (RIDGE if i == j and i else 1e-9 if i == j else 0.0)
        g = [F.col(f"g{i}") + (RIDGE * F.col(f"w{i}") if i else 0.0) for i in range(3)]
        det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        m = [[h(i, j) for j in range(3)] for i in range(3)]
        step = [det([[g[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / det(m) for k in range(3)]
        w = cut(t.select(*key, *[(F.col(f"w{k}") - step[k]).alias(f"w{k}") for k in range(3)]))
    return w


def _aucs(s: DataFrame) -> DataFrame:
    """AUCs on the last 30 % of days, and on 30 % by a checksum, of a logistic regression on the series and its slope."""
    w = W.partitionBy("claim").orderBy("t")
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    slope = (F.coalesce(after, F.col("x")) - F.coalesce(before, F.col("x"))) / (after.isNotNull().cast("int") + before.isNotNull().cast("int"))
    d = s.withColumn("_s", slope)
    unit = d.groupBy("claim").agg(*[f(c).alias(f"{n}{c}") for c in ("x", "_s") for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    d = d.join(unit, "claim").select("claim", "t", "n", "y", *[((F.col(c) - F.col(f"m{c}")) / F.coalesce(F.nullif(f"d{c}", F.lit(0.0)), F.lit(1.0))).alias(n) for c, n in (("x", "a"), ("_s", "b"))])
    mixed = F.row_number().over(W.partitionBy("claim").orderBy(F.crc32(F.concat_ws(":", F.lit(SEED), "t").cast("binary")), "t")) - 1
    d = d.withColumn("_r", mixed).withColumn("split", F.explode(F.array(F.lit("auc_chrono"), F.lit("auc_random"))))
    place = F.when(F.col("split") == "auc_chrono", F.col("t")).otherwise(F.col("_r"))
    d = cut(d.withColumn("fit", place < F.floor(F.col("n") * 0.7)).drop("_r"))
    weights = _newton(d.where("fit").select("claim", "split", "a", "b", "y"))
    held = d.where("not fit").join(weights, ["claim", "split"]).withColumn("z", F.col("w0") + F.col("w1") * F.col("a") + F.col("w2") * F.col("b"))
    rank = F.row_number().over(W.partitionBy("claim", "split").orderBy("z", "t"))
    pos = F.sum("y")
    auc = (F.sum(F.col("r") * F.col("y")) - pos * (pos + 1) / 2) / F.nullif(pos * (F.count("*") - pos), F.lit(0))
    out = held.withColumn("r", rank).groupBy("claim", "split").agg(auc.alias("auc")).groupBy("claim").pivot("split", ["auc_chrono", "auc_random"]).agg(F.first("auc"))
    return out.withColumn("split_delta", F.col("auc_random") - F.col("auc_chrono"))


@F.pandas_udf(T.DoubleType())
def _r2(moments: pd.Series) -> pd.Series:
    """R2 of the last of nine columns on the others, from their covariances row by row; a small system for each claim."""

    def one(m) -> float:
        c = np.zeros((9, 9))
        c[np.triu_indices(9)] = m
        c = c + np.triu(c, 1).T
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        live = np.flatnonzero(sd[:8] > 0)
        if sd[8] == 0:
            return float("nan")
        a, b = c[np.ix_(live, live)] / np.outer(sd[live], sd[live]), c[live, 8] / sd[live] / sd[8]
        return float(b @ np.linalg.lstsq(a, b, rcond=1e-12)[0])

    return moments.map(one)


def _date(s: DataFrame) -> DataFrame:
    """R2 of time on x, its square and three harmonics of x in its own spread."""
    z = F.col("x") / (F.col("sd") + 1e-12)
    basis = [F.col("x"), F.col("x") * F.col("x"), *[f(k * z) for k in (1, 2, 3) for f in (F.sin, F.cos)], F.col("t").cast("double")]
    d = s.select("claim", *[b.alias(f"b{i}") for i, b in enumerate(basis)])
    return d.groupBy("claim").agg(F.array(*[F.covar_pop(f"b{i}", f"b{j}") for i in range(9) for j in range(i, 9)]).alias("m")).select("claim", _r2("m").alias("date_r2"))


def _lines(s: DataFrame) -> DataFrame:
    w = W.partitionBy("claim").orderBy("t")
    d = s.withColumn("_d", F.col("x") - F.col("mean")).withColumn("_p", F.lag("_d").over(w)).withColumn("_y", F.sum("y").over(w.rowsBetween(-182, 182)) / 365)
    square = lambda a, b: F.coalesce(F.nanvl(F.pow(F.corr(a, b), F.lit(2)), F.lit(0.0)), F.lit(0.0))
    return d.groupBy("claim").agg((F.sum(F.col("_d") * F.col("_p")) / F.sum(F.col("_d") * F.col("_d"))).alias("ac1"), square(F.col("t").cast("double"), F.col("x")).alias("trend_x"), square(F.col("t").cast("double"), F.col("_y")).alias("trend_y"))


def _halves(s: DataFrame) -> DataFrame:
    h = s.select("claim", (F.col("t") >= F.expr("n div 2")).cast("int").alias("half"), "x", "y")
    counted = binning.rates(binning.assign(h, "x", ["claim", "half"], BINS, unique=False), "y", ["claim", "half"])
    stat = binning.max_deviation(counted, ["claim", "half"], 0.0, relative=True).groupBy("claim").pivot("half", [0, 1]).agg(F.first("stat"))
    return stat.select("claim", (F.abs(F.col("0") - F.col("1")) / F.nullif(F.col("0") + F.col("1"), F.lit(0.0))).alias("half_gap"))


def _spectral(s: DataFrame) -> DataFrame:
    p = spectral.power(s.where("n >= 64"), "t", "x", ["claim"])
    ranked = p.withColumn("_r", F.row_number().over(W.partitionBy("claim").orderBy(F.desc("power"), "k")))
    return ranked.groupBy("claim").agg((F.sum(F.when(F.col("_r") <= 5, F.col("power"))) / F.nullif(F.sum("power"), F.lit(0.0))).alias("spectral"))


def fingerprints(series: DataFrame) -> DataFrame:
    """(claim, axes..) of (claim, pos, x, y): one value a day, y an indicator. Claims that are short, that hold missing values, or whose x or y doesn't vary, have no axes."""
    w = W.partitionBy("claim")
    s = series.select("claim", (F.row_number().over(w.orderBy("pos")) - 1).cast("int").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y"))
    s = s.withColumns({"n": F.count("*").over(w).cast("int"), "mean": F.avg("x").over(w), "sd": F.stddev_pop("x").over(w), "_ny": F.sum("y").over(w), "_ok": F.count_if(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & F.col("y").isNotNull()).over(w)})
    whole = (F.col("n") >= 2 * MARGIN + 16) & (F.col("_ok") == F.col("n")) & (F.col("sd") > 0) & (F.col("_ny") > 0) & (F.col("_ny") < F.col("n"))
    s = cut(s.where(whole).drop("_ny", "_ok"))
    claims = s.select("claim", "n").distinct()
    binned = cut(binning.assign(s, "x", ["claim"], BINS, unique=False).select("claim", "t", "n", "bin", "y"))
    events = binned.where("y = 1").select("claim", "t")
    table = cut(every_turn(binned, events, ["claim"]))
    kept = events.groupBy("claim").agg(decluster.thin(F.collect_list("t"), 5).alias("_days")).where(F.size("_days") >= 100)  # days of one series
    few = cut(every_turn(binned, kept.select("claim", F.explode("_days").alias("t")), ["claim"]))
    out = series.select("claim").distinct()
    for part in (*_shift_axes(claims, table, few), _aucs(s), _date(s), _halves(s), _lines(s), _spectral(s)):
        out = out.join(part, "claim", "left")
    return out.select("claim", *AXES)


# Generators of claims of known kinds. Each day and claim has its own draws, named by what they decide.

# Waves that make up a smooth series, and the range of their periods in days.
WAVES, PERIODS = 8, (10.0, 120.0)


def draw(*names: Column | str) -> Column:
    """A uniform number in (0, 1) from the checksum of names; any engine has the same."""
    cols = [n if isinstance(n, Column) else F.lit(n) for n in names]
    return (F.crc32(F.concat_ws(":", *cols).cast("binary")) + 0.5) / 4294967296.0


def between(u: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) * u


def normal(*names: Column | str) -> Column:
    return F.sqrt(-2 * F.log(draw("r", *names))) * F.cos(2 * math.pi * draw("a", *names))


def _tuned(name: str | Column) -> Column:
    """array<struct<rate, phase>> of the waves that `claim` and `name` decide."""
    period = lambda j: PERIODS[0] * F.pow(F.lit(PERIODS[1] / PERIODS[0]), draw("period", name, F.col("claim"), str(j)))
    return F.array(*[F.struct((2 * math.pi / period(j)).alias("rate"), (2 * math.pi * draw("phase", name, F.col("claim"), str(j))).alias("phase")) for j in range(WAVES)])


def _waves(t: Column, tuned: str) -> Column:
    """A smooth series of variance 1, about: cosines of drawn periods and phases."""
    out = F.lit(0.0)
    for j in range(WAVES):
        wave = F.get(tuned, F.lit(j))
        out = out + F.cos(wave["rate"] * t + wave["phase"])
    return out * math.sqrt(2.0 / WAVES)


def examples(base: DataFrame, each: int, seed: int = SEED) -> DataFrame:
    """(claim, kind, index, pos, x, y) of claims of all kinds on the days of a series (dd, y); `each` of a kind.

    REAL: events move to days on which x is high. NULL: the events are turned. CALENDAR: x is a function of the date. CLUSTER: events
    follow a few first ones, longer where x is high. LOOKAHEAD: x averages the events to come. SEARCH: x is the best of many.
    GROWTH: both rise. Weak trends and noise are then added to some.
    """
    spark = base.sparkSession
    days = cut(base.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("dd")) - 1).alias("pos"), F.col("y").cast("int").alias("y")))  # one series of days
    whole = days.agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    claims = spark.range(each * len(KINDS)).select((F.col("id") % len(KINDS)).alias("_k"), F.expr(f"id div {len(KINDS)}").cast("int").alias("index"))
    claims = claims.select(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("_k").cast("int")).alias("kind"), "index").withColumn("claim", F.concat_ws("-", F.lit(seed), "kind", "index"))
    claims = claims.crossJoin(F.broadcast(whole)).withColumns({f"u{i}": draw("claim", F.col("claim"), str(i)) for i in range(8)})  # one row
    claims = cut(claims.withColumn("_own", _tuned("own")))
    kind = lambda *ks: F.col("kind").isin(*ks)
    turn = F.when(kind("NULL"), 60 + F.floor(F.col("u0") * F.greatest(F.col("n") - 120, F.lit(1)))).otherwise(F.lit(0))
    rows = claims.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("_from", F.pmod(F.col("pos") + turn, F.col("n")))
    rows = rows.join(days.select(F.col("pos").cast("long").alias("_from"), "y"), "_from").drop("_from")
    t, w = F.col("pos").cast("double"), W.partitionBy("claim").orderBy("pos")
    own = {"smooth": _waves(t, "_own"), "noise": normal("noise", F.col("claim"), F.col("pos")), "d0": draw("day", F.col("claim"), F.col("pos"), "0"), "d1": draw("day", F.col("claim"), F.col("pos"), "1")}
    rows = cut(rows.withColumns(own))
    high, rate, part = F.col("smooth") > 0.84, F.col("rate"), F.col("pos") / F.col("n")
    main = F.col("d0") < rate * between(F.col("u1"), 0.06, 0.15)
    last = F.last(F.when(main, F.struct("pos", "smooth")), ignorenulls=True).over(w)
    rows = rows.withColumn("_main", main).withColumn("_last", last)
    age = F.col("pos") - F.col("_last.pos")
    follows = (F.col("_last.smooth") > 0.3) & (age <= between(F.col("u2"), 25, 60)) & (F.col("d1") < F.pow(F.greatest(age, F.lit(1)).cast("double"), -between(F.col("u3"), 0.6, 0.9)))
    moved = F.when(F.col("d0") < between(F.col("u1"), 0.05, 0.6), high & (F.col("d1") < rate / 0.2)).otherwise(F.col("y") == 1)
    grown = F.col("d0") < F.least(rate * (0.2 + 1.6 * part), F.lit(1.0))
    made = F.when(kind("REAL"), moved).when(kind("CLUSTER"), F.coalesce(F.col("_main") | follows, F.lit(False))).when(kind("GROWTH"), grown).otherwise(F.col("y") == 1)
    rows = rows.withColumn("y", made.cast("int"))
    ahead = F.lit(None).cast("double")
    for lo, k in ((0.0, 5), (1 / 3, 10), (2 / 3, 20)):
        ahead = F.when(F.col("u1") >= lo, F.avg("y").over(w.rowsBetween(0, k))).otherwise(ahead)
    best = _best_of(claims.where(kind("SEARCH")).select("claim"), rows.where(kind("SEARCH")).select("claim", "pos", "y"))
    rows = rows.join(F.broadcast(best), "claim", "left")  # a row for each claim of that kind
    season = F.sin(2 * math.pi * (t / between(F.col("u1"), 300, 4000) + F.col("u2"))) + 0.3 * F.sin(2 * math.pi * (t / between(F.col("u3"), 200, 900) + F.col("u4")))
    x = F.when(kind("CALENDAR"), season + between(F.col("u5"), 0.05, 0.8) * F.col("noise")).when(kind("LOOKAHEAD"), ahead + between(F.col("u2"), 0.2, 0.8) * F.sqrt(rate * (1 - rate) / 5) * F.col("noise"))
    x = x.when(kind("SEARCH"), _waves(t, "_tried")).when(kind("GROWTH"), between(F.col("u2"), 1, 3) * part + 0.4 * F.col("smooth")).otherwise(F.col("smooth"))
    x = x + F.when(F.col("u6") < 0.3, part * F.col("u6")).otherwise(0.0) + F.when(F.col("u7") < 0.4, F.col("u7") * 0.5 * F.col("noise")).otherwise(0.0) * F.when(kind("LOOKAHEAD"), 0.1).otherwise(1.0)
    return rows.select("claim", "kind", "index", F.col("pos").cast("int").alias("pos"), x.alias("x"), "y")


def _best_of(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(claim, _tried): of 24 sets of waves the one whose smooth series goes most with y."""
    tried = claims.withColumn("name", F.explode(F.array(*[F.lit(f"try{j}") for j in range(24)])))
    tried = cut(tried.select("claim", "name", _tuned(F.col("name")).alias("_tried")))
    met = rows.join(tried, "claim").groupBy("claim", "name").agg(F.abs(F.corr(_waves(F.col("pos").cast("double"), "_tried"), F.col("y").cast("double"))).alias("r"))
    best = met.groupBy("claim").agg(F.max_by("name", F.struct("r", "name")).alias("name"))
    return tried.join(best, ["claim", "name"]).select("claim", "_tried")
