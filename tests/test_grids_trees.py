"""Binary grids, exact quantiles, boosted trees, spectra and fingerprints against brute force."""

import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import linear, quantiles, spectral
from pulseframe.plans import attribution, boosting, fingerprint
from pulseframe.sources import grids


def classic(path, wide=False):
    """A file of version 1 or 2 written by hand: fixed coordinates, a packed record variable, and a second one that makes records padded."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF" + (b"\x02" if wide else b"\x01") + struct.pack(">I", 3)
    head += struct.pack(">II", 10, 3) + name("time") + struct.pack(">I", 0) + name("lat") + struct.pack(">I", 2) + name("lon") + struct.pack(">I", 3)
    head += struct.pack(">II", 12, 1) + name("title") + struct.pack(">II", 2, 5) + b"hello\0\0\0"
    hours = name("units") + struct.pack(">II", 2, 30) + b"hours since 1970-01-02 00:00:0" + b"\0\0"
    scale = name("scale_factor") + struct.pack(">IId", 6, 1, 0.5) + name("add_offset") + struct.pack(">IId", 6, 1, 100.0) + name("missing_value") + struct.pack(">IIh", 3, 1, -9) + b"\0\0"
    specs = [("lat", [1], b"", 0, 5, 8), ("time", [0], hours, 1, 6, 8), ("pres", [0, 1, 2], scale, 3, 3, 12), ("flag", [0], b"", 0, 1, 4)]
    size = len(head) + 8 + sum(len(name(n)) + 4 + 4 * len(d) + 8 + len(a) + 8 + (8 if wide else 4) for n, d, a, *_ in specs)
    begins, out = [size, size + 8, size + 16, size + 28], head + struct.pack(">II", 11, 4)
    for (n, d, a, k, kind, vsize), begin in zip(specs, begins, strict=True):
        out += name(n) + struct.pack(f">I{len(d)}I", len(d), *d) + struct.pack(">II", 12 if k else 0, k) + a + struct.pack(">II", kind, vsize) + struct.pack(">q" if wide else ">I", begin)
    out += struct.pack(">2f", 10.0, -10.0)
    for r in range(3):
        out += struct.pack(">d", 24.0 * r) + struct.pack(">6h", *[(-9 if r == 1 and k == 4 else 10 * r + k) for k in range(6)]) + struct.pack(">b", r) + b"\0\0\0"
    with open(path, "wb") as f:
        f.write(out)


@pytest.mark.parametrize("wide", [False, True])
def test_packed_grids_are_read(spark, tmp_path, wide):
    classic(tmp_path / "a.nc", wide)
    g = grids.read_grid(spark, str(tmp_path), "tws,pres")
    assert g.columns == ["file", "time", "lat", "lon", "value"] and dict(g.dtypes)["lon"] == "bigint"
    got = {(r["time"], r["lat"], r["lon"]): r["value"] for r in g.collect()}
    want = {(1.0 + r, [10.0, -10.0][k // 3], k % 3): None if (r, k) == (1, 4) else 100 + 0.5 * (10 * r + k) for r in range(3) for k in range(6)}
    assert got == want
    assert {r["time"] for r in grids.read_grid(spark, f"file://{tmp_path}/a.nc", days=False).collect()} == {0.0, 24.0, 48.0}
    assert grids.read_grid(spark, str(tmp_path), "flag").select("value").collect()[2][0] == 2
    some = g.where("lon in (0, 2) and lat < 0 and time >= 2.0 and time <= 2.0")
    assert sorted(map(tuple, some.select("lon", "value").collect())) == [(0, 106.5), (2, 107.5)]
    with pytest.raises(Exception, match="no variable"):
        grids.read_grid(spark, str(tmp_path), "other").collect()
    (tmp_path / "b.nc").write_bytes(b"<html>")
    with pytest.raises(Exception, match="classic"):
        grids.read_grid(spark, str(tmp_path), "pres").collect()


def test_filters_leave_slabs_unopened(spark, tmp_path):
    rows = spark.range(0, 400).select((F.col("id") % 2 + 2000).alias("year"), (F.col("id") / 2).cast("int").cast("double").alias("day"), F.lit(0.0).alias("lat"), F.lit(5.0).alias("lon"), F.col("id").cast("double").alias("v"))
    path = f"{tmp_path}/g"
    grids.write_grid(rows, path, "year", "day", ["lat", "lon"], "v")
    assert sorted(os.listdir(path)) == ["2000.nc", "2001.nc"]
    g = grids.read_grid(spark, path, slab_bytes=80)  # ten days a slab
    assert g.rdd.getNumPartitions() == 40 and g.count() == 400
    few = g.where("day >= 55 and day < 75")
    assert few.rdd.getNumPartitions() == 6 and few.count() == 40
    assert g.where("day = 12.5").count() == 0 and g.where("lat > 1").count() == 0


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/g"
    good = spark.createDataFrame([("a", 1.0, 0.0, 3.0), ("a", 1.0, 0.0, 4.0), ("a", 0.0, 1.0, None), (None, 1.0, 0.0, 1.0)], "file string, t double, x double, v double")
    grids.write_grid(good, path, "file", "t", ["x"], "v")
    want = [("a.nc", 0.0, 0.0, None), ("a.nc", 0.0, 1.0, None), ("a.nc", 1.0, 0.0, 4.0), ("a.nc", 1.0, 1.0, None)]
    assert sorted(map(tuple, grids.read_grid(spark, path).collect()), key=str) == want
    bad = good.select("file", "t", "x", F.when(F.col("v") == 4.0, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        grids.write_grid(bad.withColumn("file", F.lit("b")), path, "file", "t", ["x"], "v")
    assert os.listdir(path) == ["a.nc"]


def test_exact_quantiles_equal_percentile(spark):
    r = random.Random(8)
    values = [(g, v) for g in ("a", "b", None) for v in [*[r.choice([r.gauss(0, 1), r.expovariate(1) * 1e9, 5.0]) for _ in range(300)], None, float("nan")]] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(values, "g string, v double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.97, 1.0]
    clean = df.where("v is not null and not isnan(v)")
    want = {(q["g"], p): x for q in clean.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("x")).where("g is not null").collect() for p, x in zip(probs, q["x"], strict=True)}
    got = {(q["g"], q["p"]): q["quantile"] for q in quantiles.exact(df.where("g is not null"), "v", probs, ["g"], cells=7).collect()}
    assert got == want
    for p in (0.0, 0.37, 0.5, 0.901, 1.0):
        for cells in (3, 4096):
            assert quantiles.one(df, "v", p, cells) == clean.agg(F.percentile("v", F.lit(p))).first()[0]
    assert quantiles.one(df.where("false"), "v", 0.5) is None


def test_density_of_kernels_of_own_widths(spark):
    from pulseframe.operators import joins

    r = random.Random(11)
    src = [(r.uniform(-50, 50), r.uniform(-50, 50), 10 ** r.uniform(-1, 1.5)) for _ in range(150)]
    tgt = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(60)]
    odd = [(1.0, 1.0, 0.0), (None, 1.0, 2.0), (1.0, 1.0, None)]
    t = spark.createDataFrame(tgt, "id int, x double, y double")
    got = {q["id"]: q["density"] for q in joins.kernel_density(spark.createDataFrame(src + odd, "x double, y double, width double"), t).collect()}
    for i, x, y in tgt:
        d2 = [((x - a) ** 2 + (y - b) ** 2, w) for a, b, w in src]
        assert abs(got[i] - sum(math.exp(-d / (2 * w * w)) / (2 * math.pi * w * w) for d, w in d2 if d <= 36 * w * w) / len(src)) < 1e-12
    none = spark.createDataFrame(odd, "x double, y double, width double")
    assert {q["density"] for q in joins.kernel_density(none, t).collect()} == {0.0}


def test_spectra_equal_the_direct_transform(spark):
    r = np.random.default_rng(3)
    rows = [(k, t, float(v)) for k, n in (("a", 100), ("b", 64), ("c", 33)) for t, v in enumerate(r.normal(size=n) + np.sin(np.arange(n)))]
    got = {(q["g"], q["k"]): q["power"] for q in spectral.power(spark.createDataFrame(rows, "g string, t int, v double"), "t", "v", ["g"]).collect()}
    for g, n in (("a", 64), ("b", 64), ("c", 32)):
        x = np.array([v for k, t, v in rows if k == g and t < n])
        want = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        assert np.allclose([got[g, k] for k in range(1, n // 2 + 1)], want, atol=1e-9) and sum(k[0] == g for k in got) == n // 2


def test_trees_over_a_table_learn_and_export(spark):
    r = random.Random(5)
    rows = []
    for i in range(500):
        a, b = r.gauss(0, 1), None if r.random() < 0.2 else r.gauss(0, 1)
        rows.append((i, a, float("nan") if b is None and r.random() < 0.5 else b, "none" if b is None else "high" if a + b > 0 else "low"))
    df = spark.createDataFrame(rows, "id int, a double, b double, y string")
    for target in ("y", "two"):
        d = df.withColumn("two", (F.col("y") == "high").cast("int"))
        bundle, fitted = boosting.fit(d, ["a", "b"], target, boosting.Settings(rounds=5, rate=0.5, levels=3, least=10), key="id")
        mine = d.select("id", F.col(target).alias("t"), boosting.scores(bundle, F.array("a", "b")).alias("s"))
        both = mine.join(fitted, mine["id"] == fitted["key"]).select("t", "s", "raw", boosting.softmax(F.col("s")).alias("p")).collect()
        assert len(both) == 500 and max(abs(x - y) for q in both for x, y in zip(q["s"], q["raw"], strict=True)) < 1e-9
        assert sum(bundle["classes"][max(range(len(q["p"])), key=q["p"].__getitem__)] == q["t"] for q in both) > 440
        assert all(abs(sum(q["p"]) - 1) < 1e-9 for q in both)
    one, _ = boosting.fit(df.where("y = 'low'"), ["a", "b"], "y")
    assert one["trees"] == [] and one["classes"] == ["low"]


def test_the_best_split_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(0, 0, j, None if c == 5 else c, r.gauss(0, 1), 0.25) for j in range(2) for c in range(6) for _ in range(8)]
    s = boosting.Settings(least=5, penalty=1.0)
    sums = spark.createDataFrame(rows, "k int, node int, j int, code int, g double, h double").groupBy("k", "node", "j", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    got = boosting.split_gains(sums, s).first()
    best = None
    for j in range(2):
        for c in range(5):
            for m in (0, 1):
                left = [x for x in rows if x[2] == j and (m if x[3] is None else x[3] <= c)]
                right = [x for x in rows if x[2] == j and x not in left]
                if min(len(left), len(right)) < 5:
                    continue
                part = lambda q: sum(x[4] for x in q) ** 2 / (sum(x[5] for x in q) + 1)
                gain = round(part(left) + part(right) - part(left + right), 6)
                best = max(best or (-1,), (gain, -j, -c, -m))
    assert (got["gain"], -got["j"], -got["code"], -got["missing_left"]) == best


def claim(name, x, y):
    return [(name, t, None if x[t] is None else float(x[t]), int(y[t])) for t in range(len(x))]


def test_fingerprints_recover_a_planted_signal(spark):
    r = np.random.default_rng(1)
    n = 1400
    x = r.normal(size=n)
    quiet, loud = (r.random(n) < 0.25).astype(int), (r.random(n) < 0.1 + 0.6 * (x > 1)).astype(int)
    t = np.arange(n)
    wave = np.sin(t / 9.0) + t / 100
    rows = claim("quiet", x, quiet) + claim("loud", x, loud) + claim("dated", wave, quiet) + claim("flat", np.ones(n), quiet) + claim("short", x[:50], loud[:50]) + claim("holes", [None, *x[1:]], loud)
    df = spark.createDataFrame(rows, "claim string, pos int, x double, y int")
    got = {q["claim"]: q.asDict() for q in fingerprint.fingerprints(df).collect()}
    a, b, d = got["quiet"], got["loud"], got["dated"]
    assert b["stat"] > 2 * a["stat"] and b["p_shift"] < 0.01 < a["p_shift"] and b["auc_chrono"] > 0.6 and b["z_full"] > 4 and b["null_fpr"] < 0.25
    assert d["date_r2"] > 0.9 > 0.3 > a["date_r2"] and d["trend_x"] > 0.9 and d["ac1"] > 0.9 and d["spectral"] > a["spectral"]
    assert all(got[c][axis] is None for c in ("flat", "short", "holes") for axis in fingerprint.AXES)
    one = df.where("claim = 'dated'")
    unit = F.col("x") / (float(np.std(wave)) + 1e-12)
    basis = [F.col("x"), F.col("x") * F.col("x"), *[f(k * unit) for k in (1, 2, 3) for f in (F.sin, F.cos)]]
    assert abs(linear.least_squares_r2(one, basis, F.col("pos").cast("double")) - d["date_r2"]) < 1e-6
    assert fingerprint.fingerprints(df.where("false")).count() == 0


def test_every_turn_equals_a_direct_count(spark):
    r = random.Random(2)
    n = 90
    bins, y = [r.randrange(4) for _ in range(n)], [int(r.random() < 0.1) for _ in range(n)]
    binned = spark.createDataFrame([("c", t, n, b) for t, b in enumerate(bins)], "claim string, t int, n int, bin int")
    events = spark.createDataFrame([("c", t) for t in range(n) if y[t]], "claim string, t int")
    got = {q["shift"]: q["stat"] for q in fingerprint.every_turn(binned, events, ["claim"]).collect()}
    base = sum(y) / n
    for k in range(n):
        rates = [np.mean([y[(t - k) % n] for t in range(n) if bins[t] == b]) for b in range(4)]
        assert abs(got[k] - max(abs(v - base) for v in rates) / base) < 1e-9


def test_examples_of_every_kind_repeat(spark):
    base = spark.range(400).select(F.col("id").cast("int").alias("dd"), (F.crc32(F.col("id").cast("string").cast("binary")) % 10 < 3).cast("int").alias("y"))
    make = lambda: sorted(map(tuple, fingerprint.examples(base, 1).select("claim", "kind", "pos", F.round("x", 9), "y").collect()))
    got = make()
    assert got == make() and len(got) == 7 * 400 and {q[1] for q in got} == set(fingerprint.KINDS) and {q[4] for q in got} == {0, 1} and not any(q[3] is None or math.isnan(q[3]) for q in got)


def test_kinds_are_told_apart_or_left_open(spark):
    r = random.Random(6)
    rows = [(f"{k}{i}", k, i, r.gauss(3.0 * (k == "b"), 1), r.gauss(0, 1) if i % 7 else None) for k in "ab" for i in range(60)] + [("far", "a", 59, 90.0, -90.0)]
    df = spark.createDataFrame(rows, "claim string, kind string, index int, u double, v double")
    got = attribution.attribute(df, ["u", "v"], "kind", F.col("index") < 25, F.col("index") < 45, {"a": 0.05}).collect()
    assert len(got) == 31 and next(q for q in got if q["claim"] == "far")["kinds"] is None
    held = [q for q in got if q["claim"] != "far"]
    assert np.mean([q["said"] == q["kind"] for q in held]) > 0.8 and np.mean([q["kinds"] is None or q["kind"] in q["kinds"] for q in held]) > 0.75
