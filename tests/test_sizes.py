"""What keeps steps bounded as tables grow: nothing that is exploded is broadcast, and results stay those of the plain definition."""

import math
import random

from pyspark.sql import functions as F

from pulseframe.operators import joins
from pulseframe.plans import audit
from pulseframe.sources import solar


def joined_by(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_events_near_others_are_not_broadcast(spark):
    r = random.Random(5)
    pts = [(i, r.randint(0, 60), r.uniform(-90, 90), r.choice([r.uniform(-180, 180), r.uniform(178, 180)])) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, hour int, lat double, lon double")
    other = joins.second(df, ["id", "hour", "lat", "lon"])
    one, two = joins.near_pairs(df, other, 900, (-4, 7)), joins.near_pairs(df, other, 900, (-4, 7), spread_b=True)
    assert all("BroadcastHashJoin" not in joined_by(p) for p in (one, two))
    ids = lambda p: sorted(map(tuple, p.select("id", "id2").collect()))
    assert ids(one) == ids(two) and len(ids(one)) > len(pts)


def test_field_rows_filed_under_days_are_not_broadcast(spark):
    r = random.Random(6)
    ev = [(i, r.randint(0, 3), r.randint(90, 120)) for i in range(60)] + [(60, None, 100), (61, 1, None)]
    fld = [(c, d, float(c + d)) for c in range(4) for d in range(80, 121) if r.random() < 0.8]
    events, field = spark.createDataFrame(ev, "id int, cell int, day int"), spark.createDataFrame(fld, "cell int, dd int, value double")
    met = joins.lag_window(events, field, ["cell"], "day", "dd", 1, 10)
    assert "BroadcastHashJoin" not in joined_by(met)
    got = sorted(map(tuple, met.select("id", "cell", "day", "dd", "lag", "value").collect()))
    assert got == sorted((i, c, t, d, t - d, v) for i, c, t in ev for k, d, v in fld if c == k and t is not None and 1 <= t - d <= 10)


def test_densities_above_the_marker_of_gaps_are_values(spark, tmp_path):
    line = lambda hour, v: " ".join(["2024", "61", str(hour), *["0"] * 20, v, "1"])
    (tmp_path / "omni2_2024.dat").write_text("\n".join(line(h, v) for h, v in enumerate(["5.5", "999.9", "999.90", "999.0", "2083.25", "12500.0", "x", "NaN"])))
    got = sorted((r["ts"].isoformat(), r["density"]) for r in solar.omni2(spark, str(tmp_path)).collect())
    assert got == [(f"2024-03-01T{h:02}:00:00", v) for h, v in ((0, 5.5), (3, 999.0), (4, 2083.25), (5, 12500.0))]


def test_the_neighbour_search_starts_with_as_few_as_it_asks_for(spark):
    r = random.Random(8)
    pts = [(float(i), float(j)) for i in range(20) for j in range(20)] + [(100 + r.random(), 100 + r.random()) for _ in range(60)]
    df = spark.createDataFrame(pts + [(None, 1.0)], "x double, y double")
    ring = joins.fitted_ring(df, 5, 64.0, 200.0)
    cells = {}
    for x, y in pts:
        cells.setdefault((x // ring, y // ring), []).append(1)
    assert sum(len(c) ** 2 for c in cells.values()) / len(pts) <= 5
    got = {(q["x"], q["y"]): q["width"] for q in joins.kth_neighbour(df, 5, 64.0).collect()}
    assert got.pop((None, 1.0)) is None
    assert all(abs(got[p] - sorted(math.dist(p, q) for q in pts if q != p)[4]) < 1e-9 for p in pts) and len(got) == len(pts)


def test_targets_at_one_place_ask_once_for_its_density(spark):
    src = spark.createDataFrame([(0.0, 0.0, 2.0), (3.0, 1.0, 5.0)], "x double, y double, width double")
    tgt = spark.createDataFrame([(i, 1.0, 1.0) for i in range(50)] + [(50, None, 1.0)], "id int, x double, y double")
    out = joins.kernel_density(src, tgt)
    want = sum(math.exp(-((1 - x) ** 2 + (1 - y) ** 2) / (2 * w * w)) / (2 * math.pi * w * w) for x, y, w in ((0, 0, 2), (3, 1, 5))) / 2
    assert [r["density"] for r in out.where("id = 50").collect()] == [0.0]
    assert out.columns == ["id", "x", "y", "density"] and len(rows := out.where("id < 50").collect()) == 50 and all(abs(r["density"] - want) < 1e-15 for r in rows)
    plan = joined_by(out)
    assert plan.index("Generate explode") > plan.index("HashAggregate(keys=[x") and "HashAggregate(keys=[x" in plan[plan.rindex("Generate explode"):]  # places are made distinct before they are copied


def test_a_place_at_the_very_reach_of_a_kernel_counts(spark):
    w = math.sqrt(18.0)  # w * w is less than 18
    src = spark.createDataFrame([(0.0, 0.0, w)], "x double, y double, width double")
    tgt = spark.createDataFrame([(1, 18.0, 18.0)], "id int, x double, y double")
    assert w * w < 18 and math.sqrt(36.0 * 18) <= 6 * w
    assert joins.kernel_density(src, tgt).first()["density"] > 0


def test_held_out_vectors_are_not_shuffled_for_every_split(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 3, 1.0), r.gauss(0.0, 1.0)], i % 3) for i in range(300)]
    got = audit.centroid_splits(spark.createDataFrame(rows, "id long, x array<double>, label int"), "id", "x", "label", 4)
    plan = joined_by(got)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for q in got.collect():
        held = lambda i: (i * 7919 + q["split"] * 104729) % 100003 % 10 < 3  # noqa: B023, E731
        mu = {c: [sum(x[k] for i, x, l in rows if l == c and not held(i)) / sum(l == c and not held(i) for i, _, l in rows) for k in (0, 1)] for c in range(3)}
        said = [(min((round(math.dist(x, m) ** 2, 9), c) for c, m in mu.items())[1], l) for i, x, l in rows if held(i)]
        assert q["n"] == len(said) and abs(q["accuracy"] - sum(a == b for a, b in said) / len(said)) < 1e-9
