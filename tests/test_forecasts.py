"""Zones, alarms with timers, polled streams, table functions and sequential records on small inputs."""

import math
import os
import struct
from collections import defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from pulseframe.functions import calendar, tables
from pulseframe.plans import zones
from pulseframe.sources import fortran, polled
from pulseframe.streaming import alarms, counterparts

# Zones

LAW = zones.Triggering(m0=5.0, k=0.02, alpha=1.4, c=0.05, p=1.25, d=12.0, gamma=0.5, q=1.5)
BOX = "zone string, lat_lo double, lat_hi double, lon_lo double, lon_hi double"
EVENT = "id long, day double, lat double, lon double, mag double"


def test_radical_inverse(spark):
    got = [r[0] for r in spark.range(8).orderBy("id").select(zones.radical_inverse(F.col("id"), 2, 8)).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]
    assert [round(r[0] * 9) for r in spark.range(9).orderBy("id").select(zones.radical_inverse(F.col("id"), 3, 9)).collect()] == [0, 3, 6, 1, 4, 7, 2, 5, 8]


def test_zone_integral_against_its_closed_form(spark):
    """At q = 1.5 the kernel over a rectangle is a solid angle."""
    boxes = spark.createDataFrame([("z", -2.0, 3.0, -1.0, 4.0), ("far", 60.0, 61.0, 0.0, 1.0)], BOX)
    events = spark.createDataFrame([(1, -10.0, 0.5, 1.0, 8.0), (2, -2.0, 2.0, 0.0, 7.0)], EVENT)
    got = {(r["zone"], r["id"]): r["expected"] for r in zones.contributions(events, boxes, 0.0, 7.0, LAW, n=20000, tail=1e-4).collect()}

    def exact(age, lat, lon, mag):
        w = 144 * 10 ** (0.5 * (mag - 5))
        made = 0.02 * math.exp(1.4 * (mag - 5)) * ((age + 7.05) ** -0.25 - (age + 0.05) ** -0.25) / -0.25
        corner = lambda x, y: math.atan(x * y / math.sqrt(w * (w + x * x + y * y))) / (2 * math.pi)
        x, y = [(v - lon) * zones.KM for v in (-1, 4)], [(v - lat) * zones.KM for v in (-2, 3)]
        return made * (corner(x[1], y[1]) - corner(x[0], y[1]) - corner(x[1], y[0]) + corner(x[0], y[0]))

    assert got["z", 1] == pytest.approx(exact(10, 0.5, 1.0, 8.0), rel=0.01)
    assert got["z", 2] == pytest.approx(exact(2, 2.0, 0.0, 7.0), rel=0.01)


def test_zone_drivers_with_ties_nulls_and_none(spark):
    boxes = spark.createDataFrame([("a", -1.0, 1.0, -1.0, 1.0), ("empty", 80.0, 81.0, 0.0, 1.0)], BOX)
    rows = [(i, -1.0, 0.0, 0.0, 6.0) for i in range(5, 0, -1)] + [(6, 1.0, 0.0, 0.0, 9.0), (7, None, 0.0, 0.0, 9.0), (8, -1.0, 0.0, 0.0, 4.0), (9, -1.0, 0.0, 0.0, None)]
    got = zones.forecast(zones.contributions(spark.createDataFrame(rows, EVENT), boxes, 0.0, 7.0, LAW, n=50), boxes).collect()
    assert [(r["rank"], r["id"], r["events"]) for r in sorted((r for r in got if r["zone"] == "a"), key=lambda r: r["rank"])] == [(1, 1, 5), (2, 2, 5), (3, 3, 5)]
    assert [(r["expected"], r["events"], r["id"]) for r in got if r["zone"] == "empty"] == [(0.0, 0, None)]
    none = zones.forecast(zones.contributions(spark.createDataFrame([], EVENT), boxes, 0.0, 7.0, LAW, n=50), boxes).collect()
    assert [r["expected"] for r in none] == [0.0, 0.0]


# Alarms

ROW = "user_id long, ts timestamp, event_id long, trigger boolean"
T0 = datetime(2024, 1, 1)


def expected_alarms(rows, hours, delay):
    """Closed alarms of the rows in order of time, those that end no later than the last watermark."""
    last = max(r[1] for r in rows) - delay
    out, by = [], defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for user, mine in by.items():
        now = ended = None
        for _, ts, event, trigger in sorted(mine, key=lambda r: (r[1], r[2])):
            if now and ts > now[1]:
                out.append((user, *now))
                ended, now = now[1], None
            if trigger and now:
                now[1], now[2] = ts + timedelta(hours=hours), now[2] + 1
            elif trigger:
                now = [ts, ts + timedelta(hours=hours), 1, 0, ended and ts - ended]
            elif now:
                now[3] += 1
        if now:
            out.append((user, *now))
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return sorted((u, micros(a), micros(b), n, m, q and q // timedelta(microseconds=1)) for u, a, b, n, m, q in out if b <= last)


def test_alarms_of_shuffled_rows_in_many_batches(spark, tmp_path):
    """Rows come up to six hours late, in twelve batches; the alarms are those of the ordered rows."""
    rows = [(i * 7 % 3, T0 + timedelta(hours=(i * 37) % 400, minutes=i % 4 * 15, microseconds=i % 3), i, i % 5 == 0) for i in range(300)]
    rows += [(1, T0 + timedelta(hours=30), 1000 + i, i == 2) for i in range(4)]  # ties
    for k, at in enumerate(range(0, 420, 35)):
        some = [r for r in rows if at <= (r[1] - T0) / timedelta(hours=1) + r[2] % 2 * 5 < at + 35]  # odd ids come five hours early
        spark.createDataFrame(some, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
        for f in (tmp_path / "in" / f"{k:03}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k * 60, 1_700_000_000 + k * 60))
    rest = [r for r in rows if (r[1] - T0) / timedelta(hours=1) + r[2] % 2 * 5 >= 420]
    assert not rest
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = counterparts.replay(alarms.alarms(stream, 9, "6 hours"), timers=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected_alarms(rows, 9, timedelta(hours=6)), key=str)


def test_alarms_of_odd_rows(spark, tmp_path):
    h = lambda n: T0 + timedelta(hours=n)
    rows = [(None, h(1), 1, True), (None, h(2), 2, None), (5, None, 3, True), (5, h(3), None, True), (6, h(50), 4, False), (7, h(2), 5, True), (7, h(5), 6, False), (7, h(6), 7, False)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
    got = counterparts.replay(alarms.alarms(stream, 3, "6 hours"), timers=True).collect()
    assert {(r["user_id"], r["triggers"], r["events"], r["quiet"]) for r in got} == {(None, 1, 1, None), (7, 1, 1, None)}  # a row at the very end falls into it


class CountedState:
    """The state of one group and its timers, without a store: calls are counted."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def handle(self):
        def variable(name, _):
            def call(f):
                def run(*a):
                    self.calls += 1
                    return f(*a)

                return run

            kept = self.kept
            of = {"exists": lambda: name in kept, "clear": lambda: kept.pop(name, None), "update": lambda v: kept.update({name: v}), "put": lambda v: kept.update({name: list(v)}), "appendValue": lambda v: kept.setdefault(name, []).append(v), "appendList": lambda v: kept.setdefault(name, []).extend(v)}
            of["get"] = lambda: iter(kept[name]) if isinstance(kept[name], list) else kept[name]
            return SimpleNamespace(**{k: call(f) for k, f in of.items()})

        return SimpleNamespace(getListState=variable, getValueState=variable, registerTimer=self.timers.add)


def test_alarms_of_many_keys_call_for_state_once_a_group(spark):
    """Three batches of 400 keys in one group: the calls for state don't grow with the keys, and no key sees another's rows."""
    null = 999  # stands for it in what is expected
    rows = [(null if u == 7 else u - 200, T0 + timedelta(hours=(u * 13 + i * 29) % 200), 10 * u + i, (u + i) % 3 == 0) for u in range(400) for i in range(9)]
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    state, got = CountedState(), []
    machine = alarms.Alarms(9 * 3_600_000_000)
    machine.init(state.handle())
    for a, b in ((0, 90), (90, 150), (150, 200)):
        some = [(int(u == null), u % null if u == null else u, micros(t), i, int(x)) for u, t, i, x in rows if a <= (t - T0) / timedelta(hours=1) < b]
        frames = [pd.DataFrame(some[k::2], columns=["unnamed", "user", "t", "id", "trigger"]) for k in range(2)]
        list(machine.handleInputRows((3,), iter(frames), None))
        seen = micros(max(t for _, t, _, _ in rows if t < T0 + timedelta(hours=b)) - timedelta(hours=6)) // 1000
        due = sorted(t for t in state.timers if t <= seen)
        state.timers -= set(due)
        for _ in due:
            for frame in machine.handleExpiredTimer((3,), SimpleNamespace(getCurrentWatermarkInMs=lambda s=seen: s), None):
                got += [(null if u is pd.NA else u, *(None if v is pd.NA else v for v in r)) for u, *r in frame.astype(object).itertuples(index=False)]
    assert sorted(got, key=str) == sorted(expected_alarms(rows, 9, timedelta(hours=6)), key=str)
    assert state.calls < 60


# Polled streams


def test_a_failed_batch_reads_the_same_periods_again(spark, tmp_path):
    path, out = f"{tmp_path}/days", f"{tmp_path}/out"
    df = spark.range(100).select("id", F.concat(F.lit("row "), "id").alias("name"), (F.col("id") % 5).alias("day"))
    polled.add_periods(df.where("day < 3"), path, "day")
    seen = defaultdict(list)
    failing = [True]

    def put(batch, epoch):
        seen[epoch].append(sorted(r["id"] for r in batch.select("id").collect()))
        if failing[0]:
            failing[0] = False
            raise ValueError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    def run():
        q = polled.poll(spark, path, "id long, name string, day long", "day").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    polled.add_periods(df.where("day >= 3"), path, "day")  # what came after the failure isn't mixed into the batch
    run()
    run()
    first = min(seen)
    assert len(seen[first]) == 2 and seen[first][0] == seen[first][1] == [i for i in range(100) if i % 5 < 3]
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    assert {(r["id"] % 5 == r["day"], r["name"] == f"row {r['id']}") for r in got.collect()} == {(True, True)}


def test_unfinished_periods_wait_and_nothing_overtakes_them(spark, tmp_path):
    df = spark.range(6).select("id", F.col("id").alias("day"))
    polled.add_periods(df, f"{tmp_path}/days", "day")
    (tmp_path / "days" / "day=3" / polled.DONE).unlink()
    reader = polled.PolledReader({"path": f"{tmp_path}/days", "period": "day", "mostperiods": "2"}, None)
    at = reader.latestOffset()
    assert at == {"after": 1} and reader.latestOffset() == {"after": 2} and reader.latestOffset() == {"after": 2}
    assert [p.number for p in reader.partitions({"after": None}, at)] == [0, 1]
    assert polled.PolledReader({"path": f"{tmp_path}/none", "period": "day"}, None).latestOffset() == {"after": None}


# Table functions


def test_records_over_lines(spark):
    tables.register(spark)
    lines = ["before", "# one", "a 1.5", None, "  b 2.5", "# two", "x y", "#three", "7"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)] + [("g", 0, "# alone")] + [("h", 0, "none")], "file string, i int, value string")
    got = spark.sql("SELECT * FROM multiline_records(TABLE(SELECT * FROM {df}) PARTITION BY (file) ORDER BY (i), '#')", df=df).collect()
    assert {tuple(r) for r in got} == {("f", 0, "one", 2, 4.0), ("f", 1, "two", 1, None), ("f", 2, "three", 1, 7.0), ("g", 0, "alone", 0, None)}


def test_quiet_runs_with_nulls(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, 5), (1, 1), (1, 30), (1, None), (None, 2), (1, 5)], "key long, at long")
    got = spark.sql("SELECT * FROM quiet_runs(TABLE(SELECT * FROM {df}) PARTITION BY (key) ORDER BY (at), 10)", df=df).collect()
    assert {tuple(r) for r in got} == {(1, 1, 5, 3), (1, 30, 30, 1), (None, 2, 2, 1)}


def test_known_days_of_the_julian_calendar(spark):
    known = [(-4712, 1, 1.5, 0.0), (333, 1, 27.5, 1842713.0), (1582, 10, 4.0, 2299159.5), (-1000, 7, 12.5, 1356001.0), (837, 4, 10.3, 2026871.8)]
    df = spark.createDataFrame(known, "y int, m int, d double, jd double")
    assert df.where(F.abs(calendar.day_from_date(F.col("y"), F.col("m"), F.col("d"), julian=True) - F.col("jd")) > 1e-6).count() == 0


# Sequential records


def test_records_of_any_length_in_parts(spark, tmp_path):
    """Records longer than a part are cut, with negative markers where a part follows or precedes."""
    rows = [("a", 2, [1.0, 2.0, 3.0, 4.0, 5.0]), ("a", 1, []), ("b", 7, [0.5])]
    df = spark.createDataFrame(rows, "file string, day long, v array<double>")
    fortran.write_records(df, f"{tmp_path}/out", "file", ["day"], "day:i4 v:f8*", most=16)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    raw = (tmp_path / "out" / "a").read_bytes()
    assert struct.unpack("<iii", raw[:12]) == (4, 1, 4) and struct.unpack("<i", raw[12:16]) == (-16,) and struct.unpack("<ii", raw[32:40]) == (16, -16)
    got = fortran.read_records(spark, f"{tmp_path}/out", "day:i4 v:f8*")
    assert sorted((r["file"], r["record"], r["day"], r["v"]) for r in got.collect()) == [("a", 0, 1, []), ("a", 1, 2, [1.0, 2.0, 3.0, 4.0, 5.0]), ("b", 0, 7, [0.5])]


def test_records_of_one_length_are_read_in_slabs(spark, tmp_path):
    body = b"".join(struct.pack(">iiif", 8, i, i * i, 0.0)[:12] + struct.pack(">i", 8) for i in range(100))
    (tmp_path / "x").write_bytes(body)
    (tmp_path / "empty").write_bytes(b"")
    df = fortran.read_records(spark, str(tmp_path), "i:i4 j:i4", order=">", fixed=True, slab_bytes=160)
    assert df.rdd.getNumPartitions() == 10
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(i, i, i * i) for i in range(100)]


@pytest.mark.parametrize("raw", [struct.pack("<iid", 8, 0, 1.0)[:10], struct.pack("<iii", 4, 7, 5), struct.pack("<iii", -4, 7, 4)])
def test_broken_records_are_refused(spark, tmp_path, raw):
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(PySparkException):
        fortran.read_records(spark, str(tmp_path), "i:i4").collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "file string, i long")
    with pytest.raises(PySparkException):
        fortran.write_records(df, f"{tmp_path}/out", "file", ["i"], "i:i4")
    assert not list((tmp_path / "out").iterdir())
