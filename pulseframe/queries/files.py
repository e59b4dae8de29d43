"""Sources and sinks: each query writes a text or table made from the test tables to the shared folder, and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.operators import decluster
from pulseframe.session import shared_folder
from pulseframe.sources import files, fortran, grids, records, solar, text
from pulseframe.sources.testbed import catalog, daily, field, indicator, read

from .base import CAT, DAILY, FIELD, IND, query
from .events import GKC, GREEDY, _gk


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark, lines, name: str, parts: int | None = None) -> str:
    """The folder of text that holds a column `value`."""
    path = folder(spark, name)
    (lines.coalesce(parts) if parts else lines).write.text(path)
    return path


def ymd(sep: str, day: Column | None = None) -> Column:
    d = F.date_from_unix_date("dd") if day is None else day
    return F.date_format(d, sep.join(["yyyy", "MM", "dd"]))


@query(f"WITH {DAILY} SELECT dd, cnt::DOUBLE AS sunspot FROM daily WHERE dd % 11 <> 0")
def read_sunspot(spark, sf):
    """Daily numbers in blanks; every eleventh is marked missing."""
    value = F.concat(ymd(" "), F.lit(" 1999.5 "), F.when(F.col("dd") % 11 == 0, "-1").otherwise(F.col("cnt").cast("string")), F.lit(" 0.5"))
    lines = daily(spark, sf).select(value.alias("value"))
    out = solar.sunspot(spark, written(spark, lines.union(spark.createDataFrame([("# a comment",), ("",), ("1999 13 40 0 5",)], "value string")), "sunspot"))
    return out.select(F.unix_date("day").alias("dd"), "sunspot")


@query(f"WITH {DAILY} SELECT dd, cnt * 1.5::DOUBLE AS flux FROM daily WHERE dd % 13 <> 0")
def read_f107(spark, sf):
    """Dates of eight digits; every thirteenth has seven."""
    day = F.when(F.col("dd") % 13 == 0, F.substring(ymd(""), 1, 7)).otherwise(ymd(""))
    value = F.concat_ws(" ", day, F.lit("170000 1 2 3"), (F.col("cnt") * 1.5).cast("string"), F.lit("9"))
    out = solar.f107(spark, written(spark, daily(spark, sf).select(value.alias("value")), "f107"))
    return out.select(F.unix_date("day").alias("dd"), "flux")


HOURS = "h AS (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) AS n, max(value) AS top FROM events GROUP BY 1)"


def hourly(spark, sf):
    from pulseframe.functions.calendar import slot

    return read(spark, sf, "events").groupBy(slot("ts", 1).alias("hour")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def stamp(hour: Column, pattern: str) -> Column:
    return F.date_format(F.timestamp_seconds(hour * 3600), pattern)


@query(f"WITH {HOURS} SELECT hour, n::DOUBLE AS density, CASE WHEN hour % 7 <> 0 THEN top END AS speed, CASE WHEN hour % 5 <> 0 THEN n * 0.5::DOUBLE END AS ram FROM h")
def read_omni(spark, sf):
    """An hourly CSV: fill values and empty fields are null."""
    h = hourly(spark, sf)
    path = folder(spark, "omni")
    h.select(F.concat(stamp(F.col("hour"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")).alias("Time"), F.col("n").alias("omni_sw_n"), F.when(F.col("hour") % 7 == 0, F.lit(99999.9)).otherwise(F.col("top")).alias("omni_sw_v"), F.when(F.col("hour") % 5 != 0, F.col("n") * 0.5).alias("omni_sw_ram")).write.csv(path, header=True)
    out = solar.omni_hourly(spark, path, {"density": "omni_sw_n", "speed": "omni_sw_v", "ram": "omni_sw_ram"})
    return out.select(F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("hour"), "density", "speed", "ram")


@query(f"WITH {HOURS} SELECT hour, n * 0.25::DOUBLE AS density FROM h WHERE hour % 9 <> 0")
def read_omni2(spark, sf):
    """Fixed fields by year, day of the year and hour, over a folder for each part; a marker stands for gaps."""
    h, base = hourly(spark, sf), folder(spark, "omni2")
    fields = F.concat_ws(" ", stamp(F.col("hour"), "yyyy"), stamp(F.col("hour"), "D"), stamp(F.col("hour"), "H"), *[F.lit("0")] * 20, F.when(F.col("hour") % 9 == 0, F.lit("999.9")).otherwise((F.col("n") * 0.25).cast("string")), F.lit("1"))
    h.select(fields.alias("value"), (F.col("hour") % 3).alias("part")).write.partitionBy("part").text(base)
    return solar.omni2(spark, f"{base}/part=*").select(F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("hour"), "density")


@query(f"WITH {DAILY} SELECT dd, round(cnt * 0.01::DOUBLE, 9) AS lod_ms, round(sqrt(pow(cnt / 1000::DOUBLE, 2) + pow((dd % 100) / 1000::DOUBLE, 2)), 9) AS motion FROM daily WHERE dd % 17 <> 0")
def read_earth_rotation(spark, sf):
    """Length of day and the pole; every seventeenth line is cut short."""
    numbers = F.concat_ws(" ", F.lit("50000 0"), F.format_string("%.6f", F.col("cnt") / 1000), F.format_string("%.6f", (F.col("dd") % 100) / 1000))
    value = F.concat(ymd(" "), F.lit(" "), F.substring_index(numbers, " ", 1), F.lit(" 0 "), F.substring_index(numbers, " ", -2), F.when(F.col("dd") % 17 == 0, "").otherwise(F.concat(F.lit(" 0 0 0 0 0 "), F.format_string("%.8f", F.col("cnt") / 100000))))
    out = solar.earth_rotation(spark, written(spark, daily(spark, sf).select(value.alias("value")), "iers"))
    return out.select(F.unix_date("day").alias("dd"), F.round("lod_ms", 9).alias("lod_ms"), F.round("motion", 9).alias("motion"))


PLANES = "((id * 7) % 360)::DOUBLE AS strike, ((id * 3) % 90)::DOUBLE AS dip, ((id * 11) % 360 - 180)::DOUBLE AS rake, ((id * 5) % 360)::DOUBLE AS strike2, ((id * 13) % 90)::DOUBLE AS dip2, ((id * 17) % 360 - 180)::DOUBLE AS rake2"


@query(f"""WITH {CAT}, r AS (SELECT id, lat, lon, (id % 700)::DOUBLE AS depth, 2.0::DOUBLE / 3 * (log10((1 + id % 900 / 100.0::DOUBLE) * pow(10, 22 + id % 6)) - 16.1::DOUBLE) AS mw, {PLANES} FROM cat WHERE id % 17 <> 0)
  SELECT id, lat, lon, depth, round(mw, 6) AS mw, CASE WHEN dip <= dip2 THEN strike ELSE strike2 END AS strike, least(dip, dip2) AS dip,
    CASE WHEN (CASE WHEN dip <= dip2 THEN rake ELSE rake2 END) BETWEEN 45 AND 135 THEN 'thrust' WHEN (CASE WHEN dip <= dip2 THEN rake ELSE rake2 END) BETWEEN -135 AND -45 THEN 'normal' ELSE 'strike-slip' END AS mechanism FROM r""")
def read_moment_tensors(spark, sf):
    """Records of five lines; every seventeenth lacks its fourth. The plane that dips less, and its mechanism."""
    from pulseframe.functions.geo import mechanism

    c, i = catalog(spark, sf), F.col("id")
    at = F.timestamp_seconds(F.col("hour") * 3600 + 473352 * 3600)
    f = lambda fmt, *x: F.format_string(fmt, *x)
    one = F.concat(F.lit("PDEW "), F.date_format(at, "yyyy/MM/dd"), F.lit(" "), F.date_format(at, "HH:mm:ss"), F.lit(".0 "), F.rpad(F.lit("0 0 0 0 0"), 28, " "), F.lit(" "), f("R%d", i))
    three = f("CENTROID:      0.0 0.1 %.2f 0.1 %.2f 0.1 %.1f 0.5 FREE S-1", F.col("lat"), F.col("lon"), (i % 700).cast("double"))
    planes = f("%d %d %d %d %d %d", i * 7 % 360, i * 3 % 90, i * 11 % 360 - 180, i * 5 % 360, i * 13 % 90, i * 17 % 360 - 180)
    four = F.concat((22 + i % 6).cast("string"), F.lit("  1 0 1 0 1 0 1 0 1 0 1 0"))
    five = F.concat(F.lit("V10 1 2 3 4 5 6 7 8 9 "), f("%.2f", 1 + i % 900 / 100), F.lit(" "), planes)
    lines = F.when(i % 17 == 0, F.concat_ws("\n", one, F.lit("B: 1"), five)).otherwise(F.concat_ws("\n", one, F.lit("B: 1"), three, four, five))
    out = text.ndk(spark, written(spark, c.select(lines.alias("value")), "ndk"))
    plane = text.fault_plane("shallow")
    return out.select(F.substring("region", 2, 20).cast("long").alias("id"), "lat", "lon", "depth", F.round("mw", 6).alias("mw"), plane["strike"].alias("strike"), plane["dip"].alias("dip"), mechanism(plane["rake"]).alias("mechanism"))


@query(f"WITH {CAT} SELECT id, round(mag, 2) AS mag, lat, lon FROM cat WHERE id % 10 <> 0 AND round(mag, 2) >= 5 AND id % 100 <= 70 AND lat BETWEEN -30 AND 30 AND lon BETWEEN 0 AND 150")
def read_quake_csv(spark, sf):
    """A catalogue as CSV with quoted places: type, magnitude, depth and a box."""
    c, path = catalog(spark, sf), folder(spark, "quakes")
    time = F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    c.select(time.alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("id") % 100).alias("depth"), F.format_string("%.2f", F.round("mag", 2)).alias("mag"), F.when(F.col("id") % 10 == 0, "quarry blast").otherwise("earthquake").alias("type"), F.concat(F.lit("7 km N, of "), F.col("id").cast("string")).alias("place")).write.csv(path, header=True, quote='"')
    out = text.quakes_csv(spark, path, 5.0, 70.0, (-30.0, 30.0, 0.0, 150.0))
    return out.select(F.regexp_extract("place", "of ([0-9]+)", 1).cast("long").alias("id"), "mag", "lat", "lon")


REGIONS = [("north", 0.0, 60.0, -180.0, 180.0, 6.0), ("south", -60.0, -0.5, -180.0, 180.0, 6.2)]
REGION_SQL = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {m}::DOUBLE)" for r, a, b, c, d, m in REGIONS) + ") AS t(region, lat0, lat1, lon0, lon1, minmag))"


@query(f"""WITH RECURSIVE {GKC.replace('covers AS', 'far AS')}, {REGION_SQL}, own AS (SELECT big.id, big.mag, region FROM big JOIN regions ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1 AND mag >= minmag),
  covers AS (SELECT far.id, far.by_id FROM far JOIN own x ON x.id = far.id JOIN own y ON y.id = far.by_id AND x.region = y.region), ordered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY mag DESC, id) AS i FROM own){GREEDY.replace('SELECT id, list_contains(kept, id) AS kept FROM ordered, last', 'SELECT region, own.id AS id, list_contains(kept, own.id) AS kept FROM own, last')}""")
def region_catalogue(spark, sf):
    """Catalogues by rows of a table of regions, each declustered on its own."""
    b, covers = _gk(spark, sf, 0.9)
    own = files.region_catalogues(b, spark.createDataFrame(REGIONS, "region string, lat0 double, lat1 double, lon0 double, lon1 double, minmag double")).select("id", "region")
    inside = covers.join(own, "id").join(own.select(F.col("id").alias("by"), F.col("region").alias("by_region")), "by").where("region = by_region").select("id", "by")
    return own.join(decluster.resolve(own.select("id"), inside), "id").select("region", "id", "kept")


@query("WITH d AS (SELECT o_orderdate::DATE AS d FROM orders), s AS (SELECT min(d) AS lo, max(d) + 1 AS hi FROM d), p AS (SELECT greatest(make_date(year(d), 1, 1), lo) AS a, least(make_date(year(d) + 1, 1, 1), hi) AS b FROM d, s) SELECT strftime(a, '%Y-%m-%d') AS period, 0 AS line, strftime(a, '%Y-%m-%d') || ',' || strftime(b, '%Y-%m-%d') AS value, count(*) AS n FROM p GROUP BY ALL")
def fetched_periods(spark, sf):
    """A fetch with one partition for each year that orders span, whose address holds what it returns, and the orders that fall into what was fetched."""
    o = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    span = o.agg(F.min("d").alias("lo"), (F.max("d") + F.expr("interval 1 day")).cast("date").alias("hi")).first()
    if span["lo"] is None:
        return spark.createDataFrame([], "period string, line int, value string, n long")
    got = files.fetch_periods(spark, "data:text/plain,{start},{end}", str(span["lo"]), str(span["hi"]))
    counts = o.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))
    return got.withColumn("year", F.substring("value", 1, 4).cast("int")).join(counts, "year").select("period", "line", "value", "n")




def tec_files(spark, sf):
    """(day, text): maps of two rows and three columns; the first map holds a, the second b, missing where the cell is 4."""
    f = field(spark, sf).where("cell < 6").select("dd", "cell", F.rint(F.col("value") / 1000).cast("int").alias("a"), (F.rint(F.col("value") * 7 / 1000).cast("int") % 9000).alias("b"))
    wide = f.groupBy("dd").pivot("cell", list(range(6))).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    cell = lambda k, c: F.format_string("%5d", F.lit(9999) if (c, k) == ("b", 4) else F.coalesce(F.col(f"{k}_{c}"), F.lit(9999)))
    row = lambda r, c: F.concat(F.lit(f"    {r}.5-180.0 180.0   5.0 450.0".ljust(60) + "LAT/LON1/LON2/DLON/H\n"), *[cell(3 * r + k, c) for k in range(3)], F.lit("\n"))
    one = lambda n, c: F.concat(F.lit(f"{n:6d}".ljust(60) + "START OF TEC MAP\n  2000 1 1 0 0 0".ljust(20) + "EPOCH OF CURRENT MAP\n"), row(0, c), row(1, c), F.lit(f"{n:6d}".ljust(60) + "END OF TEC MAP\n"))
    head = F.concat(F.lit("     1.0            IONOSPHERE MAPS     IONEX VERSION / TYPE\n".rjust(10)), F.lit("".ljust(60) + "END OF HEADER\n"))
    return wide.select("dd", F.concat(head, one(1, "a"), one(2, "b"), F.lit("     1".ljust(60) + "START OF RMS MAP\n" + "    9    9    9\n")).alias("value"))


TEC_SQL = FIELD + """, t AS (SELECT dd, cell, round_even(value / 1000, 0)::INTEGER AS a, round_even(value * 7 / 1000, 0)::INTEGER % 9000 AS b FROM field WHERE cell < 6), days AS (SELECT DISTINCT dd FROM t),
  c AS (SELECT unnest(range(0, 6))::INTEGER AS cell), full_ AS (SELECT days.dd, c.cell, t.a, CASE WHEN c.cell <> 4 THEN t.b END AS b FROM days, c LEFT JOIN t ON t.dd = days.dd AND t.cell = c.cell),
  m AS (SELECT dd, max((a IS NOT NULL)::INT) + max((b IS NOT NULL)::INT) AS maps FROM full_ GROUP BY dd)"""


@query(f"WITH {TEC_SQL} SELECT dd, (cell // 3)::INTEGER AS row, (cell % 3)::INTEGER AS col, round((coalesce(a, 0) / 10::DOUBLE + coalesce(b, 0) / 10::DOUBLE) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS mean, round((coalesce(a, 0) / 10::DOUBLE + coalesce(b, 0) / 10::DOUBLE) / maps, 6) AS with_zeros FROM full_ JOIN m USING (dd)")
def read_ionosphere(spark, sf):
    """Daily means of maps of numbers five characters wide, with missing values skipped and counted as zero."""
    t = tec_files(spark, sf).select(F.col("dd").cast("string").alias("file"), "value")
    a, b = (records.ionex_daily(t, 3, m) for m in ("skip", "zero"))
    out = b.withColumnRenamed("tec", "z").join(a, ["file", "row", "col"], "left")
    return out.select(F.col("file").cast("int").alias("dd"), "row", "col", F.round("tec", 6).alias("mean"), F.round("z", 6).alias("with_zeros"))


GRID = FIELD + ", g AS (SELECT (cell % 2)::INTEGER AS k, (dd % 4)::INTEGER AS i, (dd % 7)::INTEGER AS j, round(max(value) / 1000, 2) AS amp, round((min(value)::BIGINT % 36000) / 100::DOUBLE, 2) AS phase FROM field GROUP BY ALL)"


def grid_cells(spark, sf):
    f = field(spark, sf).groupBy((F.col("cell") % 2).alias("k"), (F.col("dd") % 4).alias("i"), (F.col("dd") % 7).alias("j"))
    return f.agg(F.round(F.max("value") / 1000, 2).alias("amp"), F.round(F.rint(F.min("value")).cast("long") % 36000 / 100, 2).alias("phase"))


@query(f"WITH {GRID.replace('min(value)::BIGINT', 'round_even(min(value), 0)::BIGINT')} SELECT k, i, j, round(-90 + 180 * i / 3::DOUBLE, 6) AS lat, round(359.5::DOUBLE * j / 6::DOUBLE, 6) AS lon, round(amp / 100 * cos(radians(phase)), 9) AS re, round(-amp / 100 * sin(radians(phase)), 9) AS im FROM g WHERE amp < 998 AND phase < 998 AND NOT (i = 1 AND j = 2)")
def read_tide_grid(spark, sf):
    """Grids written as blocks of numbers, and read as complex amplitudes; one node is undefined."""
    cells = grid_cells(spark, sf).where("not (i = 1 and j = 2)")
    out = records.read_grid(records.grid_text(cells, "k", 4, 7), "k")
    return out.select("k", "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


@query(f"""WITH {DAILY}, q AS (SELECT dd, dd * 86400 + (cnt * 977) % 86400 AS s, dd * 86400 - (3 + dd % 4) * 86400 AS s0, dd * 86400 + 4 * 86400 AS s1, (dd % 4)::INTEGER AS k FROM daily WHERE dd % 19 <> 0),
  p AS (SELECT *, round((s - s0) / 86400::DOUBLE, 1) AS o0, round((s1 - s) / 86400::DOUBLE, 1) AS o1 FROM q)
  SELECT dd, CASE WHEN o0 <= o1 THEN (['New Moon','First Quarter','Full Moon','Third Quarter'])[k + 1] ELSE (['New Moon','First Quarter','Full Moon','Third Quarter'])[(k + 1) % 4 + 1] END AS nearest_phase, least(o0, o1) AS nearest_days,
    ((CASE WHEN o0 <= o1 THEN k ELSE (k + 1) % 4 END) % 2 = 0) AS syzygy, CASE WHEN o0 <= o1 AND dd % 5 = 0 THEN 'lunar eclipse' END AS eclipse,
    round(greatest(abs((s - s0) / 86400::DOUBLE - o0), abs((s1 - s) / 86400::DOUBLE - o1)), 6) AS offset_error, round((k * 90 + 90 * ((s - s0) / 86400::DOUBLE) / ((s1 - s0) / 86400::DOUBLE)) % 360, 6) AS phase_angle FROM p""")
def read_phase_records(spark, sf):
    """Records over several lines with two phases and two offsets each; every nineteenth lacks an offset."""
    names = F.array(*[F.lit(n) for n in records.PHASE_ANGLE])
    s, dd = F.col("dd").cast("long") * 86400 + (F.col("cnt") * 977) % 86400, F.col("dd").cast("long")
    d = daily(spark, sf).select("dd", s.alias("s"), (dd * 86400 - (3 + dd % 4) * 86400).alias("s0"), (dd * 86400 + 4 * 86400).alias("s1"), (dd % 4).cast("int").alias("k"))
    show = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd, HH:mm:ss")
    name = lambda k: F.get(names, F.lit(0) + k % 4)
    off = lambda c: F.format_string("%.1f", F.round(c / 86400, 1))
    lines = F.concat(
        show(F.col("s")), F.lit(", M 6.5 Place "), F.col("dd").cast("string"), F.lit("\n"),
        name(F.col("k")), F.when(F.col("dd") % 5 == 0, " (lunar eclipse)").otherwise(""), F.lit(": "), show(F.col("s0")), F.lit("\n"), name(F.col("k") + 1), F.lit(": "), show(F.col("s1")), F.lit("\n"),
        F.lit("~ "), off(F.col("s") - F.col("s0")), F.lit(" days after "), name(F.col("k")), F.when(F.col("dd") % 19 == 0, F.lit("\n")).otherwise(F.concat(F.lit(", ~ "), off(F.col("s1") - F.col("s")), F.lit(" days before "), name(F.col("k") + 1), F.lit("\n"))),
        F.lit("Moon distance: 380000.5 km\n\nsome remark between records\n"),
    )
    out = records.phase_properties(records.phase_events(records.whole(spark, written(spark, d.select(lines.alias("value")), "phases"))))
    return out.select(F.regexp_extract("place", "([0-9]+)", 1).cast("int").alias("dd"), "nearest_phase", "nearest_days", "syzygy", "eclipse", F.round("offset_error", 6).alias("offset_error"), F.round("phase_angle", 6).alias("phase_angle"))


@query(f"WITH {FIELD}, ev AS (SELECT DISTINCT (o_custkey % 20)::INTEGER AS cell FROM orders WHERE o_totalprice > 300000) SELECT year(DATE '1970-01-01' + dd)::INTEGER AS year, cell, count(*) AS n, round(sum(value), 4) AS total FROM field SEMI JOIN ev USING (cell) GROUP BY ALL")
def event_cells_by_year(spark, sf):
    """A field at the cells of events only, kept in one folder a year; a year that is written again replaces its own folder."""
    f = files.at_cells(field(spark, sf), read(spark, sf, "orders").where("o_totalprice > 300000"), (F.col("o_custkey") % 20).cast("int"))
    f = f.withColumn("year", F.year(F.date_from_unix_date("dd")))
    path = folder(spark, "cells")
    files.write_years(f, path)
    first = f.agg(F.min("year").alias("y")).first()["y"]
    files.write_years(f.where(F.col("year") == first), path)
    return spark.read.parquet(path).groupBy("year", "cell").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {DAILY} SELECT printf('%6d %8d', dd, cnt) AS value FROM daily")
def text_report(spark, sf):
    path = written(spark, files.report(daily(spark, sf), {"dd": "%6d", "cnt": "%8d"}, ["dd"]), "report")
    return spark.read.text(path)


@query(f"WITH {DAILY} SELECT dd, cnt, mx FROM daily")
def cached_tables(spark, sf):
    """What a build gives, read from the cache the second time; then through CSV."""
    base, calls = folder(spark, "cache"), []

    def build():
        calls.append(1)
        return daily(spark, sf)

    for _ in range(2):
        df = files.cached(spark, base, "daily", {"seed": 1, "q": 0.7}, build)
    if len(calls) != 1:
        raise AssertionError("the cache was not used")
    return files.csv_cached(spark, f"{base}/csv", "dd int, cnt long, mx double", lambda: df)


@query(f"WITH {DAILY} SELECT dd, cnt + (dd % 3 = 0)::INT AS cnt FROM daily")
def published_snapshots(spark, sf):
    """Rows upserted in two goes, the second with later versions of a third of them, and a publication that a failed check stops."""
    path, d = folder(spark, "snapshots"), daily(spark, sf).select("dd", "cnt", F.lit(1).alias("version"))
    later = d.where("dd % 3 = 0").select("dd", (F.col("cnt") + 1).alias("cnt"), F.lit(2).alias("version"))
    for rows in (d, later, later):
        files.upsert(spark, path, rows, ["dd"], "version")
    try:
        files.publish(d.limit(0), path, lambda t: t.count() > 0)
    except ValueError:
        pass
    return files.latest(spark, path).select("dd", "cnt")


@query(f"WITH {IND}, g AS (SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS dd, count(*) AS growth FROM lineitem GROUP BY 1) SELECT ind.dd, y, growth::DOUBLE AS growth FROM ind LEFT JOIN g USING (dd)")
def base_and_growth(spark, sf):
    """The indicator's grid with a growing count beside it, null where that isn't known."""
    from pulseframe.functions.calendar import epoch_day

    g = read(spark, sf, "lineitem").groupBy(epoch_day(F.col("l_shipdate")).alias("dd")).agg(F.count("*").alias("cnt"))
    return indicator(spark, sf).select("dd", "y").join(g.select("dd", F.col("cnt").cast("double").alias("growth")), "dd", "left")


@query(f"WITH {IND}, {DAILY.replace('daily AS', 'd2 AS')} SELECT ind.dd, y, d2.cnt, d2.mx FROM ind JOIN d2 ON ind.dd = d2.dd")
def side_by_side(spark, sf):
    """Blocks of columns side by side, by the row's key."""
    return indicator(spark, sf).select("dd", "y").join(daily(spark, sf).select("dd", "cnt", "mx"), "dd")


@query("WITH u AS (SELECT c_nationkey AS k, c_name AS v, 1 AS turn, c_custkey AS seq FROM customer UNION ALL SELECT s_nationkey, s_name, 2, s_suppkey FROM supplier) SELECT k, arg_max(v, turn * 1000000000::BIGINT + seq) AS v FROM u GROUP BY k")
def later_key_wins(spark, sf):
    """Two tables of one key: rows of the second replace those of the first, later ones earlier ones."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.lit(1).alias("turn"), F.col("c_custkey").alias("at"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"), F.lit(2).alias("turn"), F.col("s_suppkey").alias("at"))
    return c.unionByName(s).groupBy("k").agg(F.max_by("v", F.struct("turn", "at")).alias("v"))


AXIS = [-60.0, -42.5, -30.0, -7.0, 0.0, 11.0, 35.0, 60.0]
MERIDIANS = [0.0, 10.0, 95.0, 200.0, 340.0]


@query(f"""WITH {CAT}, p AS (SELECT DISTINCT lat, lon FROM cat), a AS (SELECT unnest({AXIS}::DOUBLE[]) AS v, unnest(range({len(AXIS)}))::INTEGER AS i), m AS (SELECT unnest({MERIDIANS}::DOUBLE[]) AS v, unnest(range({len(MERIDIANS)}))::INTEGER AS i),
  x AS (SELECT lat, lon, arg_min(i, abs(lat - v) * 1000 + i) AS i FROM p, a GROUP BY ALL), y AS (SELECT lat, lon, arg_min(i, least(((lon - v) % 360 + 360) % 360, 360 - ((lon - v) % 360 + 360) % 360) * 1000 + i) AS j FROM p, m GROUP BY ALL) SELECT lat, lon, i, j FROM x JOIN y USING (lat, lon)""")
def nearest_node(spark, sf):
    """The nearest node of irregular axes, the first on a tie; longitudes go around."""
    p = catalog(spark, sf).select("lat", "lon").distinct()
    return p.select("lat", "lon", records.cell_index(F.col("lat"), AXIS).alias("i"), records.cell_index(F.col("lon"), MERIDIANS, 360.0).alias("j"))


def grid_folder(spark, sf):
    """The field as gridded binary files, one a year: four rows of five cells."""
    f = field(spark, sf).withColumn("year", F.year(F.date_from_unix_date("dd")))
    path = folder(spark, "grids")
    grids.write_grid(f.withColumns({"lat": F.floor(F.col("cell") / 5) * 10.0 - 20, "lon": F.col("cell") % 5 * 72.0}), path, "year", "dd", ["lat", "lon"], "value")
    return path


@query(f"WITH {FIELD} SELECT dd, (cell // 5) * 10 - 20::DOUBLE AS lat, (cell % 5) * 72::DOUBLE AS lon, value FROM field")
def read_classic_grid(spark, sf):
    """Every cell of gridded binary files that holds a value."""
    g = grids.read_grid(spark, grid_folder(spark, sf))
    return g.where("value is not null").select(F.col("dd").cast("int").alias("dd"), "lat", "lon", "value")


@query(f"WITH {FIELD}, e AS (SELECT min(dd) AS lo, max(dd) AS hi FROM field) SELECT dd, count(*) AS n, round(avg(value), 6) AS mean FROM field, e WHERE cell // 5 IN (1, 2) AND dd >= lo + (hi - lo) // 4 AND dd < lo + (hi - lo) // 2 GROUP BY dd")
def grid_window(spark, sf):
    """Daily means over two rows of a grid in a quarter of its time; other files, slabs and rows aren't opened."""
    e = field(spark, sf).agg(F.min("dd").alias("lo"), F.max("dd").alias("hi")).first()
    lo, hi = (e["lo"], e["hi"]) if e["lo"] is not None else (0, 0)
    g = grids.read_grid(spark, grid_folder(spark, sf)).where((F.col("dd") >= float(lo + (hi - lo) // 4)) & (F.col("dd") < float(lo + (hi - lo) // 2)) & F.col("lat").between(-10.0, 0.0))
    return g.where("value is not null").groupBy(F.col("dd").cast("int").alias("dd")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {FIELD}, ev AS (SELECT DISTINCT (o_custkey % 20)::INTEGER AS cell FROM orders WHERE o_totalprice > 300000) SELECT year(DATE '1970-01-01' + dd)::INTEGER AS year, count(*) AS n, count(*) FILTER (abs(value) > 40000) AS beyond, round(avg(value) FILTER (abs(value) <= 40000), 6) AS mean FROM field SEMI JOIN ev USING (cell) GROUP BY ALL")
def grid_at_events(spark, sf):
    """A binary grid at the cells of events, by year; what is too large to be a value counts as missing."""
    g = grids.read_grid(spark, grid_folder(spark, sf), "pressure,value").where("value is not null")
    g = g.withColumn("cell", ((F.col("lat") + 20) / 10 * 5 + F.col("lon") / 72).cast("int"))
    near = files.at_cells(g, read(spark, sf, "orders").where("o_totalprice > 300000"), (F.col("o_custkey") % 20).cast("int"))
    v = F.when(F.abs("value") <= 40000, F.col("value"))
    return near.groupBy(F.year(F.date_from_unix_date(F.col("dd").cast("int"))).alias("year")).agg(F.count("*").alias("n"), F.count_if(F.abs("value") > 40000).alias("beyond"), F.round(F.avg(v), 6).alias("mean"))


@query(f"WITH {FIELD} SELECT 'year-' || year(DATE '1970-01-01' + dd) AS file, dd::BIGINT AS dd, cell, value FROM field")
def sequential_records(spark, sf):
    """A field as unformatted records, a file a year and a record of twenty cells a day, read back in slabs."""
    f = field(spark, sf).groupBy("dd").agg(*[F.max(F.when(F.col("cell") == k, F.col("value"))).alias(f"c{k}") for k in range(20)])
    days = f.select(F.concat(F.lit("year-"), F.year(F.date_from_unix_date("dd")).cast("string")).alias("file"), F.col("dd").cast("long").alias("dd"), F.array(*[F.coalesce(f"c{k}", F.lit(-9999.0)) for k in range(20)]).alias("value"))
    path = folder(spark, "records")
    fortran.write_records(days, path, "file", ["dd"], "dd:i4 value:f8*", order=">")
    back = fortran.read_records(spark, path, "dd:i4 value:f8*", order=">", fixed=True, slab_bytes=20_000)
    return back.select("file", "dd", F.posexplode("value").alias("cell", "value")).where("value > -9999")
