"""Text formats whose records span lines: ionosphere maps, tide grids and phase records. A file is read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.circular import separation

# The angles of the named phases.
PHASE_ANGLE = {"New Moon": 0.0, "First Quarter": 90.0, "Full Moon": 180.0, "Third Quarter": 270.0}
NAMES = "|".join(PHASE_ANGLE)
STAMP = r"(-?\d{4}-\d{2}-\d{2}),\s*(\d{2}:\d{2}:\d{2})"
EVENT = rf"^{STAMP},\s*M\s*(\d+\.\d+)\s+(.+?)\s*$"
PHASE = rf"({NAMES})(?:\s*\(([^)]*eclipse)\))?:\s*{STAMP}"
OFFSET = rf"~\s*(\d+\.\d+)\s+days\s+(before|after)\s+({NAMES})"
DISTANCE = r"Moon distance:\s*(\d+\.\d+)\s*km"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def ionex_cells(files: DataFrame, nlon: int) -> DataFrame:
    """(file, map, row, col, tec) of the maps before the first RMS map: integers of five characters in tenths, 9999 missing (null)."""
    body = F.element_at(F.split(F.get(F.split("value", "END OF HEADER[^\n]*\n"), F.lit(1)), "START OF RMS MAP"), 1)
    maps = files.select("file", F.posexplode(F.split(body, "START OF TEC MAP")).alias("map", "m")).where("map > 0")
    maps = maps.withColumn("m", F.element_at(F.split("m", "END OF TEC MAP"), 1))
    rows = maps.select("file", "map", F.posexplode(F.split("m", "LAT/LON1/LON2/DLON/H[^\n]*\n")).alias("row", "r")).where("row > 0")
    lines = F.split("r", "\n")
    lines = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))  # the last one is the head of the next row
    v = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.rtrim(x), F.lit("(.{5})"), F.lit(1))))
    cells = rows.select("file", "map", (F.col("row") - 1).alias("row"), F.slice(v, 1, nlon).alias("v")).where(F.size("v") == nlon)
    cells = cells.select("file", "map", "row", F.posexplode("v").alias("col", "x"))
    x = F.trim("x").try_cast("int")
    return cells.select("file", "map", "row", "col", F.when(x != 9999, x / 10).alias("tec"))


def ionex_daily(files: DataFrame, nlon: int, missing: str = "skip") -> DataFrame:
    """(file, row, col, tec): the mean of each cell over a file's maps that hold any value; missing values are skipped, or count as zero."""
    cells = ionex_cells(files, nlon)
    maps = cells.where("tec is not null").groupBy("file").agg(F.count_distinct("map").alias("maps"))
    live = cells.join(cells.where("tec is not null").select("file", "map").distinct(), ["file", "map"])
    sums = live.groupBy("file", "row", "col").agg(F.sum("tec").alias("s"), F.count("tec").alias("n"))
    if missing == "zero":
        return sums.join(maps, "file").select("file", "row", "col", (F.coalesce("s", F.lit(0.0)) / F.col("maps")).alias("tec"))
    return sums.where("n > 0").select("file", "row", "col", (F.col("s") / F.col("n")).alias("tec"))


FORMAT = r"^\s*\(\s*\d+F"


def grid_text(cells: DataFrame, key: str, nlat: int, nlon: int, undefined: float = 999.0, lat: tuple[float, float] = (-90.0, 90.0), lon: tuple[float, float] = (0.0, 359.5)) -> DataFrame:
    """(key, value): a text with an amplitude and a phase block of (key, i, j, amp, phase); each block has five lines before its numbers, ten numbers a line."""
    every = cells.select(key).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nlat - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nlon - 1))))
    full = every.join(cells, [key, "i", "j"], "left")
    at = F.col("i") * nlon + F.col("j")
    shown = lambda c: F.format_string("%8.2f", F.coalesce(c, F.lit(undefined)).cast("double"))
    lines = full.groupBy(key, F.floor(at / 10).alias("line")).agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), shown(F.col(c)).alias("x")))), lambda s: s["x"]), "").alias(c) for c in ("amp", "phase")])
    block = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", c))), lambda s: s[c]), "\n")
    head = "\n".join(["{title}", f"{nlat:12d}{nlon:12d}", f"{lat[0]:12.4f}{lat[1]:12.4f}", f"{lon[0]:12.4f}{lon[1]:12.4f}", f"{undefined:12.2f}{undefined:12.2f}", "(10F8.2)"])
    return lines.groupBy(key).agg(F.concat(F.lit(head.format(title="amplitude (cm)") + "\n"), block("amp"), F.lit("\n" + head.format(title="phase lag (deg)") + "\n"), block("phase"), F.lit("\n")).alias("value"))


def read_grid(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, i, j, lat, lon, re, im) in metres of texts with two blocks; nodes that are undefined in either are left out, as are texts without two blocks."""
    lines = files.select(key, F.split("value", "\r?\n").alias("l"))
    starts = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(FORMAT), i)), lambda i: i.isNotNull())
    two = lines.withColumn("s", starts).where(F.size("s") == 2)
    a, g = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    head = lambda back, k: F.get(F.split(F.trim(F.get("l", a - back)), r"\s+"), F.lit(k)).try_cast("double")
    numbers = lambda start, end: F.transform(F.filter(F.split(F.array_join(F.slice("l", start + 2, end - start - 1), " "), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    named = two.select(key, head(4, 0).cast("int").alias("nlat"), head(4, 1).cast("int").alias("nlon"), *[head(b, k).alias(f"{c}{k}") for b, c in ((3, "lat"), (2, "lon")) for k in (0, 1)], head(1, 0).alias("undef"), numbers(a, g - 5).alias("amp"), numbers(g, F.size("l")).alias("phase"))
    cells = named.select(key, "nlat", "nlon", "lat0", "lat1", "lon0", "lon1", "undef", F.posexplode(F.arrays_zip("amp", "phase")).alias("at", "v")).where(F.col("at") < F.col("nlat") * F.col("nlon"))
    cells = cells.withColumns({"i": F.floor(F.col("at") / F.col("nlon")).cast("int"), "j": (F.col("at") % F.col("nlon")).cast("int")})
    wet = cells.where((F.col("v.amp") < F.col("undef") - 1) & (F.col("v.phase") < F.col("undef") - 1))
    along = lambda c, i, n: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col(i) / (F.col(n) - 1)
    angle = F.radians("v.phase")
    return wet.select(key, "i", "j", along("lat", "i", "nlat").alias("lat"), along("lon", "j", "nlon").alias("lon"), (F.col("v.amp") / 100 * F.cos(angle)).alias("re"), (-F.col("v.amp") / 100 * F.sin(angle)).alias("im"))


def _stamp(day: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat(day, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def phase_events(files: DataFrame) -> DataFrame:
    """(file, line, ts, mag, place, phases, offsets, moon_km): records of a line that names an event and the lines below it, up to a blank one.

    Records with fewer than two phases or offsets, or without the Moon's distance, are dropped; the first two of each are kept.
    """
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    w = W.partitionBy("file").orderBy("line")
    head = F.col("text").rlike(EVENT)
    lines = lines.withColumn("record", F.sum(head.cast("int")).over(w)).where("record > 0")
    r = W.partitionBy("file", "record").orderBy("line")
    open_ = lines.withColumn("blanks", F.sum((F.col("text") == "").cast("int")).over(r)).where("blanks = 0")
    blob = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " ")
    rec = open_.groupBy("file", "record").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("head"), blob.alias("blob"))
    part = lambda s, pattern, k: F.regexp_extract(s, pattern, k)
    phases = F.transform(F.regexp_extract_all("blob", F.lit(f"({PHASE})"), F.lit(1)), lambda s: F.struct(part(s, PHASE, 1).alias("name"), _stamp(part(s, PHASE, 3), part(s, PHASE, 4)).alias("ts"), F.nullif(part(s, PHASE, 2), F.lit("")).alias("eclipse")))
    offsets = F.transform(F.regexp_extract_all("blob", F.lit(f"({OFFSET})"), F.lit(1)), lambda s: F.struct(part(s, OFFSET, 1).try_cast("double").alias("days"), part(s, OFFSET, 2).alias("dir"), part(s, OFFSET, 3).alias("name")))
    out = rec.select("file", (F.col("line") + 1).alias("line"), _stamp(part(F.col("head"), EVENT, 1), part(F.col("head"), EVENT, 2)).alias("ts"), part(F.col("head"), EVENT, 3).try_cast("double").alias("mag"), part(F.col("head"), EVENT, 4).alias("place"), F.slice(phases, 1, 2).alias("phases"), F.slice(offsets, 1, 2).alias("offsets"), part(F.col("blob"), DISTANCE, 1).try_cast("double").alias("moon_km"))
    return out.where((F.size("phases") == 2) & (F.size("offsets") == 2) & F.col("moon_km").isNotNull())


def _days(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", b, a) / 86400


def phase_properties(events: DataFrame) -> DataFrame:
    """Adds nearest_days, nearest_phase, syzygy, eclipse, offset_error in days and phase_angle, bracketed by the two phases, to phase_events."""
    near = F.array_min(F.transform("offsets", lambda o, i: F.struct(o["days"].alias("days"), i.alias("i"), o["name"].alias("name"))))
    named = events.withColumn("_n", near)
    own = F.filter("phases", lambda p: p["name"] == F.col("_n.name"))
    signed = lambda o: F.when(o["dir"] == "after", o["days"]).otherwise(-o["days"])
    misses = F.flatten(F.transform("offsets", lambda o: F.transform(F.filter("phases", lambda p: p["name"] == o["name"]), lambda p: F.abs(_days(F.col("ts"), p["ts"]) - signed(o)))))
    two = F.array_sort(F.transform("phases", lambda p: F.struct(p["ts"].alias("ts"), p["name"].alias("name"))))
    angle = lambda name: F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in PHASE_ANGLE.items()])
    a, b = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    share = _days(F.col("ts"), a["ts"]) / F.nullif(_days(b["ts"], a["ts"]), F.lit(0.0))
    bracket = F.pmod(angle(a["name"]) + share * F.pmod(angle(b["name"]) - angle(a["name"]), F.lit(360.0)), F.lit(360.0))
    out = named.withColumn("_two", two)
    return out.withColumns({"nearest_days": F.col("_n.days"), "nearest_phase": F.col("_n.name"), "syzygy": F.col("_n.name").isin("New Moon", "Full Moon"), "eclipse": F.get(own, F.lit(0))["eclipse"], "offset_error": F.coalesce(F.array_max(misses), F.lit(0.0)), "phase_angle": bracket}).drop("_n", "_two")


def cell_index(value: Column, axis: list[float], around: float | None = None) -> Column:
    """The index of the nearest of the nodes of an axis, the first on a tie; around: the length of a circle."""
    gap = (lambda a: F.abs(value - a)) if around is None else (lambda a: separation(value * (360 / around), F.lit(a * 360 / around)))
    return F.array_min(F.array(*[F.struct(gap(a).alias("gap"), F.lit(i).alias("i")) for i, a in enumerate(axis)]))["i"]
