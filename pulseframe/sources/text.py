"""Text sources. Every field is read as a string and tried; a row with a field that fails is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.geo import magnitude_from_moment


def _required(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def fixed(lines: DataFrame, col: str, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Fields by (first character from 1, width, type)."""
    out = lines.select(*[F.trim(F.substring(col, a, n)).try_cast(t).alias(k) for k, (a, n, t) in fields.items()])
    return _required(out, list(fields))


def whitespace(lines: DataFrame, col: str, fields: dict[str, tuple[int, str]], comment: str = "#") -> DataFrame:
    """Fields by (position from 0, type); comments, blank and short lines are skipped."""
    kept = lines.where((F.trim(col) != "") & ~F.startswith(F.ltrim(F.col(col)), F.lit(comment)))
    parts = F.split(F.trim(col), r"\s+")
    out = kept.select(*[F.get(parts, F.lit(i)).try_cast(t).alias(k) for k, (i, t) in fields.items()])
    return _required(out, list(fields))


def read_whitespace(spark: SparkSession, path: str, fields: dict[str, tuple[int, str]]) -> DataFrame:
    return whitespace(spark.read.text(path), "value", fields)


def quakes_csv(spark: SparkSession, path: str, minmag: float, maxdepth: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(ts, mag, lat, lon, depth, place) of earthquakes in a CSV with a header; box: least and greatest latitude and longitude."""
    names = ["time", "latitude", "longitude", "depth", "mag", "type", "place"]
    raw = spark.read.csv(path, header=True, quote='"', inferSchema=False, enforceSchema=False)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names])
    ts = F.try_to_timestamp(F.substring("time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    d = lambda c: F.col(c).try_cast("double")
    out = raw.where(F.coalesce("type", F.lit("earthquake")) == "earthquake").select(ts.alias("ts"), d("mag").alias("mag"), d("latitude").alias("lat"), d("longitude").alias("lon"), d("depth").alias("depth"), "place")
    out = _required(out, ["ts", "mag", "lat", "lon", "depth"]).where((F.col("mag") >= minmag) & (F.col("depth") <= maxdepth))
    return out.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])) if box else out


def ndk(spark: SparkSession, path: str) -> DataFrame:
    """Moment tensors in records of five lines: (ts, lat, lon, depth, mw, plane1, plane2, region).

    Records are found by their third line, so that one that lacks a line spoils none of the others. Files are read whole, since lines of a record must stay together; a file is one catalogue's month or era.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    third = F.filter(F.transform("lines", lambda x, i: F.when(F.startswith(x, F.lit("CENTROID")) & (i >= 2) & (i + 2 < F.size("lines")), i)), lambda i: i.isNotNull())
    rec = whole.select("file", F.explode(F.transform(third, lambda i: F.slice("lines", i - 1, 5))).alias("r"))
    line = lambda i: F.get("r", F.lit(i))
    c = F.split(F.trim(F.replace(line(2), F.lit("CENTROID:"), F.lit(" "))), r"\s+")
    p = F.split(F.trim(F.substring(line(4), 4, 200)), r"\s+")
    num = lambda a, i: F.get(a, F.lit(i)).try_cast("double")
    origin = F.try_to_timestamp(F.concat(F.trim(F.substring(line(0), 6, 10)), F.lit(" "), F.trim(F.substring(line(0), 17, 8))), F.lit("yyyy/MM/dd HH:mm:ss"))
    ts = F.timestamp_micros(F.unix_micros(origin) + F.round(num(c, 0) * 1_000_000).cast("long")).cast("timestamp_ntz")
    exponent = F.substring(line(3), 1, 2).try_cast("int")
    mw = magnitude_from_moment(num(p, 9) * F.pow(F.lit(10.0), exponent.cast("double")))
    plane = lambda i: F.struct(num(p, i).alias("strike"), num(p, i + 1).alias("dip"), num(p, i + 2).alias("rake"))
    out = rec.where(num(p, 9) > 0).select(ts.alias("ts"), num(c, 2).alias("lat"), num(c, 4).alias("lon"), num(c, 6).alias("depth"), mw.alias("mw"), plane(10).alias("plane1"), plane(13).alias("plane2"), F.trim(F.substring(line(0), 57, 100)).alias("region"))
    return _required(out, ["ts", "lat", "lon", "depth", "mw"])


def fault_plane(which: str = "shallow") -> Column:
    """plane1, plane2, or the one that dips less."""
    if which in ("plane1", "plane2"):
        return F.col(which)
    return F.when(F.col("plane1.dip") <= F.col("plane2.dip"), F.col("plane1")).otherwise(F.col("plane2"))


def tide_grid(amplitude: DataFrame, phase: DataFrame, undefined: float) -> DataFrame:
    """(i, j, re, im) in metres of grids (i, j, v) of centimetres and degrees; nodes undefined in either are left out."""
    a = amplitude.where(F.col("v") != undefined).select("i", "j", (F.col("v") / 100).alias("a"))
    g = phase.where(F.col("v") != undefined).select("i", "j", F.radians("v").alias("g"))
    return a.join(g, ["i", "j"]).select("i", "j", (F.col("a") * F.cos("g")).alias("re"), (-F.col("a") * F.sin("g")).alias("im"))


def bilinear(points: DataFrame, grid: DataFrame, dx: float) -> DataFrame:
    """(id, re, im): the four nodes around each point (id, x, y), weights scaled to those that exist; none gives no row."""
    fx, fy = F.col("x") / dx - F.floor(F.col("x") / dx), F.col("y") / dx - F.floor(F.col("y") / dx)
    corner = lambda di, dj: F.struct((F.floor(F.col("y") / dx) + di).cast("int").alias("i"), (F.floor(F.col("x") / dx) + dj).cast("int").alias("j"), ((fy if di else 1 - fy) * (fx if dj else 1 - fx)).alias("w"))
    four = points.select("id", F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    met = four.join(grid, ["i", "j"]).where("w > 0")
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col("re")) / F.sum("w")).alias("re"), (F.sum(F.col("w") * F.col("im")) / F.sum("w")).alias("im"))
