"""Solar, geomagnetic and rotation series in text. A field that fails to parse, or a sentinel, is null or drops the row, as each says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Markers of gaps.
OMNI_FILL, OMNI2_GAP = 9e4, 999.9


def _parts(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(f array<string>) of the lines with so many fields at least; comments start with #."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= least)


def _num(i: int) -> Column:
    return F.get("f", F.lit(i)).try_cast("double")


def _date(*at: int) -> Column:
    y, m, d = (F.get("f", F.lit(i)) for i in at)
    return F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def sunspot(spark: SparkSession, path: str) -> DataFrame:
    """(day, sunspot): the fifth field; negative numbers mark missing days."""
    out = _parts(spark, path, 5).select(_date(0, 1, 2).alias("day"), _num(4).alias("sunspot"))
    return out.where(F.col("day").isNotNull() & (F.col("sunspot") >= 0))


def f107(spark: SparkSession, path: str) -> DataFrame:
    """(day, flux): dates of eight digits in the first field, the adjusted flux in the sixth."""
    parts = _parts(spark, path, 6).where(F.get("f", F.lit(0)).rlike("^[0-9]{8}$"))
    out = parts.select(F.try_to_timestamp(F.get("f", F.lit(0)), F.lit("yyyyMMdd")).cast("date").alias("day"), _num(5).alias("flux"))
    return out.where(F.col("day").isNotNull() & F.col("flux").isNotNull())


def omni_hourly(spark: SparkSession, path: str, columns: dict[str, str], time_col: str = "Time") -> DataFrame:
    """(ts, columns): a CSV with a header; numbers beyond the fill value, and what isn't a number, are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    v = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    ts = F.try_to_timestamp(F.substring(time_col, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return raw.select(ts.alias("ts"), *[F.when(F.abs(v(c)) <= OMNI_FILL, v(c)).alias(k) for k, c in columns.items()]).where("ts is not null")


def omni2(spark: SparkSession, path: str) -> DataFrame:
    """(ts, density) of all files that the path matches: year, day of the year and hour, and the 24th field; gaps are dropped.

    Only the marker itself is a gap, as the field has room for larger values.
    """
    parts = _parts(spark, path, 24)
    y, doy, hour = (F.get("f", F.lit(i)).try_cast("int") for i in range(3))
    day = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), doy - 1)
    ts = (day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour)).cast("timestamp_ntz")
    out = parts.where(y.isNotNull() & doy.isNotNull() & hour.isNotNull()).select(ts.alias("ts"), _num(23).alias("density"))
    return out.where((F.col("density") != OMNI2_GAP) & ~F.isnan("density"))


def earth_rotation(spark: SparkSession, path: str) -> DataFrame:
    """(day, lod_ms, motion): length of day in milliseconds, and the distance of the pole."""
    parts = _parts(spark, path, 13).where(F.get("f", F.lit(0)).rlike("^[0-9]+$"))
    out = parts.select(_date(0, 1, 2).alias("day"), (_num(12) * 1000).alias("lod_ms"), F.hypot(_num(5), _num(6)).alias("motion"))
    return out.where("day is not null and lod_ms is not null and motion is not null")
