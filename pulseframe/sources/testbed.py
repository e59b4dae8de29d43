"""The engine's inputs, derived from tables of events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.calendar import epoch_day, slot
from pulseframe.operators import quantiles

#: Hours from 1970 to the first event.
HOUR0 = 473352


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hour, lat, lon, mag, kind): users are places, values magnitudes."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (slot("ts", 1) - HOUR0).cast("int").alias("hour"),
        (F.pmod(F.col("user_id") * 37, F.lit(121)) - 60).cast("double").alias("lat"),
        (F.pmod(F.col("user_id") * 53, F.lit(360)) - 180).cast("double").alias("lon"),
        (4 + F.log(1 + F.col("value")) / F.log(F.lit(10.0))).alias("mag"),
        F.col("event_type").alias("kind"),
    )


def large(spark: SparkSession, sf_dir: str, q: float) -> DataFrame:
    """Events at or above a quantile of magnitude."""
    c = catalog(spark, sf_dir)
    cut = quantiles.one(c, "mag", q)
    return c.where(F.col("mag") >= F.lit(cut))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dd, cnt, mx): orders by epoch day."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(epoch_day(F.col("o_orderdate")).alias("dd")).agg(F.count("*").alias("cnt"), F.max("o_totalprice").alias("mx"))


def indicator(spark: SparkSession, sf_dir: str, q: float = 0.7) -> DataFrame:
    """(dd, cnt, mx, y): y marks days whose largest order reaches the quantile."""
    d = daily(spark, sf_dir)
    return d.crossJoin(F.broadcast(d.agg(F.percentile("mx", F.lit(q)).alias("cut")))).withColumn("y", (F.col("mx") >= F.col("cut")).cast("int")).drop("cut")  # one row


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dd, family, variable, value): forcing series in long form."""
    i = read(spark, sf_dir, "lineitem").groupBy(epoch_day(F.col("l_shipdate")).alias("dd")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"))
    i = i.withColumn("season", F.sin(F.radians(F.col("dd") * 360 / 365.25)))
    families = [("pricing", "price"), ("pricing", "discount"), ("volume", "quantity"), ("calendar", "season")]
    return i.select("dd", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("variable"), F.round(v, 9).alias("value")) for f, v in families])))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dd, cell, value): a sparse gridded field."""
    i = read(spark, sf_dir, "lineitem")
    return i.groupBy(epoch_day(F.col("l_shipdate")).alias("dd"), (F.col("l_suppkey") % 20).cast("int").alias("cell")).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))
