"""Does a bank of forcing series modulate an indicator? Binned once, scored by one statistic, corrected by one null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.rng import stream, uniform
from pulseframe.operators import binning, nulls
from pulseframe.session import cut
from pulseframe.sources.testbed import bank, indicator

SHIFT_SEED = 20260819
FAMILIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_family(name: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    """build(spark, dir) gives (dd, variable, value)."""
    FAMILIES[name] = build


def registered_bank(spark: SparkSession, path: str) -> DataFrame:
    out = bank(spark, path)
    for name, build in FAMILIES.items():
        out = out.unionByName(build(spark, path).select("dd", F.lit(name).alias("family"), "variable", "value"))
    return out


def joined_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered_bank(spark, sf_dir).join(indicator(spark, sf_dir).select("dd", "y"), "dd")


def binned_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dd, family, variable, value, y, pos, bin)."""
    b = binning.assign(joined_bank(spark, sf_dir), "value", ["variable"])
    return b.withColumn("pos", F.row_number().over(W.partitionBy("variable").orderBy("dd")) - 1)


def positions(binned: DataFrame) -> int:
    return binned.agg(F.max("pos")).first()[0] + 1


def shift_table(spark: SparkSession, n: int, replicates: int = 400, seed: int = SHIFT_SEED) -> DataFrame:
    """(replicate, shift): shifts of 1 .. n - 1 from the portable generator."""
    draws = spark.range(1).select(F.posexplode(stream(seed, replicates)).alias("i", "x"))
    return draws.select((F.col("i") + 1).alias("replicate"), (1 + F.floor(uniform(F.col("x")) * (n - 1))).cast("long").alias("shift"))


def modulation_test(spark: SparkSession, sf_dir: str, replicates: int = 400) -> DataFrame:
    """(family, variable, stat, p, family_p): the statistic of each variable, its own p and its family's, by maxima over replicates."""
    b = cut(binned_bank(spark, sf_dir))
    n = positions(b)
    keys = ["family", "variable"]
    obs = binning.max_deviation(binning.rates(b, "y", keys), keys)
    nul = nulls.shifted_statistic(b, b.where("y = 1").select("pos").distinct(), shift_table(spark, n, replicates), n, keys).withColumnRenamed("stat", "null_stat")
    each = nul.join(obs, keys).groupBy(*keys).agg(F.max("stat").alias("stat"), ((F.count_if(F.col("null_stat") >= F.col("stat")) + 1) / (F.count("*") + 1)).alias("p"))
    top = nul.groupBy("family", "replicate").agg(F.max("null_stat").alias("m")).join(obs.groupBy("family").agg(F.max("stat").alias("o")), "family")
    fam = top.groupBy("family").agg(F.avg((F.col("m") >= F.col("o")).cast("double")).alias("family_p"))
    return each.join(fam, "family").select("family", "variable", F.round("stat", 9).alias("stat"), F.round("p", 9).alias("p"), F.round("family_p", 9).alias("family_p"))
