"""Aggregations that the tests of association need."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.functions.circular import direction
from pulseframe.shipping import ship

from .ranking import row_number, running_before


def schuster(angle: Column) -> dict[str, Column]:
    """Count, mean resultant length, p = exp(-R^2 / n) and mean direction of angles in degrees, as aggregates."""
    s, c, n = F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))), F.count(angle)
    r = F.sqrt(s * s + c * c)
    return {"n": n, "resultant": r / n, "p": F.exp(-r * r / n), "direction": direction(s, c)}


def v_stat(angle: Column, towards: float) -> Column:
    return F.avg(F.cos(F.radians(angle - towards)))


def b_value(mag: Column, cutoff: float, step: float, least: int) -> Column:
    return F.when(F.count(mag) >= least, math.log10(math.e) / (F.avg(mag) - (cutoff - step / 2)))


def rank_auc(df: DataFrame, score: str, y: str, tie: str, averaged: bool = False) -> DataFrame:
    """Area under the ROC curve from ranks; ties by `tie`, or averaged."""
    if averaged:
        g = df.groupBy(score).agg(F.count("*").alias("c"), F.sum(F.col(y)).alias("p"))
        g = running_before(g, F.col("c"), [score], "before").withColumn("r", F.col("before") + (F.col("c") + 1) / 2)
        agg = g.agg(F.sum(F.col("r") * F.col("p")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("c") - F.col("p")).alias("nn"))
    else:
        r = row_number(df, [score, tie], "r")
        agg = r.agg(F.sum(F.col("r") * F.col(y)).cast("double").alias("s"), F.sum(y).alias("np"), F.sum(1 - F.col(y)).alias("nn"))
    return agg.select(((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))


def log_gain(y: Column, p: Column, base: Column, eps: float = 1e-12) -> Column:
    """Mean gain of log likelihood over the base rate, in nats."""
    clip = lambda x: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x))
    ll = lambda q: F.when(y == 1, F.log(clip(q))).otherwise(F.log(1 - clip(q)))
    return F.avg(ll(p) - ll(base))


def contrast(value: Column, case: Column) -> Column:
    return F.avg(F.when(case, value)) - F.avg(F.when(~case, value))


def rate_ratio(high: Column, y: Column) -> Column:
    return F.avg(F.when(high, y)) / F.avg(F.when(~high, y))


def p_plain(stat: str, observed: str) -> Column:
    return F.avg((F.col(stat) >= F.col(observed)).cast("double"))


def p_add_one(stat: str, observed: str) -> Column:
    return (F.count_if(F.col(stat) >= F.col(observed)) + 1) / (F.count("*") + 1)


def studentise(null: DataFrame, stat: str, by: str) -> Column:
    w = W.partitionBy(by)
    return F.abs(F.col(stat) - F.avg(stat).over(w)) / F.stddev_pop(stat).over(w)


def conformal_quantile(score: str, group: list[str], alpha: float, df: DataFrame) -> DataFrame:
    """(group, q): the k-th smallest score, k = ceil((n + 1)(1 - alpha)) held to 1 .. n."""
    w = W.partitionBy(*group)
    k = F.least(F.greatest(F.ceil((F.count("*").over(w) + 1) * (1 - alpha)), F.lit(1)), F.count("*").over(w))
    ranked = df.withColumn("_k", k).withColumn("_i", F.row_number().over(w.orderBy(score)))
    return ranked.where("_i = _k").select(*group, F.col(score).alias("q"))


def normal_cdf(z: Column) -> Column:
    """By the rational approximation 7.1.26 of Abramowitz and Stegun for erf, within 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * e)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), summed in logarithms over the terms that a double can hold."""
    if k <= 0 or k > n or not 0 < p < 1:
        return float(k <= 0 or (k <= n and p >= 1))
    reach = int(40 * math.sqrt(n * p * (1 - p))) + 40
    first = max(k, int(n * p) - reach)
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(first, min(n, max(k, int(n * p)) + reach) + 1)))


def with_binomial_tail(df: DataFrame, k: Column, n: Column, p: Column, name: str) -> DataFrame:
    """df with binomial_tail as a column; for grouped rows, as it takes about sqrt(n) steps each. Null if an argument is."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(ks: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(ks, ns, ps, strict=True)], dtype="float64")

    return df.withColumn(name, run(k, n, p))


def ks_uniform(df: DataFrame, value: str) -> DataFrame:
    """Greatest gap between the empirical distribution and the uniform one."""
    total = df.agg(F.count("*").alias("_n"))
    i, n = F.col("_i"), F.col("_n")
    ranked = row_number(df, [value], "_i").crossJoin(F.broadcast(total))  # one row
    return ranked.select(F.greatest(i / n - F.col(value), F.col(value) - (i - 1) / n).alias("d")).agg(F.max("d").alias("ks"))
