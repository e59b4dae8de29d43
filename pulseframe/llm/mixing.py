"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w of the total and n rows gets the mean repetition rate  w * size / n. Each document
takes a number in [0, 1) from a hash of the seed, its id and its text, and the inverse of the Poisson
distribution of its source's mean says how often it appears. Copies are dealt out by a hash of their own
and sorted by it within partitions, which is a global shuffle. A large mean is split into equal parts of MOST at most: the
sum of Poisson numbers with these means, each from a hash of its own, is a Poisson number with the whole mean.

Defined results: a null source is a source; a null text hashes as empty; repeated rows draw alike, since
hashes decide; sources without a weight don't appear, nor do weights without rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, without

#: Terms of the inverse beyond the mean: the tail left is below 1e-12 for the mean 1, and less for larger ones.
TERMS, PER_ROOT = 16, 12
#: The largest mean whose distribution is tabulated; tables have some 900 numbers at most.
MOST = 500.0


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from a hash of the parts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """array<double>: P(count <= k) for k from 0 on, far into the tail. Sums logarithms, so that a large mean doesn't underflow."""
    top = (F.ceil(mean) + TERMS + F.ceil(F.sqrt(mean) * PER_ROOT)).cast("int")
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(0.0).alias("sum"), F.expr("cast(array() as array<double>)").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        logs = acc["logs"] + F.when(k > 0, F.log(mean) - F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = acc["sum"] + F.exp(logs - mean)
        return F.struct(logs.alias("logs"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(0), top), start, step, lambda acc: acc["cdf"])


def tempered_weights(counts: DataFrame, source_col: str, alpha: float) -> DataFrame:
    """(source, n, weight): weights in proportion to n to the power alpha."""
    total = counts.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(alpha))).alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(source_col, "n", (F.pow(F.col("n").cast("double"), F.lit(alpha)) / F.col("t")).alias("weight"))  # one row


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with copy_no (from 1), n_copies and mix_key; epochs times as many rows as docs are expected.

    weights: shares by source, scaled to 1; without them, counts to the power alpha.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_copies", "copy_no", "mix_key")
    scratch = Scratch(spark, "mixing")
    counts = scratch.save(docs.groupBy(source_col).agg(F.count("*").alias("n")), "counts")
    if weights is None:
        rated = tempered_weights(counts, source_col, alpha)
    else:
        kind = docs.schema[source_col].dataType.simpleString()
        given = spark.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], f"`{source_col}` {kind}, weight double")
        rated = counts.join(given, counts[source_col].eqNullSafe(given[source_col])).select(counts[source_col], "n", "weight")
    size = counts.agg(F.sum("n").alias("size"))
    means = rated.crossJoin(F.broadcast(size)).select(F.col(source_col).alias("__pf_src"), (F.col("weight") * epochs * F.col("size") / F.col("n")).alias("mean"))  # one row
    parts = F.greatest(F.ceil(F.col("mean") / MOST), F.lit(1)).cast("int")
    rates = scratch.save(means.select("__pf_src", parts.alias("__pf_parts"), poisson_cdf(F.col("mean") / parts).alias("__pf_cdf")), "rates")
    if rates.select("__pf_src").limit(BROADCAST_KEYS // 100).count() < BROADCAST_KEYS // 100:
        rates = F.broadcast(rates)
    own = [F.lit(str(seed)), id_col, F.md5(F.coalesce(F.col(text_col), F.lit("")))]
    drawn = docs.withColumn("__pf_u", unit(*own)).withColumn("__pf_own", F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in own]))
    inverse = lambda u: F.size(F.filter("__pf_cdf", lambda c: c <= u)).cast("long")
    more = F.aggregate(F.sequence(F.lit(2), F.col("__pf_parts")), inverse(F.col("__pf_u")), lambda acc, i: acc + inverse(unit(F.col("__pf_own"), i.cast("string"))))
    n_copies = F.when(F.col("__pf_parts") > 1, more).otherwise(inverse(F.col("__pf_u")))
    counted = drawn.join(rates, drawn[source_col].eqNullSafe(rates["__pf_src"])).withColumn("n_copies", n_copies)
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col("__pf_u"), F.col("copy_no"))).drop("__pf_u", "__pf_own", "__pf_parts", "__pf_cdf", "__pf_src")
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")
