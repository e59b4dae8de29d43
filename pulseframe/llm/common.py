"""What the operators share: written intermediate tables and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.shipping import ship

#: Rows up to which a table of keys is broadcast (16 MB at eight longs a row); beyond it, joins shuffle.
BROADCAST_KEYS = 250_000
#: Bytes of a batch that goes to a Python worker: without a bound, 10,000 texts lie in the executor's JVM, in buffers that double as they grow, and once more in its worker.
WORKER_BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        named = tempfile.mkdtemp(prefix="pulseframe-")
        sc.setCheckpointDir(named)
    return named


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in a batch for Python workers to WORKER_BATCH_BYTES; a lower one stays. Rows, and their order, are the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < most <= WORKER_BATCH_BYTES:
        spark.conf.set(key, f"{WORKER_BATCH_BYTES}b")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and survive a lost executor."""

    #: All that were made and not swept away.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    @classmethod
    def sweep(cls, since: int = 0) -> None:
        """Delete the tables of all that were made since; only when no result that reads them is needed any more."""
        while len(cls.made) > since:
            cls.made.pop().drop()

    def save(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        """tidy: let the driver collect garbage, so that shuffle files of the written plan and earlier ones go."""
        path, schema = f"{self.root}/{name}", df.schema
        df.write.parquet(path)
        if tidy:
            del df
            gc.collect()
            self.spark._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all. Shuffle files of plans that nothing refers to any more go with it."""
        self.spark._jvm.System.gc()
        drop_path(self.spark, f"{self.root}/{name}".rstrip("/"))


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, in any case; what it adds takes their place."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in gone])


def semi_by_key(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join; broadcasts the keys only when their counted number is within BROADCAST_KEYS."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between longs, by alternating large and small stars.

    Returns (id, component): every linked id with the smallest id that it reaches. Ids without links
    don't appear. A round holds as many rows as there are links; minima are aggregated, never lists.
    """
    scratch = Scratch(spark, "components")
    pair = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = links.where(F.col(a) != F.col(b)).select(pair(F.col(a), F.col(b)).alias("p")).select("p.u", "p.v").distinct()
    e, n, before = scratch.save(e, "0"), 0, None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(pair(F.col("v"), F.col("m")), pair(F.col("u"), F.col("m")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        n += 1
        e = scratch.save(small, str(n))
        if n % 4 == 0:
            scratch.drop(str(n - 1))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def by_bytes(batch: pa.RecordBatch, column: int, size: int, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose cells of a binary column come to `size` bytes at most; a longer cell stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for k, n in enumerate(lengths):
        if k > begin and (total + n > size or k - begin == rows):
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if len(lengths) > begin:
        yield batch.slice(begin)
