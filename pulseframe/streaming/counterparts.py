"""Tumbling, sliding and stateful operators over event streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import shared_folder
from pulseframe.shipping import ship
from pulseframe.sources.files import latest, upsert


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stream that replays a table's files; a single file replays through its folder and name."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    stamp = [F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields]
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    is_dir = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm(path)).isDirectory()
    reader = spark.readStream.schema(schema)
    return (reader.parquet(path) if is_dir else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)).select(*stamp)


def tumbling(events: DataFrame, length: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length)).agg(F.max("value").alias("top"), F.count("*").alias("n"))


def sliding(events: DataFrame, length: str, step: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length, step)).agg(F.max("value").alias("top"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def triggered(a: DataFrame, b: DataFrame, hours: int) -> DataFrame:
    """Events of b within hours after an event of a for the same user: an inner join with watermarks on both sides."""
    x = a.withWatermark("ts", "1 hour").select(F.col("user_id"), F.col("ts").alias("t1"), F.col("event_id").alias("cause"))
    y = b.withWatermark("ts", "1 hour").select(F.col("user_id").alias("u2"), F.col("ts").alias("t2"), F.col("event_id").alias("effect"))
    return x.join(y, (F.col("user_id") == F.col("u2")) & (F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {hours} hours"))).select("user_id", "cause", "effect")


def thin_by_user(events: DataFrame, hours: int) -> DataFrame:
    """Keeps an event if it is more than `hours` after the user's last kept one; the state is one time a user."""
    ship(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for ts, event in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["event_id"], strict=True):
            if last is None or ts - last > hours * 3_600_000_000:
                kept.append(event)
                last = int(ts)
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "event_id": kept}).astype("int64")

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long", "last long", "append", "NoTimeout")


#: The state store that keeps timers and lists.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(stream: DataFrame, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over all its source has, and gives what it wrote.

    Each batch overwrites a folder of its own beside the checkpoint, so that a batch that runs again changes
    nothing; in complete mode the last batch is the result. With timers, the query's state is kept in the store that has them.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    done: dict[int, str] = {}

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch-{epoch}")
        done[epoch] = f"{root}/batch-{epoch}"

    before = spark.conf.get(STORE)
    if timers:
        spark.conf.set(STORE, ROCKS)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(STORE, before)  # a query keeps what it was started with
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    paths = [done[max(done)]] if mode == "complete" else list(done.values())
    return spark.read.schema(stream.schema).parquet(*paths)


def live_index(stream: DataFrame, days: int, decay: float) -> DataFrame:
    """(day, n, rate) of every day with events: sums over the days up to it, the rate falling with age.

    A batch adds its own days' counts to a table, one folder a batch, so that a batch that runs again replaces its
    own; days are exploded over the history ahead of them, so that the last join is on equality. Late events count where they belong.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))
        batch.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v")).write.mode("overwrite").parquet(f"{root}/sums/batch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    sums = spark.read.parquet(f"{root}/sums").groupBy("day").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    ahead = sums.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("day", F.col("day") + F.col("age"))
    met = ahead.join(sums.select("day"), "day")
    return met.groupBy("day").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.exp(-F.col("age") / F.lit(float(decay)))).alias("rate"))


def upserted(stream: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version, from a stream: every batch is upserted into a table of snapshots."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        upsert(spark, f"{root}/table", batch, key, version)

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = latest(spark, f"{root}/table")
    return spark.createDataFrame([], stream.schema) if out is None else out
