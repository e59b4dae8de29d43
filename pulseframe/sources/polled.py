"""A stream that polls a folder to which whole periods are added, as a catalogue that is fetched day by day.

A period is a subfolder `name=number` of Parquet files, and counts once it holds a file `_DONE`, whose bytes nobody reads.
Offsets are the last period of a batch, so that a batch that runs again after a failure reads the same periods; each period is one
partition, which executors read a row group at a time. A period added with a number at or below one that was read isn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from pulseframe.shipping import ship
from pulseframe.sources.grids import store

DONE = "_DONE"


class Period(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.period, self.most = options["path"].rstrip("/"), options["period"], int(options.get("mostperiods", "0"))
        self.schema, self.at = schema, None

    def initialOffset(self) -> dict:
        return {"after": None}

    def latestOffset(self) -> dict:
        """The last whole period; with mostPeriods, of as many after the last answer."""
        here = self._periods(self.at, None)
        if here:
            self.at = here[self.most - 1] if 0 < self.most < len(here) else here[-1]
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[Period]:
        self.at = end["after"] if self.at is None else self.at  # after a restart
        return [Period(n) for n in self._periods(start["after"], end["after"])]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Period) -> Iterator[pa.RecordBatch]:
        fs, root = store(self.path)
        schema = to_arrow_schema(self.schema)
        for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{self.period}={partition.number}")), key=lambda f: f.path):
            if f.base_name[0] in "._" or f.type != pafs.FileType.File:
                continue
            with fs.open_input_file(f.path) as raw:
                for batch in pq.ParquetFile(raw).iter_batches(65536, columns=[n for n in schema.names if n != self.period]):
                    columns = [pa.array([partition.number] * len(batch), pa.int64()) if n == self.period else batch.column(n).cast(schema.field(n).type) for n in schema.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def _periods(self, after: int | None, last: int | None) -> list[int]:
        """Whole periods in (after, last], in order."""
        fs, root = store(self.path)
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.Directory and f.base_name.startswith(f"{self.period}=")]
        numbers = sorted(int(n.split("=", 1)[1]) for n in names if n.split("=", 1)[1].lstrip("-").isdigit())
        asked = [n for n in numbers if (after is None or n > after) and (last is None or n <= last)]
        whole = fs.get_file_info([f"{root}/{self.period}={n}/{DONE}" for n in asked]) if asked else []
        closed = [f.type == pafs.FileType.File for f in whole]
        if last is None and False in closed:  # nothing overtakes a period that is still written
            asked, closed = asked[: closed.index(False)], closed[: closed.index(False)]
        return [n for n, ok in zip(asked, closed, strict=True) if ok]


class PolledSource(DataSource):
    """Options path, period (the name in `name=number`), mostPeriods in one batch (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "polled_periods"

    def streamReader(self, schema) -> PolledReader:
        return PolledReader(dict(self.options), schema)


def poll(spark: SparkSession, path: str, schema: str, period: str, most: int = 0) -> DataFrame:
    """A stream of the rows in the periods of a folder; `schema` may name the period's own column, a long."""
    ship(spark)
    spark.dataSource.register(PolledSource)
    return spark.readStream.format("polled_periods").schema(schema).options(path=path, period=period, mostPeriods=most).load()


def add_periods(df: DataFrame, path: str, period: str) -> None:
    """Writes rows as periods and then declares these whole."""
    df.where(F.col(period).isNotNull()).repartition(period).write.mode("append").partitionBy(period).parquet(path)
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(jvm(path)):
        if s.isDirectory() and s.getPath().getName().startswith(f"{period}="):
            fs.create(jvm(s.getPath(), DONE), True).close()
