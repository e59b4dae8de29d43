"""Finding, fetching and keeping files: a locator, partitioned fetches, arrays, and sinks that check before they publish."""

from __future__ import annotations

import hashlib
import io
import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulseframe.shipping import ship


def locate(spark: SparkSession, root: str, name: str) -> str:
    """The first path under root, in order, whose last part is name; else where it would stand in root."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(path(root)):
        files = fs.listFiles(path(root), True)
        while files.hasNext():
            p = files.next().getPath()
            if p.getName() == name:
                found.append(p.toString())
    return min(found) if found else f"{root.rstrip('/')}/{name}"


class Period(InputPartition):
    def __init__(self, start: str, end: str):
        super().__init__(None)
        self.start, self.end = start, end


class PeriodReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Period]:
        """One for each year or day from start to before end."""
        at, end = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        out = []
        while at < end:
            nxt = date(at.year + 1, 1, 1) if self.options.get("step", "year") == "year" else at + timedelta(days=1)
            out.append(Period(at.isoformat(), min(nxt, end).isoformat()))
            at = nxt
        return out

    def read(self, partition: Period) -> Iterator[tuple]:
        """The lines at the template's address; a period that isn't there has none. A failed task is tried again by Spark."""
        where = self.options["template"].format(start=partition.start, end=partition.end, year=partition.start[:4])
        try:
            with urllib.request.urlopen(where, timeout=float(self.options.get("timeout", "60"))) as f:
                for i, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
                    yield partition.start, i, line.rstrip("\r\n")
        except FileNotFoundError:
            return
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
        except urllib.error.URLError as e:
            if not isinstance(e.reason, FileNotFoundError):
                raise


class PeriodSource(DataSource):
    """Lines fetched one address a year or day: options template (with {start}, {end}, {year}), start, end, step."""

    @classmethod
    def name(cls) -> str:
        return "periods"

    def schema(self) -> str:
        return "period string, line int, value string"

    def reader(self, schema) -> PeriodReader:
        return PeriodReader(self.options)


def fetch_periods(spark: SparkSession, template: str, start: str, end: str, step: str = "year") -> DataFrame:
    """(period, line, value)."""
    ship(spark)
    spark.dataSource.register(PeriodSource)
    return spark.read.format("periods").options(template=template, start=start, end=end, step=step).load()


def fetch_ranges(open_range: Callable[[int, int], bytes], size: int, path: str, chunk: int = 8 << 20) -> int:
    """Completes a file by byte ranges, from where an earlier attempt ended; gives the bytes that were fetched."""
    have = os.path.getsize(path) if os.path.exists(path) else 0
    if have > size:
        raise ValueError(f"{path} is longer than its source")
    fetched = 0
    with open(path, "ab") as f:
        while have < size:
            part = open_range(have, min(have + chunk, size))
            if not part:
                raise OSError(f"no bytes from {have}")
            f.write(part)
            have, fetched = have + len(part), fetched + len(part)
    return fetched


# How files of the classic and the hierarchical gridded formats begin.
MAGIC = (b"CDF\x01", b"CDF\x02", b"\x89HDF")


def with_magic(files: DataFrame, magic: tuple[bytes, ...] = MAGIC) -> DataFrame:
    """The rows (path, content) whose content begins as one of these; what a server says in place of a file goes."""
    starts = F.lit(False)
    for m in magic:
        starts = starts | (F.substring("content", 1, len(m)) == F.lit(m))
    return files.where(starts)


def npy(files: DataFrame) -> DataFrame:
    """(path, i, j, value) of rows (path, content) that hold arrays of one or two dimensions; j is 0 in the first case."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                for at in range(0, len(a), 65536):
                    some = a[at : at + 65536]
                    i, j = np.indices(some.shape)
                    yield pd.DataFrame({"path": path, "i": i.ravel() + at, "j": j.ravel(), "value": some.ravel().astype(float)})

    return files.select("path", "content").mapInPandas(run, "path string, i long, j long, value double")


def at_cells(field: DataFrame, events: DataFrame, cell: Column, name: str = "cell") -> DataFrame:
    """The rows of a gridded field in the cells that hold an event."""
    return field.join(events.select(cell.alias(name)).distinct(), name, "left_semi")


def region_catalogues(events: DataFrame, regions: DataFrame) -> DataFrame:
    """events (lat, lon, mag, ..) by the regions (region, lat0, lat1, lon0, lon1, minmag) that hold them; an event may be in several."""
    inside = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1")) & (F.col("mag") >= F.col("minmag"))
    return events.join(F.broadcast(regions), inside).drop("lat0", "lat1", "lon0", "lon1", "minmag")  # a table of parameters


# Sinks


def report(df: DataFrame, widths: dict[str, str], order: list[str]) -> DataFrame:
    """(value): a line of text for each row, columns by printf formats, in order."""
    return df.orderBy(*order).select(F.concat_ws(" ", *[F.format_string(f, F.col(c)) for c, f in widths.items()]).alias("value"))


def cached(spark: SparkSession, root: str, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives, kept under a path that names the parameters; a table that was written whole is read again."""
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    if not jvm(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def csv_cached(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
    """As cached(), in CSV with a header."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    if not jvm(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").csv(path, header=True)
    return spark.read.schema(schema).csv(path, header=True)


def write_json_if(df: DataFrame, path: str, agrees: Callable[[DataFrame], bool]) -> None:
    """JSON lines, only if the check of what would be written holds."""
    if not agrees(df):
        raise ValueError("the bundle failed its check and isn't written")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_years(df: DataFrame, path: str, year: str = "year") -> None:
    """One folder a year; only the years in df are replaced."""
    df.repartition(year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], version: str) -> None:
    """Adds rows to a versioned table: of each key the largest version counts, so that rows that come twice change nothing.

    A new snapshot is written beside the old ones under its own number, and readers take the last whole one; nothing is deleted before.
    """
    old = latest(spark, path)
    both = rows if old is None else old.unionByName(rows)
    best = both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(version, F.xxhash64(*both.columns))).alias("r")).select("r.*")
    best.write.parquet(f"{path.rstrip('/')}/snapshot={_last(spark, path) + 1}")


def _last(spark: SparkSession, path: str) -> int:
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm(path)):
        return -1
    names = [s.getPath() for s in fs.listStatus(jvm(path))]
    return max([int(p.getName().split("=")[1]) for p in names if "=" in p.getName() and fs.exists(jvm(p, "_SUCCESS"))], default=-1)


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole snapshot."""
    n = _last(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/snapshot={n}") if n >= 0 else None


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> None:
    """Writes a snapshot, reads it back, and makes it the last only if the check holds; else it goes and the table stays as it was."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    stage = f"{path.rstrip('/')}/staged-{_last(spark, path) + 1}"
    df.write.mode("overwrite").parquet(stage)
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not check(spark.read.parquet(stage)):
        fs.delete(jvm(stage), True)
        raise ValueError("the staged table failed its check")
    fs.rename(jvm(stage), jvm(f"{path.rstrip('/')}/snapshot={_last(spark, path) + 1}"))
