"""Unformatted sequential records: a source and a sink of binary records with their length before and behind them.

A layout names a record's fields and their numbers, as "day:i4 level:f8 value:f4*"; the last may be an array of what is left,
marked by a star. Records longer than a marker can count are cut into parts, whose markers are negative where another part
follows or precedes. A partition is a file, or, where all records are declared to be of one length, a slab of a file; files are
streamed a record at a time. The sink takes rows in order of file and record, and moves files into place when all tasks are done.

Defined results: an empty file has no records, an empty record none of its array's numbers; a file that ends within a record or
whose two markers differ is refused, with its name and place; nulls are refused when written.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from pulseframe.shipping import ship
from pulseframe.sources.grids import Written, _files, store

#: Bytes in a part of a record at most, in a slab about, and in a batch of rows about.
MOST, SLAB, BATCH = (1 << 31) - 9, 64 << 20, 8 << 20


class Layout:
    """Fields of a record: their names, types, and whether the last is an array."""

    def __init__(self, text: str, order: str):
        pairs = [f.split(":") for f in text.split()]
        self.names, codes = [n for n, _ in pairs], [c for _, c in pairs]
        self.array = codes[-1].endswith("*")
        if any(c.rstrip("*")[:1] not in "if" or c.endswith("*") for c in codes[:-1]) or codes[-1][:1] not in "if":
            raise ValueError(f"not a layout: {text}")
        self.kinds = [np.dtype(order + c.rstrip("*")) for c in codes]
        self.head = sum(k.itemsize for k in (self.kinds[:-1] if self.array else self.kinds))

    def sql(self) -> str:
        of = ["bigint" if k.kind == "i" else "double" for k in self.kinds]
        if self.array:
            of[-1] = f"array<{of[-1]}>"
        return ", ".join(f"`{n}` {t}" for n, t in zip(self.names, of, strict=True))

    def values(self, raw: bytes) -> list:
        out, at = [], 0
        for k in self.kinds[:-1] if self.array else self.kinds:
            out.append(np.frombuffer(raw, k, 1, at)[0].item())
            at += k.itemsize
        if self.array:
            out.append(np.frombuffer(raw, self.kinds[-1], -1, at).astype("i8" if self.kinds[-1].kind == "i" else "f8") if at < len(raw) else np.zeros(0))
        elif at != len(raw):
            raise ValueError(f"a record of {len(raw)} bytes for a layout of {at}")
        return out

    def raw(self, values: list) -> bytes:
        if any(v is None for v in values) or (self.array and any(x is None for x in values[-1])):
            raise ValueError("records can't hold nulls")
        parts = [np.asarray(v, k).tobytes() for v, k in zip(values, self.kinds, strict=True)]
        return b"".join(parts)


class Part(InputPartition):
    """`count` records of a file from one on, or all up to its end."""

    def __init__(self, path: str, first: int, at: int, end: int):
        super().__init__(None)
        self.path, self.first, self.at, self.end = path, first, at, end


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.order = options, options.get("order", "<")
        self.layout = Layout(options["layout"], self.order)

    def partitions(self) -> list[Part]:
        fs, _ = store(self.options["path"])
        out = []
        for path, size in _files(self.options["path"]):
            step = 0
            if self.options.get("fixed", "false") == "true" and size >= 4:
                with fs.open_input_file(path) as f:
                    step = struct.unpack(self.order + "i", f.read(4))[0] + 8
                if step < 8 or size % step:
                    raise ValueError(f"{path}: its records aren't of one length")
            slab = max(1, int(self.options.get("slab_bytes", SLAB)) // step) * step if step else max(size, 1)
            out += [Part(path, at // step if step else 0, at, min(at + slab, size)) for at in range(0, size, slab)]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = store(self.options["path"])
        name, rows, held = part.path.rsplit("/", 1)[-1], [], 0
        with fs.open_input_file(part.path) as f:
            f.seek(part.at)
            for i, raw in enumerate(self._records(pa.BufferedInputStream(f, 1 << 20), part)):
                rows.append([name, part.first + i, *self.layout.values(raw)])
                held += len(raw)
                if held >= BATCH or len(rows) >= 65536:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _records(self, f, part: Part) -> Iterator[bytes]:
        at, parts = part.at, []

        def take(n: int) -> bytes:
            raw = f.read(n)
            if len(raw) != n:
                raise ValueError(f"{part.path} ends within a record at byte {at}")
            return raw

        while at < part.end:
            size = struct.unpack(self.order + "i", take(4))[0]
            raw = take(abs(size))
            behind = struct.unpack(self.order + "i", take(4))[0]
            if abs(behind) != abs(size) or (behind < 0) != bool(parts):
                raise ValueError(f"{part.path}: the markers around byte {at} differ")
            at += abs(size) + 8
            parts.append(raw)
            if size >= 0:
                yield parts[0] if len(parts) == 1 else b"".join(parts)
                parts = []
        if parts:
            raise ValueError(f"{part.path} ends within a record at byte {at}")

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64() if k.kind == "i" else pa.float64() for k in self.layout.kinds]
        if self.layout.array:
            kinds[-1] = pa.list_(kinds[-1])
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), *(pa.array(c, k) for c, k in zip(columns[2:], kinds, strict=True))], names=["file", "record", *self.layout.names])


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.order, self.file = options["path"].rstrip("/"), options.get("order", "<"), options["file"]
        self.layout, self.most = Layout(options["layout"], self.order), int(options.get("most", MOST))
        self.staged = f"{self.root}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, staged = store(self.staged)
        fs.create_dir(staged, recursive=True)
        files, out = [], None
        try:
            for batch in batches:
                for name, *values in zip(*(batch.column(c).to_pylist() for c in (self.file, *self.layout.names)), strict=True):
                    if not files or files[-1][1] != name:
                        if out:
                            out.close()
                        files.append((f"{staged}/{uuid.uuid4().hex}", name))
                        out = fs.open_output_stream(files[-1][0])
                    self._put(out, self.layout.raw(values))
        finally:
            if out:
                out.close()
        return Written(files)

    def _put(self, out, raw: bytes) -> None:
        for at in range(0, max(len(raw), 1), self.most):
            some = raw[at : at + self.most]
            mark = lambda beyond: struct.pack(self.order + "i", -len(some) if beyond else len(some))  # noqa: B023, E731
            out.write(mark(at + self.most < len(raw)) + some + mark(at > 0))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.root)
        for path, name in (x for m in messages if m for x in m.files):
            fs.move(path, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staged = store(self.staged)
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_dir(staged)


class RecordSource(DataSource):
    """Options path, layout; order (< or >), fixed (records of one length), slab_bytes; for the sink file and most."""

    @classmethod
    def name(cls) -> str:
        return "sequential_records"

    def schema(self) -> str:
        return f"file string, record bigint, {Layout(self.options['layout'], '<').sql()}"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options))


def read_records(spark: SparkSession, path: str, layout: str, order: str = "<", fixed: bool = False, slab_bytes: int = SLAB) -> DataFrame:
    """(file, record, a column for each field) of a file or of all files in a folder; records are numbered from 0."""
    ship(spark)
    spark.dataSource.register(RecordSource)
    return spark.read.format("sequential_records").options(path=path, layout=layout, order=order, fixed=str(fixed).lower(), slab_bytes=slab_bytes).load()


def write_records(df: DataFrame, path: str, file: str, by: list[str], layout: str, order: str = "<", most: int = MOST) -> None:
    """One file for each value of `file`, a record a row in the order of `by`."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(RecordSource)
    names = Layout(layout, order).names
    rows = df.where(F.col(file).isNotNull()).withColumn(file, F.col(file).cast("string")).repartition(file).sortWithinPartitions(file, *by)
    rows.select(file, *[c for c in names if c != file]).write.format("sequential_records").options(path=path, file=file, layout=layout, order=order, most=most).mode("append").save()
