"""Gridded binary files of the classic format (versions 1 and 2), as a data source with pushed-down filters and a sink.

A file's header names its dimensions, their coordinates and where each variable's numbers stand, so that the driver
reads headers only. A partition is a slab of the variable's first dimension; filters on coordinates leave out files,
slabs and rows of the second dimension before they are opened. The sink streams one record at a time, and moves
files into place only when all tasks are done. Paths may be local or of any store that Arrow's file systems know.

Defined results: cells that hold the fill or missing value, or no number, are null; a dimension without coordinates
counts from 0; files without the variable are refused; of rows written for one cell the greatest value stands.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from pulseframe.shipping import ship

# Tags and types of the format, all of which are big-endian, and its default for a missing double.
DIMENSIONS, VARIABLES, ATTRIBUTES, STREAMING = 10, 11, 12, 0xFFFFFFFF
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
FILL = 9.969209968386869e36
UNITS = re.compile(r"(second|minute|hour|day)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})")
A_DAY = {"second": 86400.0, "minute": 1440.0, "hour": 24.0, "day": 1.0}
#: Bytes of a slab, about.
SLAB_BYTES = 32 << 20


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attrs: dict
    kind: str
    size: int
    begin: int


@dataclass
class Header:
    """What a file holds. records: how many there are; stride: bytes from one to the next."""

    dims: list[tuple[str, int]]
    attrs: dict
    variables: dict[str, Variable]
    records: int
    stride: int
    record_dim: int

    def length(self, dim: int) -> int:
        return self.records if dim == self.record_dim else self.dims[dim][1]

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.length(d) for d in v.dims)

    def inner(self, v: Variable) -> int:
        """Numbers of one step of the first dimension."""
        return int(np.prod([self.length(d) for d in v.dims[1:]], dtype=np.int64))

    def step(self, v: Variable) -> int:
        """Bytes from one step of the first dimension to the next."""
        return self.stride if v.dims and v.dims[0] == self.record_dim else self.inner(v) * np.dtype(v.kind).itemsize


def read_header(f, size: int) -> Header:
    """From a file open for reading."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02"):
        raise ValueError("not a file of the classic format")
    wide = magic[3] == 2

    def number(code: str = ">I") -> int:
        return struct.unpack(code, f.read(struct.calcsize(code)))[0]

    def padded(n: int) -> bytes:
        return f.read(n + -n % 4)[:n]

    def listed(tag: int) -> range:
        found, n = number(), number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header is damaged")
        return range(n)

    def name() -> str:
        return padded(number()).decode("utf-8")

    def attributes() -> dict:
        out = {}
        for _ in listed(ATTRIBUTES):
            key, kind, n = name(), TYPES[number()], number()
            raw = padded(n * np.dtype(kind).itemsize)
            out[key] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out

    records = number()
    dims = [(name(), number()) for _ in listed(DIMENSIONS)]
    record_dim = next((i for i, (_, n) in enumerate(dims) if n == 0), -1)
    attrs, variables = attributes(), {}
    for _ in listed(VARIABLES):
        v = Variable(name(), tuple(number() for _ in range(number())), attributes(), TYPES[number()], number(), number(">q" if wide else ">I"))
        variables[v.name] = v
    of_records = [v for v in variables.values() if v.dims and v.dims[0] == record_dim]
    sizes = [int(np.prod([dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize for v in of_records]
    stride = sizes[0] if len(sizes) == 1 else sum(n + -n % 4 for n in sizes)  # a single record variable isn't padded
    if records == STREAMING:
        records = max(0, size - min((v.begin for v in of_records), default=size)) // stride if stride else 0
    return Header(dims, attrs, variables, records, stride, record_dim)


def _numbers(f, h: Header, v: Variable, first: int, count: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Steps first.. of the first dimension, and of each only the numbers low to before high."""
    item, high = np.dtype(v.kind).itemsize, h.inner(v) if high is None else high
    if low == 0 and h.step(v) == high * item:
        f.seek(v.begin + first * h.step(v))
        return np.frombuffer(f.read(count * high * item), v.kind).reshape(count, high)
    out = np.empty((count, high - low), v.kind)
    for k in range(count):
        f.seek(v.begin + (first + k) * h.step(v) + low * item)
        out[k] = np.frombuffer(f.read((high - low) * item), v.kind)
    return out


def _coordinates(f, h: Header, dim: int, days: bool) -> np.ndarray:
    name = h.dims[dim][0]
    v = h.variables.get(name)
    if v is None or v.dims != (dim,):
        return np.arange(h.length(dim))
    x = _numbers(f, h, v, 0, h.length(dim)).ravel().astype(float)
    said = UNITS.match(str(v.attrs.get("units", "")).strip())
    if days and said:
        return x / A_DAY[said[1]] + (date(*map(int, said.groups()[1:])) - date(1970, 1, 1)).days
    return x


def _chosen(h: Header, names: list[str]) -> Variable:
    """The first that is there by name; else the one of most dimensions."""
    for n in names:
        if n in h.variables:
            return h.variables[n]
    rest = [v for v in h.variables.values() if v.dims and v.kind != "S1" and v.name not in dict(h.dims)]
    if names and "" not in names or not rest:
        raise ValueError(f"no variable {', '.join(names)} in the file")
    return max(rest, key=lambda v: len(v.dims))


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at))
    return sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")))


class Slab(InputPartition):
    """Steps of one file's first dimension, and the places kept of the others."""

    def __init__(self, path: str, header: Header, variable: Variable, coordinates: list[np.ndarray], kept: list[np.ndarray]):
        super().__init__(None)
        self.path, self.header, self.variable, self.coordinates, self.kept = path, header, variable, coordinates, kept


class GridReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.names = [n.strip() for n in options.get("variable", "").split(",")]
        self.days, self.slab = options.get("days", "false") == "true", int(options.get("slab_bytes", SLAB_BYTES))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of coordinates choose what is opened; Spark checks all of them again."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and f.attribute[0] in self.columns[1:-1]:
                self.pushed.append(f)
            yield f

    def _kept(self, name: str, x: np.ndarray) -> np.ndarray:
        on = np.ones(len(x), bool)
        for f in self.pushed:
            if f.attribute == (name,):
                if isinstance(f, In):
                    on &= np.isin(x, [v for v in f.value if v is not None])
                elif f.value is None:
                    on[:] = False
                else:
                    on &= {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}[type(f)](x, f.value)
        return np.flatnonzero(on)

    def partitions(self) -> list[Slab]:
        out = []
        fs, _ = store(self.path)
        for path, size in _files(self.path):
            with fs.open_input_file(path) as f:
                h = read_header(f, size)
                v = _chosen(h, self.names)
                x = [_coordinates(f, h, d, self.days) for d in v.dims]
            kept = [self._kept(h.dims[d][0], c) for d, c in zip(v.dims, x, strict=True)]
            if not all(map(len, kept)):
                continue
            steps = max(1, self.slab // max(1, h.inner(v) * np.dtype(v.kind).itemsize))
            cuts = np.flatnonzero((np.diff(kept[0]) != 1) | (np.diff(kept[0] // steps) != 0)) + 1
            out += [Slab(path, h, v, x, [part, *kept[1:]]) for part in np.split(kept[0], cuts)]
        return out

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if slab is None:  # nothing is left after filters
            return
        h, v, kept = slab.header, slab.variable, slab.kept
        fs, _ = store(self.path)
        attrs = {k: a[0] for k, a in v.attrs.items() if isinstance(a, list) and a}
        shape = h.shape(v)[1:]
        rest = int(np.prod(shape[1:], dtype=np.int64))
        low, high = (kept[1][0] * rest, (kept[1][-1] + 1) * rest) if len(kept) > 1 else (0, 1)
        with fs.open_input_file(slab.path) as f:
            for first in kept[0].tolist():
                raw = _numbers(f, h, v, first, 1, low, high).astype(float).ravel()
                if len(kept) > 1:
                    raw = raw.reshape(-1, *shape[1:])[np.ix_(kept[1] - kept[1][0], *kept[2:])]
                gone = ~np.isfinite(raw)
                for k in ("_FillValue", "missing_value"):
                    gone |= raw == attrs.get(k, FILL)
                value = (raw * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)).ravel()
                at = np.unravel_index(np.arange(len(value)), raw.shape) if len(kept) > 1 else ()
                cells = [np.full(len(value), slab.coordinates[0][first]), *(c[k[i]] for c, k, i in zip(slab.coordinates[1:], kept[1:], at, strict=True))]
                arrays = [pa.array([slab.path.rsplit("/", 1)[-1]] * len(value)), *map(pa.array, cells), pa.array(value, mask=gone.ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=self.columns)


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _named(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">I", len(raw)) + _padded(raw)


def _attributes(attrs: dict) -> bytes:
    out = struct.pack(">II", ATTRIBUTES if attrs else 0, len(attrs))
    for k, v in attrs.items():
        text = isinstance(v, str)
        raw = v.encode() if text else struct.pack(">d", v)
        out += _named(k) + struct.pack(">II", 2 if text else 6, len(raw) if text else 1) + _padded(raw)
    return out


def header_bytes(record: str, inner: dict[str, list[float]], variable: str, attrs: dict | None = None, units: str = "days since 1970-01-01") -> bytes:
    """The head of a file of version 2 whose records hold their own coordinate and one grid of doubles; coordinates of the grid follow the header."""
    dims = [(record, 0), *((k, len(v)) for k, v in inner.items())]
    head = b"CDF\x02" + struct.pack(">I", STREAMING) + struct.pack(">II", DIMENSIONS, len(dims)) + b"".join(_named(k) + struct.pack(">I", n) for k, n in dims) + _attributes({})
    cells = int(np.prod([len(v) for v in inner.values()], dtype=np.int64))
    listed = [(k, (i + 1,), {}, 8 * len(v)) for i, (k, v) in enumerate(inner.items())]
    listed += [(record, (0,), {"units": units}, 8), (variable, tuple(range(len(dims))), {"_FillValue": FILL, **(attrs or {})}, 8 * cells)]
    made = [(_named(n) + struct.pack(f">I{len(d)}I", len(d), *d) + _attributes(a) + struct.pack(">II", 6, min(size, STREAMING)), size) for n, d, a, size in listed]
    at = len(head) + 8 + sum(len(m) + 8 for m, _ in made)
    out = head + struct.pack(">II", VARIABLES, len(made))
    for m, size in made:
        out += m + struct.pack(">q", at)
        at += size
    return out + b"".join(np.array(v, ">f8").tobytes() for v in inner.values())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class GridWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.file, self.record, self.variable = options["file"], options["record"], options["variable"]
        self.inner = {k: v for k, v in json.loads(options["inner"]).items()}
        self.staged = f"{self.root}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows come by file, record and value; a record is written when the next begins."""
        fs, staged = store(self.staged)
        fs.create_dir(staged, recursive=True)
        shape = [len(v) for v in self.inner.values()]
        files, out, at, record = [], None, None, None
        grid = np.full(shape, FILL)

        def flush() -> None:
            if record is not None:
                out.write(np.array([record], ">f8").tobytes() + grid.astype(">f8").tobytes())
                grid.fill(FILL)

        try:
            for batch in batches:
                names = batch.column(self.file).to_pylist()
                steps = batch.column(self.record).to_numpy(zero_copy_only=False)
                places = [np.searchsorted(v, batch.column(k).to_numpy(zero_copy_only=False)) for k, v in self.inner.items()]
                values = batch.column(self.variable).to_pylist()
                for name, step, place, value in zip(names, steps.tolist(), zip(*places, strict=True), values, strict=True):
                    if name != at or step != record:
                        flush()
                        if name != at:
                            if out:
                                out.close()
                            files.append((f"{staged}/{name}-{uuid.uuid4().hex}", str(name)))
                            out = fs.open_output_stream(files[-1][0])
                            out.write(header_bytes(self.record, self.inner, self.variable))
                        at, record = name, step
                    if value is not None:
                        grid[place] = value
            flush()
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.root)
        for path, name in (x for m in messages if m for x in m.files):
            fs.move(path, f"{root}/{name}.nc")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staged = store(self.staged)
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_dir(staged)


class GridSource(DataSource):
    """Options path; variable, names by preference; days, coordinates that count from a date as days since 1970; slab_bytes."""

    @classmethod
    def name(cls) -> str:
        return "classic_grid"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no file in {self.options['path']}")
        fs, _ = store(self.options["path"])
        with fs.open_input_file(files[0][0]) as f:
            h = read_header(f, files[0][1])
        v = _chosen(h, [n.strip() for n in self.options.get("variable", "").split(",")])
        named = [h.dims[d][0] for d in v.dims]
        kinds = ["double" if n in h.variables and h.variables[n].dims == (d,) else "long" for n, d in zip(named, v.dims, strict=True)]
        return ", ".join(["file string", *(f"`{n}` {k}" for n, k in zip(named, kinds, strict=True)), "value double"])

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options))


def read_grid(spark: SparkSession, path: str, variable: str = "", days: bool = True, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(file, a column for each dimension, value) of a file or of all files in a folder."""
    ship(spark)
    spark.dataSource.register(GridSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source takes filters
    return spark.read.format("classic_grid").options(path=path, variable=variable, days=str(days).lower(), slab_bytes=slab_bytes).load()


def write_grid(df: DataFrame, path: str, file: str, record: str, inner: list[str], variable: str) -> None:
    """One file for each value of `file`, a record for each of `record` (days since 1970) in order; axes hold all values that inner columns take."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(GridSource)
    axes = {c: [float(r[0]) for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()] for c in inner}  # the grid's own axes
    rows = df.dropna(subset=[file, record, *inner]).select(F.col(file).cast("string").alias(file), *[F.col(c).cast("double").alias(c) for c in (record, *inner, variable)])
    rows = rows.repartition(file).sortWithinPartitions(file, record, *inner, variable)
    rows.write.format("classic_grid").options(path=path, file=file, record=record, variable=variable, inner=json.dumps(axes)).mode("append").save()
