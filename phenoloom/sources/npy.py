"""Rows of .npy files and of arrays in .npz files as a Spark data source: a task reads its rows' bytes and nothing else.

The header (of a .npz: the zip directory and the member's header) says where row k begins, so a file of any size is cut into
row ranges of `bytes` bytes, one partition each, and a list of asked rows is read as runs of neighbouring rows. With `columns`
only the stretch from the first to the last of them is read of a row that is wide. Types are kept. Members of a .npz that are
compressed, and arrays in column order, have no such offsets: these are errors that say so (`readers.read_npy` reads whole
files of any order).
"""

from __future__ import annotations

import math
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .indexed_vcf import opened

#: Bytes of a partition.
RANGE = 64 << 20
#: Bytes of a row from which columns are looked up by offset.
WIDE = 64 << 10
SPARK = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f2": "float", "f4": "float", "f8": "double"}


@dataclass(frozen=True)
class Array:
    """Where an array's rows are in a file."""

    file: str
    start: int
    dtype: str
    shape: tuple[int, ...]

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize

    @property
    def kind(self) -> str:
        """Spark's type of an element."""
        d = np.dtype(self.dtype)
        if d.kind in "US":
            return "string"
        if (name := d.str[1:]) not in SPARK:
            raise ValueError(f"{self.file}: no Spark type for {d}")
        return SPARK[name]


def described(store: fs.FileSystem, file: str, key: str | None) -> Array:
    """The array of a .npy file, or the one called `key` of a .npz."""
    with store.open_input_file(file) as f:
        base = 0
        if file.endswith(".npz"):
            with zipfile.ZipFile(f) as z:
                names = {n.removesuffix(".npy"): n for n in z.namelist()}
                if key not in names:
                    raise KeyError(f"{file} has {', '.join(sorted(names))}, not {key}")
                info = z.getinfo(names[key])
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{file}: {key} is compressed, so its rows have no place to read from")
            f.seek(info.header_offset)
            name, extra = struct.unpack("<26x2H", f.read(30))
            base = info.header_offset + 30 + name + extra
        f.seek(base)
        version = np.lib.format.read_magic(f)
        shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if dtype.hasobject:
            raise ValueError(f"{file}: arrays of Python objects are not read")
        if by_column and len(shape) > 1:
            raise ValueError(f"{file}: the array is in column order, so rows are not stretches of the file")
        return Array(file, f.tell(), dtype.str, shape or (1,))


@dataclass
class Runs(InputPartition):
    """Runs [first, end) of rows of one array."""

    array: Array
    runs: list[tuple[int, int]]


def runs_of(rows: list[int], most: int) -> Iterator[list[tuple[int, int]]]:
    """Sorted rows as runs of neighbours, in lists of at most `most` rows."""
    out, held = [], 0
    for r in rows:
        if held == most:
            yield out
            out, held = [], 0
        if out and out[-1][1] == r:
            out[-1] = (out[-1][0], r + 1)
        else:
            out.append((r, r + 1))
        held += 1
    if out:
        yield out


class RowReader(DataSourceReader):
    def __init__(self, options: dict, array: Array, others: list[Array]):
        self.arrays = [array, *others]
        self.bytes = int(options.get("bytes", RANGE))
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.rows = sorted({int(r) for r in options["rows"].split(",")}) if options.get("rows") else None
        self.low, self.high = 0, None
        bad = [c for c in self.columns or [] for a in self.arrays if not 0 <= c < a.width]
        if bad:
            raise ValueError(f"no column {bad[0]}")

    def partitions(self) -> list[Runs]:
        out = []
        for a in self.arrays:
            most = max(1, self.bytes // max(1, a.row_bytes))
            low, high = max(0, self.low), a.shape[0] if self.high is None else min(self.high, a.shape[0])
            if self.rows is None:
                out += [Runs(a, [(k, min(k + most, high))]) for k in range(low, high, most)]
            else:
                if bad := [r for r in self.rows if not 0 <= r < a.shape[0]]:
                    raise ValueError(f"{a.file} has {a.shape[0]} rows, not row {bad[0]}")
                out += [Runs(a, runs) for runs in runs_of([r for r in self.rows if low <= r < high], most)]
        return out or [Runs(self.arrays[0], [])]

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        store, _ = opened(partition.array.file)
        with store.open_input_file(partition.array.file) as f:
            yield from row_batches(f, partition, self.columns)


class PushingRowReader(RowReader):
    """Takes conditions on `row` from filters too; Spark evaluates them once more."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, EqualTo | In):
                    asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    asked = {r for r in asked if r is not None and all(0 <= r < a.shape[0] for a in self.arrays)}
                    self.rows = sorted(asked if self.rows is None else asked & set(self.rows))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = f.value + isinstance(f, LessThanOrEqual)
                    self.high = high if self.high is None else min(self.high, high)
            yield f


def row_batches(f, part: Runs, columns: list[int] | None, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(file, row, value or values) of the runs, a few megabytes at a time."""
    a = part.array
    dtype = np.dtype(a.dtype)
    take = None if columns is None else np.array(columns)
    first, last = (0, a.width) if take is None or a.row_bytes < WIDE else (int(take.min()), int(take.max()) + 1)
    step = max(1, most_bytes // max(1, (last - first) * dtype.itemsize))
    for begin, end in part.runs:
        for k in range(begin, end, step):
            n = min(step, end - k)
            if last - first == a.width:
                f.seek(a.start + k * a.row_bytes)
                data = f.read(n * a.row_bytes)
            else:
                pieces = []
                for r in range(k, k + n):
                    f.seek(a.start + r * a.row_bytes + first * dtype.itemsize)
                    pieces.append(f.read((last - first) * dtype.itemsize))
                data = b"".join(pieces)
            x = np.frombuffer(data, dtype).reshape(n, last - first)
            x = x if take is None else x[:, take - first]
            flat = _values(np.ascontiguousarray(x).ravel(), a.kind)
            if len(a.shape) == 1:
                value, name = flat, "value"
            else:
                value, name = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), flat), "values"
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(a.file), n), pa.array(np.arange(k, k + n, dtype=np.int64)), value], ["file", "row", name])


def _values(x: np.ndarray, kind: str) -> pa.Array:
    if kind == "string":
        return pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in x.tolist()], pa.string())
    plain = {"boolean": np.bool_, "tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[kind]
    return pa.array(x.astype(plain, copy=False))


class Npy(DataSource):
    """format("npy"): options path (a file or a folder of files alike), key (of a .npz), rows, columns, bytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def arrays(self) -> list[Array]:
        store, at = opened(self.options["path"])
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(at)
        files = [at] if info.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if posixpath.splitext(x.path)[1] in (".npy", ".npz"))
        if not files:
            raise FileNotFoundError(f"{at} has no .npy or .npz file")
        found = [described(store, f, self.options.get("key")) for f in files]
        if len({(a.kind, len(a.shape)) for a in found}) > 1:
            raise ValueError(f"{at} has arrays of different types or dimensions")
        return found

    def schema(self) -> str:
        first = self.arrays()[0]
        return f"file string, row bigint, {f'value {first.kind}' if len(first.shape) == 1 else f'values array<{first.kind}>'}"

    def reader(self, schema) -> RowReader:
        first, *others = self.arrays()
        return (PushingRowReader if self.options.get("pushdown") == "true" else RowReader)(self.options, first, others)


def read_rows(spark: SparkSession, path: str, key: str | None = None, rows: list[int] | None = None, columns: list[int] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(file, row, values) of an array, or (file, row, value) of one with a single dimension: all rows, or the rows asked for.

    With spark.sql.python.filterPushdown.enabled, filters on `row` choose rows as the argument does.
    """
    spark.dataSource.register(Npy)
    given = {"path": path, "key": key, "rows": None if rows is None else ",".join(map(str, rows)), "columns": None if columns is None else ",".join(map(str, columns)), "bytes": str(range_bytes)}
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true":
        given["pushdown"] = "true"
    return spark.read.format("npy").options(**{k: v for k, v in given.items() if v is not None}).load()
