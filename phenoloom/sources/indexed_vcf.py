"""Windows of bgzip VCF by index, as a Spark data source: a task reads the blocks of its window and nothing else.

Reading: the driver reads the indexes, which are small, and cuts each sequence into windows of `window` places; a window with
records is a partition, a window without is none. Conditions on chrom and pos, given as options or pushed down from a
filter, drop windows before any block is read. Writing: each task writes one bgzip part and its index, under names of its
own that become the parts' names when all tasks are done.

Files are opened through Arrow's file systems, so paths may be local or remote URIs.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import bgzf

SCHEMA = "chrom string, pos bigint, value string"
WINDOW = 5_000_000
#: Records of an Arrow batch.
BATCH = 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop writes local URIs with a single slash."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def plain_chrom(name: str) -> str:
    return name.removeprefix("chr")


def indexed_files(path: str) -> list[tuple[str, str]]:
    """(file, index) of a bgzip file, or of all of a folder; a file without an index is an error."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = {x.path for x in store.get_file_info(fs.FileSelector(at if info.type == fs.FileType.Directory else posixpath.dirname(at)))}
    files = sorted(f for f in found if f.endswith((".gz", ".bgz")) and not posixpath.basename(f).startswith((".", "_"))) if info.type == fs.FileType.Directory else [at]
    out = []
    for f in files:
        index = next((f + end for end in (".tbi", ".csi") if f + end in found), None)
        if f not in found or index is None:
            raise FileNotFoundError(f"{f} or its .tbi or .csi index")
        out.append((f, index))
    return out


@dataclass
class Window(InputPartition):
    """Records of one file and sequence with start < pos <= end, and the chunks that hold them."""

    file: str
    chrom: str
    start: int
    end: int
    chunks: list[bgzf.Chunk]


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.window = int(options.get("window", WINDOW))
        self.chrom = plain_chrom(options["chrom"]) if "chrom" in options else None
        self.start, self.end = int(options.get("start", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[Window]:
        store, _ = opened(self.path)
        out = []
        for file, index_path in indexed_files(self.path):
            with store.open_input_file(index_path) as f:
                index = bgzf.parse_index(f.read())
            for name in index.sequences:
                if self.chrom is not None and plain_chrom(name) != self.chrom:
                    continue
                end = index.end(name) if self.end is None else min(self.end, index.end(name))
                low = self.start
                while low < end:
                    high = min(end, (low // self.window + 1) * self.window)
                    if chunks := index.chunks(name, low, high):
                        out.append(Window(file, name, low, high, chunks))
                    low = high
        return out or [Window("", "", 0, 0, [])]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as file:
            yield from window_batches(file, partition)


class PushingReader(WindowReader):
    """Takes conditions from filters as well; Spark evaluates them once more, so windows need not be exact."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            elif f.__class__ in (GreaterThan, GreaterThanOrEqual, EqualTo) and f.attribute == ("pos",):
                self.start = max(self.start, f.value - (0 if isinstance(f, GreaterThan) else 1))
            if f.__class__ in (LessThan, LessThanOrEqual, EqualTo) and f.attribute == ("pos",):
                end = f.value - isinstance(f, LessThan)
                self.end = end if self.end is None else min(self.end, end)
            yield f


def window_batches(file, window: Window) -> Iterator[pa.RecordBatch]:
    """(chrom, pos, line) of a window's records, in the file's order."""
    name, chrom = window.chrom.encode(), plain_chrom(window.chrom)
    pos, value = [], []
    for chunk in window.chunks:
        for line in bgzf.lines(file, chunk):
            if line.startswith(b"#") or not line:
                continue
            first, second, _ = line.split(b"\t", 2)
            at = int(second)
            if first != name or at <= window.start:
                continue
            if at > window.end:
                break
            pos.append(at)
            value.append(line.decode())
            if len(pos) == BATCH:
                yield _batch(chrom, pos, value)
                pos, value = [], []
    if pos:
        yield _batch(chrom, pos, value)


def _batch(chrom: str, pos: list[int], value: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chrom), len(pos)), pa.array(pos, pa.int64()), pa.array(value, pa.string())], ["chrom", "pos", "value"])


@dataclass
class Written(WriterCommitMessage):
    """A task's part, the first record in it, the name it was written under and the kind of its index."""

    first: tuple
    name: str
    index: str


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.header = options["path"], options.get("header", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.path)
        name, first = f"{at}/_writing-{uuid.uuid4().hex}", []

        def records() -> Iterator[tuple[str, int, int, bytes]]:
            for batch in iterator:
                for line in batch.column(batch.schema.get_field_index("value")).to_pylist():
                    chrom, pos, _, ref, _ = line.split("\t", 4)
                    if not first:
                        first.extend((chrom, int(pos)))
                    yield chrom, int(pos) - 1, int(pos) - 1 + max(1, len(ref)), line.encode()

        store.create_dir(at, recursive=True)
        with store.open_output_stream(name + ".gz", compression=None) as out:
            index = bgzf.write_indexed(out, self.header.encode(), records(), far=True)
        kind = ".gz" + bgzf.index_ending(index)
        with store.open_output_stream(name + kind, compression=None) as out:
            out.write(index)
        return Written(tuple(first), name, kind)

    def commit(self, messages: list[Written]) -> None:
        """Parts with records get their names in the order of their first records; what other attempts left goes."""
        store, at = opened(self.path)
        named = sorted((m for m in messages if m is not None and m.first), key=lambda m: (m.first, m.name))
        for k, m in enumerate(named):
            for end in (m.index, ".gz"):
                store.move(m.name + end, f"{at}/part-{k:05d}.vcf{end}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = opened(self.path)
        for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if posixpath.basename(x.path).startswith("_writing-"):
                store.delete_file(x.path)


class IndexedVcf(DataSource):
    """format("indexed_vcf"): options path, window, chrom, start (excluded), end (included); for writing path and header."""

    @classmethod
    def name(cls) -> str:
        return "indexed_vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        return PushingReader(self.options) if self.options.get("pushdown") == "true" else WindowReader(self.options)

    def writer(self, schema, overwrite: bool) -> PartWriter:
        store, at = opened(self.options["path"])
        present = [x for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.is_file]
        if present and not overwrite:
            raise FileExistsError(f"{at} has files")
        for x in present:
            store.delete_file(x.path)
        return PartWriter(self.options)


def read_windows(spark: SparkSession, path: str, chrom: str | None = None, start: int = 0, end: int | None = None, window: int = WINDOW) -> DataFrame:
    """(chrom, pos, value) of a bgzip VCF file or a folder of them: of all records, or with start < pos <= end on a sequence.

    A partition is a window of `window` places. With spark.sql.python.filterPushdown.enabled, later filters on chrom and pos
    choose windows as these arguments do. `readers.vcf_records` takes the lines apart.
    """
    spark.dataSource.register(IndexedVcf)
    given = {"chrom": chrom, "start": start, "end": end, "window": window, "path": path}
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true":
        given["pushdown"] = "true"
    return spark.read.format("indexed_vcf").options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def write_windows(lines: DataFrame, path: str, header: str = "", overwrite: bool = False) -> None:
    """VCF lines (`value`) as bgzip parts, dealt to tasks by ranges of sequence and position, each with its index."""
    parts = F.split("value", "\t")
    lines.sparkSession.dataSource.register(IndexedVcf)
    order = [F.get(parts, F.lit(0)).asc(), F.get(parts, F.lit(1)).cast("bigint").asc()]
    placed = lines.select("value").repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.format("indexed_vcf").option("header", header).mode("overwrite" if overwrite else "append").save(path)
