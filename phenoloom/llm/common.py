"""Helpers shared by the corpus operators: shared-folder tables, Arrow passes and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator on words: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in a local session without it, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    path = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path.isDefined():
        return path.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phenoloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Where tables written by materialise() stand, by DataFrame, until discard() removes them.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and every executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _stored[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables written by materialise() that nothing reads any more; shuffle files go with the plans that made them."""
    for table in tables:
        path = _stored.pop(table, None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string")) % modulus


def slices(batches: Iterator[pa.RecordBatch], most_rows: int = 2048, most_bytes: int = 8 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has more rows or, unless it is a single row, more text than asked for."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(_byte_lengths(column))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + most_bytes, side="right"))
            stop = min(max(stop, start + 1), start + most_rows, n)
            yield batch.slice(start, stop - start)
            start = stop


def _byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def arrow_pass(df: DataFrame, columns: list[str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One Arrow pass over the named columns only."""
    return df.select(*columns).mapInArrow(work, schema)


def record_batch(**columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 after lower-casing A-Z only, which is what bytes.lower does; bytes.split parts at the white space of WORD_PATTERN."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """word as UTF-8 -> 64-bit hash, kept for repeated words; emptied when it has grown large, so memory stays bounded."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes of words that are hashed at once, so that the arrays of a long text stay small.
BLOCK = 1 << 20
ODD = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
#: A number for each byte: A-Z as a-z, white space nothing.
BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
BYTES[SPACE] = 0


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (words as in words_of), and where each text's words begin among them, with the end.

    A word's hash is the mixed sum of its bytes' numbers times powers of an odd number, for all words at once.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.empty(0, np.uint8)
    edges -= edges[0]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    out = np.empty(len(starts), np.uint64)
    low = 0
    with np.errstate(over="ignore"):
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + BLOCK)))
            end = starts[high] if high < len(starts) else len(data)
            own = starts[low:high] - starts[low]
            sizes = np.diff(np.r_[own, end - starts[low]])
            place = np.arange(end - starts[low], dtype=np.int32) - np.repeat(own.astype(np.int32), sizes)
            powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()), ODD, np.uint64)], dtype=np.uint64)
            out[low:high] = np.add.reduceat(BYTES[data[starts[low] : end]] * powers[place], own)
            low = high
    return mix64(out), np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of `width` words, in order; fewer words make one shingle of all of them; no word, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    take = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - take + 1, take, np.uint64)
        for k in range(take):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - take + 1 + k])
    return out
