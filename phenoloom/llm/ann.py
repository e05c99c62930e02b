"""Operator 9: nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors are centred and turned by rotations fitted (iterative quantisation) on a bounded sample; signs give BITS
bits. A code is split into substrings of 16 bits, each with its own table: rows ordered by substring value. By the
pigeonhole principle a code within Hamming radius r of the query differs from it in at most r // m bits in one of the m
substrings, so looking up every bucket that near in every table finds all codes within r. What is found is held to r on
whole codes and then ranked by exact distance on the original vectors in double precision.
The radius is the smallest that keeps `coverage` of the exact neighbours of sampled vectors among sampled vectors. In a
larger table neighbours are nearer still, so the same radius covers more of them. Queries with fewer than k rows in the
radius (outliers, sparse clusters) are sent once more with all bits as the radius, which is an exact search.

Every row is indexed, in blocks of up to BLOCK_ROWS where it is read; vectors are never shuffled. Queries are sent in chunks
of a fixed size as broadcasts, one pass for each chunk. The k-th distance within the sample, taken where the queries are
read, bounds each query's results, so blocks send only what can still be among the k nearest.

Defined cases: null and zero vectors, vectors with null or non-finite parts, of a length other than the commonest, and
rows without id take no part; ids that repeat are one query, and no row with the query's id is its own neighbour; ties go
to the smaller id; rows that repeat an id and a vector are candidates as often as they are there; columns of any other name
than the two are not read, also where they are called query_id, rank or score; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors that rotations, radius and bounds are learned from; queries of one pass.
SAMPLE, CHUNK = 8_192, 32_768
BITS, PART = 128, 16
#: Rows of an index.
BLOCK_ROWS = 65_536
COUNTS = np.array([bin(i).count("1") for i in range(1 << PART)], np.uint8)


@dataclass
class CodeBook:
    mean: np.ndarray
    turns: np.ndarray  # dim x BITS
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = ((x - self.mean) @ self.turns > 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def _rotation(v: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings v near to the corners of the cube."""
    turn = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return turn


def fit(sample: np.ndarray, k: int = 10, coverage: float = 0.99, bits: int = BITS, seed: int = 3) -> CodeBook:
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    turns: list[np.ndarray] = []
    while sum(t.shape[1] for t in turns) < bits:
        turns.append(_rotation(centred, rng))
    book = CodeBook(mean, np.hstack(turns)[:, :bits], bits)
    probes = sample[:: max(1, len(sample) // 256)][:256]
    near = []
    codes = book.encode(sample)
    for x, c in zip(probes, book.encode(probes), strict=True):
        d = ((sample - x) ** 2).sum(1)
        nearest = np.argsort(d, kind="stable")[1 : k + 1]  # the first is the vector itself
        near.append(COUNTS[codes[nearest] ^ c].sum(1, dtype=np.int64))
    if near and len(np.concatenate(near)):
        book.radius = int(np.quantile(np.concatenate(near), coverage, method="higher"))
    return book


class Block:
    """The tables of one block of rows: per substring, row numbers in the order of the substring's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for p in range(codes.shape[1]):
            order = np.argsort(codes[:, p], kind="stable")
            values, starts = np.unique(codes[order, p], return_index=True)
            self.tables.append((values, np.r_[starts, len(order)], order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius."""
        each = radius // len(self.tables)
        found = np.zeros(len(self.codes), bool)
        for p, (values, starts, order) in enumerate(self.tables):
            hit = np.flatnonzero(COUNTS[values ^ code[p]] <= each)
            if len(hit) == len(values):
                found[:] = True
                break
            sizes = starts[hit + 1] - starts[hit]
            at = np.repeat(starts[hit] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            found[order[at]] = True
        rows = np.flatnonzero(found)
        return rows[COUNTS[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(vector)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == common[0]["n"]) if common else rows


def nearest(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows for which the column expression is_query holds."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    schema = "query_id bigint, vec_id bigint, score double"
    found = spark.createDataFrame([], schema)
    if picked:
        sample = np.array([r["v"] for r in picked])
        sample_ids = np.array([r["vec_id"] for r in picked])
        book = fit(sample, k)
        queries = rows.where(is_query)
        chunks = -(-queries.count() // CHUNK)
        for chunk in range(chunks):
            part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk) if chunks > 1 else queries
            own = {r["vec_id"]: r["v"] for r in part.collect()}
            if own:
                near = _search(rows, book, own, sample, sample_ids, k, schema)
                full = near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
                few = own.keys() - {r["query_id"] for r in full.collect()}
                if few:
                    near = near.join(full, "query_id", "left_semi")
                    near = near.unionByName(_search(rows, replace(book, radius=BITS), {i: own[i] for i in few}, sample, sample_ids, k, schema))
                found = found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(rows: DataFrame, ids: list[int], sample: np.ndarray, sample_ids: np.ndarray, k: int) -> dict[int, float]:
    """Distance of each query's k-th nearest vector of the sample, a little more than exact; taken in tasks."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "vec_id bigint"))
    sent = spark.sparkContext.broadcast((sample, sample_ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, sample_ids = sent.value
        for batch in batches:
            if batch.num_rows:
                names, out = batch.column(0).to_numpy(), []
                for i, q in zip(names, _matrix(batch.column(1)), strict=True):
                    d = ((sample[sample_ids != i] - q) ** 2).sum(1)
                    out.append(np.sqrt(np.partition(d, k - 1)[k - 1]) * (1 + 1e-9) if len(d) >= k else np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["vec_id", "bound"])

    found = rows.join(wanted, "vec_id", "left_semi").mapInArrow(work, "vec_id bigint, bound double").groupBy("vec_id").agg(F.max("bound").alias("bound")).collect()
    sent.unpersist()
    return {r["vec_id"]: r["bound"] for r in found}


def _search(rows: DataFrame, book: CodeBook, own: dict[int, list[float]], sample: np.ndarray, sample_ids: np.ndarray, k: int, schema: str) -> DataFrame:
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids])
    known = _bounds(rows, ids.tolist(), sample, sample_ids, k)
    sent = rows.sparkSession.sparkContext.broadcast((book, ids, x, book.encode(x), np.array([known[i] for i in ids.tolist()])))

    def answers(names: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        book, ids, x, codes, bounds = sent.value
        block = Block(book.encode(v))
        q_out, id_out, d_out = [], [], []
        for n in range(len(ids)):
            at = block.within(codes[n], book.radius)
            at = at[names[at] != ids[n]]
            d = np.sqrt(((v[at] - x[n]) ** 2).sum(1))
            keep = np.flatnonzero(d <= bounds[n])
            if len(keep) > k:
                keep = keep[np.lexsort((names[at[keep]], d[keep]))[:k]]
            q_out.append(np.full(len(keep), ids[n]))
            id_out.append(names[at[keep]])
            d_out.append(d[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_out)), pa.array(np.concatenate(id_out)), pa.array(np.concatenate(d_out))], ["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                names.append(batch.column(0).to_numpy())
                vectors.append(_matrix(batch.column(1)))
                held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield answers(np.concatenate(names), np.concatenate(vectors))
                names, vectors, held = [], [], 0
        if held:
            yield answers(np.concatenate(names), np.concatenate(vectors))

    found = materialise(rows.mapInArrow(work, schema), "near")
    sent.unpersist()
    return found
