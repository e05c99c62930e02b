"""Sums over markers of few samples: Gram matrices, kinship, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import small_side

#: Samples whose square matrix is still sent to the driver (8 n^2 bytes).
MOST_SAMPLES = 4_000
#: Blocks of rows that a task reads of either side to multiply every two.
PAIRED = 10


def gram(markers: DataFrame, scale: str = "zscore", dosage: str = "dosage") -> tuple[np.ndarray, int]:
    """(Z^T Z over all markers, markers used) as samples x samples.

    scale: `zscore` (ddof 1, markers without variance left out), `centre`, `none`, or `vanraden` (centred by 2p, to be
    divided by the sum of 2pq, which is returned in place of the count). Every task sends one partial matrix; they are
    added in a tree.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            if g.shape[1] > MOST_SAMPLES:
                raise ValueError(f"more than {MOST_SAMPLES} samples")
            if scale == "vanraden":
                f = g.mean(1) / 2
                z, used = g - 2 * f[:, None], used + float((2 * f * (1 - f)).sum())
            elif scale == "none":
                z, used = g, used + len(g)
            else:
                z = g - g.mean(1, keepdims=True)
                if scale == "zscore":
                    sd = g.std(1, ddof=1) if g.shape[1] > 1 else np.zeros(len(g))
                    z = z[sd > 0] / sd[sd > 0][:, None]
                used += len(z)
            part = z.T @ z
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([float(used)])], ["m", "used"])

    parts = markers.select(dosage).mapInArrow(work, "m binary, used double")
    # An exchange parts products from sums, so products keep all tasks; partial sums meet in 32 tasks and then in one.
    for groups in (32, 1):
        parts = parts.repartition(groups).mapInArrow(_add, "m binary, used double")
    rows = parts.collect()
    if not rows:
        return np.zeros((0, 0)), 0
    n = int(np.sqrt(len(rows[0]["m"]) // 8))
    total = sum(np.frombuffer(r["m"]).reshape(n, n) for r in rows)
    used = sum(r["used"] for r in rows)
    return total, used if scale == "vanraden" else int(used)


def gram_columns(rows: DataFrame, values: str) -> DataFrame:
    """(i, j, product): the Gram matrix of the places of an array column over all rows, as cells. Every task sends one partial
    matrix of columns x columns, so rows may be any number; more than MOST_SAMPLES columns are refused."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                if x.shape[1] > MOST_SAMPLES:
                    raise ValueError(f"more than {MOST_SAMPLES} columns")
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], ["i", "j", "product"])

    cells = rows.where(F.col(values).isNotNull()).select(values).mapInArrow(work, "i bigint, j bigint, product double")
    return cells.groupBy("i", "j").agg(F.sum("product").alias("product"))


def gram_long(rows: DataFrame, key: str, values: str, size: int = 1024, among: DataFrame | None = None) -> DataFrame:
    """(i, j, product) for every two rows and each row with itself; rows are cut into blocks that meet pairwise, one product of
    matrices for two blocks. With `among` (id, idx) all rows are multiplied as well, but cells are (row, col, product) of rows
    that have a place there, taken from each product before it becomes rows of a table.

    The result is quadratic by nature. Blocks are exchanged once; a task reads some blocks of either side and multiplies every
    two, so nothing quadratic is written on the way, and a task holds few blocks and one product.
    """
    own = rows.where(F.col(values).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(values).alias("v"))
    names = ("i", "j", "product")
    if among is not None:
        own, names = own.join(small_side(among.select("id", F.col("idx").cast("bigint").alias("at"))), "id", "left"), ("row", "col", "product")
    else:
        own = own.withColumn("at", F.col("id"))
    blocks = max(1, -(-rows.count() // size))
    packed = own.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.struct("at", "v").alias("m")).groupBy("block").agg(F.collect_list("m").alias("rows"))
    packed = packed.select("rows").repartition(min(blocks, max(4, -(-blocks // PAIRED))))
    both = packed.withColumnRenamed("rows", "a").join(packed.withColumnRenamed("rows", "b").hint("shuffle_replicate_nl"))

    def unpacked(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of a block's rows that have one, which rows these are, all rows' values."""
        at, v = column[k].values.flatten()
        has = at.is_valid().to_numpy(zero_copy_only=False)
        return at.drop_null().to_numpy(), has, np.asarray(v.flatten(), float).reshape(len(at), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (i, of_i, x), (j, of_j, y) = unpacked(batch.column(0), k), unpacked(batch.column(1), k)
                found = (x @ y.T)[np.ix_(of_i, of_j)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(found.ravel())], list(names))

    return both.mapInArrow(work, f"{names[0]} bigint, {names[1]} bigint, product double")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, used = None, 0.0
    for batch in batches:
        for m, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(m)
            total, used = x.copy() if total is None else total + x, used + u
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([used])], ["m", "used"])


def kinship_vanraden(markers: DataFrame, dosage: str = "dosage") -> np.ndarray:
    """Centred products over the sum of 2pq."""
    total, scale = gram(markers, "vanraden", dosage)
    return total / scale if scale else total


def kinship_covariates(kinship: np.ndarray, n: int = 3, least: float = 1e-8) -> np.ndarray:
    """First eigenvectors of positive eigenvalues, largest first; signs so that the largest part is positive."""
    values, vectors = np.linalg.eigh((kinship + kinship.T) / 2)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > least][:n]
    return _signed(vectors[:, order])


def _signed(v: np.ndarray) -> np.ndarray:
    if not v.size:
        return v
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def principal_components(markers: DataFrame, n: int = 10, dosage: str = "dosage", scale: str = "zscore") -> tuple[np.ndarray, np.ndarray]:
    """(scores samples x n, explained share) by the eigenvectors of the samples' Gram matrix."""
    total, used = gram(markers, scale, dosage)
    samples = len(total)
    # Columns are centred over samples already, marker by marker.
    values, vectors = np.linalg.eigh(total)
    order = np.argsort(-values)[: min(n, max(samples - 1, 0), used)]
    values = np.maximum(values, 0)
    share = values[order] / values.sum() if values.sum() > 0 else values[order]
    return _signed(vectors[:, order]) * np.sqrt(values[order]), share


def scores_frame(spark, samples: list[str], scores: np.ndarray) -> DataFrame:
    """(sample, PC1, PC2, ...)."""
    columns = ["sample", *[f"PC{k + 1}" for k in range(scores.shape[1])]]
    return spark.createDataFrame([(s, *map(float, row)) for s, row in zip(samples, scores, strict=True)], columns)
