"""Principal components and kinship eigenvectors of any number of samples, without a samples x samples matrix.

Wanted are the first eigenvectors of A = Z'Z, Z being markers x samples. A pass over the markers gives A X for a thin block
X (samples x block): each task multiplies its markers with X and the products back onto samples, and partial sums of that
thin shape are added in a tree. The driver keeps an orthonormal basis V and A V, takes the best eigenvectors in their span,
and sends what A makes of these beyond the span as the next block, until that rest is small. A basis that gets too wide is
cut back to its best vectors. All that is held is samples x a few blocks; the bytes are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .structure import _add, _signed

#: Bytes of the thin block that is sent to every task.
MOST_BYTES = 1 << 29


@dataclass(frozen=True)
class Components:
    """vectors (samples x n, orthonormal), values, their share of all variance, the residual norms over the first value, the
    trace, and passes over the markers."""

    vectors: np.ndarray
    values: np.ndarray
    share: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    @property
    def scores(self) -> np.ndarray:
        return self.vectors * np.sqrt(self.values)


def scaled(g: np.ndarray, scale: str) -> tuple[np.ndarray, float]:
    """Rows of Z and what they add to the divisor, as `structure.gram` scales them: zscore, centre, none or vanraden."""
    if scale == "vanraden":
        f = g.mean(1) / 2
        return g - 2 * f[:, None], float((2 * f * (1 - f)).sum())
    if scale == "none":
        return g, 0.0
    z = g - g.mean(1, keepdims=True)
    if scale == "zscore":
        sd = g.std(1, ddof=1) if g.shape[1] > 1 else np.zeros(len(g))
        z = z[sd > 0] / sd[sd > 0][:, None]
    return z, 0.0


def multiply(markers: DataFrame, x: np.ndarray, scale: str, dosage: str = "dosage", batch: int = 1024) -> tuple[np.ndarray, float, float]:
    """(Z'Z x, the trace of Z'Z, the divisor): one pass, one thin partial sum a task."""
    if x.nbytes > MOST_BYTES:
        raise ValueError(f"a block of {x.nbytes} bytes; take fewer components at once")
    sent = markers.sparkSession.sparkContext.broadcast(x)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        total, used = None, np.zeros(2)
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                g = np.asarray(part.column(0).flatten(), float).reshape(part.num_rows, -1)
                if g.shape[1] != len(x):
                    raise ValueError(f"a dosage array doesn't have {len(x)} samples")
                z, divisor = scaled(g, scale)
                product = z.T @ (z @ x)
                total = product if total is None else total + product
                used += (float((z * z).sum()), divisor)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[total.ravel(), used].tobytes()], pa.binary()), pa.array([0.0])], ["m", "used"])

    parts = markers.select(dosage).mapInArrow(work, "m binary, used double")
    for groups in (32, 1):
        parts = parts.repartition(groups).mapInArrow(_add, "m binary, used double")
    rows = parts.collect()
    sent.unpersist()
    if not rows:
        return np.zeros_like(x), 0.0, 0.0
    flat = np.frombuffer(rows[0]["m"])
    return flat[:-2].reshape(x.shape), float(flat[-2]), float(flat[-1])


def _beyond(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` has outside the span of `basis`, by the Gram matrix of the thin rest alone."""
    size = np.linalg.norm(new, axis=0)
    rest = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    for _ in range(2):
        values, vectors = np.linalg.eigh(rest.T @ rest)
        kept = values > 1e-12
        rest = (rest @ vectors[:, kept]) / np.sqrt(values[kept])
        rest = rest - basis @ (basis.T @ rest)
    return rest


def components(markers: DataFrame, samples: int, n: int = 10, scale: str = "zscore", dosage: str = "dosage", tolerance: float = 1e-10, most_passes: int = 60, block: int | None = None, most_columns: int = 512, seed: int = 0) -> Components:
    """The first n eigenvectors of Z'Z. `residuals` says how exactly each is one; a call that runs out of passes is an error.

    Ties between eigenvalues leave their vectors open inside the common subspace, as any eigensolver does. With no more
    samples than a few blocks the basis becomes the whole space and the result exact. With scale vanraden the values are
    those of the kinship matrix. Fewer positive values than n give fewer vectors; no marker gives none.
    """
    block = min(samples, block or max(2 * n, 32))
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((samples, block)))[0] if samples else np.zeros((0, 0))
    basis, image = np.zeros((samples, 0)), np.zeros((samples, 0))
    trace = divisor = 0.0
    for passes in range(1, most_passes + 1):
        product, trace, divisor = multiply(markers, new, scale, dosage)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        inner = basis.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        wide = order[: min(block, len(order))]
        found, found_image = basis @ vectors[:, wide], image @ vectors[:, wide]
        rest = found_image - found * values[wide]
        kept = [k for k in range(min(n, len(wide))) if values[wide[k]] > 1e-10 * max(trace, 1e-300)]
        residuals = np.linalg.norm(rest[:, kept], axis=0) / max(values[wide[0]], 1e-300) if len(wide) else np.zeros(0)
        new = _beyond(rest, basis)
        if not new.shape[1] or (len(residuals) and residuals.max() <= tolerance) or not trace:
            scale_by = divisor if scale == "vanraden" and divisor else 1.0
            top = values[wide[kept]]
            return Components(_signed(found[:, kept]), top / scale_by, top / trace if trace else top, residuals, trace / scale_by, passes)
        if basis.shape[1] + new.shape[1] > max(most_columns, 3 * block):
            order = order[: 2 * block]
            basis, image = basis @ vectors[:, order], image @ vectors[:, order]
            new = _beyond(new, basis)
    raise ValueError(f"residuals of {residuals.max():.1e} after {most_passes} passes")
