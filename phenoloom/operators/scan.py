"""Association scans: linear model with covariates, mixed model with kinship, conditional scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import t_two_sided_array
from .samples import require_order


@dataclass(frozen=True)
class Basis:
    """What a scan needs of samples and covariates; its size is samples x covariates, whatever the markers."""

    q: np.ndarray
    residual: np.ndarray
    yss: float
    df: int
    rotate: np.ndarray | None = None
    root: np.ndarray | None = None
    samples: tuple | None = None
    low: np.ndarray | None = None
    gain: np.ndarray | None = None

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Rows over samples as the covariance asks: turned and scaled as a whole, or along a few directions only."""
        if self.rotate is not None:
            return (rows @ self.rotate) * self.root
        return rows if self.low is None else rows + ((rows @ self.low) * self.gain) @ self.low.T


def covariate_basis(y: np.ndarray, covariates: np.ndarray | None = None, samples: list | None = None) -> Basis:
    """Orthonormal basis of [1, covariates], the phenotype's residual, its sum of squares and degrees of freedom; `samples` are the ids in the phenotype's order."""
    y = np.asarray(y, float)
    c = np.ones((len(y), 1)) if covariates is None or not np.size(covariates) else np.column_stack([np.ones(len(y)), covariates])
    if not (np.isfinite(y).all() and np.isfinite(c).all()):
        raise ValueError("phenotype and covariates must be finite")
    q = np.linalg.qr(c)[0]
    residual = y - q @ (q.T @ y)
    return Basis(q, residual, float(residual @ residual), len(y) - c.shape[1] - 1, samples=None if samples is None else tuple(samples))


def scan_block(g: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, t, p) of each row of a markers x samples block, from the partial correlation of marker and phenotype.

    The part of a marker that the covariates do not explain is set against the residual phenotype. A marker without such
    a part (constant, or a mix of covariates) has no estimate: NaN in all three.
    """
    g = np.asarray(g, float)
    if not np.isfinite(g).all():
        raise ValueError("genotypes must be finite; drop or impute missing calls first")
    g = basis.whitened(g)
    free = g - (g @ basis.q) @ basis.q.T
    length = np.linalg.norm(free, axis=1)
    length = np.where(length > 1e-9 * np.maximum(np.linalg.norm(g, axis=1), 1.0), length, np.nan)
    spread = np.sqrt(basis.yss) if basis.yss > 0 else np.nan
    r = np.clip(free @ (basis.residual / spread) / length, -1.0, 1.0)
    with np.errstate(divide="ignore"):
        t = r * np.sqrt(basis.df / ((1.0 - r) * (1.0 + r)))
    known = ~np.isnan(t)
    p = np.full(len(t), np.nan)
    p[known] = t_two_sided_array(t[known], basis.df)
    return r * spread / length, t, p


def require_same_order(ours: list, theirs: list, what: str = "samples") -> None:
    """An error unless both name the same ids in the same order; arrays are aligned by place alone."""
    if list(ours) != list(theirs):
        at = next((k for k, (a, b) in enumerate(zip(ours, theirs, strict=False)) if a != b), min(len(ours), len(theirs)))
        raise ValueError(f"{what} differ from place {at} on: {len(ours)} and {len(theirs)} ids")


def scan(markers: DataFrame, basis: Basis, dosage: str = "dosage", batch: int = 2048, samples: list | None = None) -> DataFrame:
    """markers without their dosage, with beta, t and p (null where a marker has no estimate). One pass, no shuffle; the basis
    is broadcast (samples x covariates). `samples` are the ids in the order of the dosage arrays: they must be the basis's, and
    either must be the order that the dosage column says it has."""
    if samples is not None and basis.samples is not None:
        require_same_order(list(basis.samples), samples)
    require_order(markers, samples if samples is not None else basis.samples, dosage)
    rest = [c for c in markers.columns if c != dosage]
    sent = markers.sparkSession.sparkContext.broadcast(basis)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = sent.value
        n = len(basis.residual)
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                column = part.column(len(rest))
                if (np.diff(np.asarray(column.offsets)) != n).any():
                    raise ValueError(f"a dosage array doesn't have the {n} samples of the phenotype")
                found = scan_block(np.asarray(column.flatten(), float).reshape(part.num_rows, n), basis)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), *(pa.array(x, mask=np.isnan(x)) for x in found)], [*rest, "beta", "t", "p"])

    fields = [T.StructField(c, T.DoubleType()) for c in ("beta", "t", "p")]
    return markers.select(*rest, dosage).mapInArrow(work, T.StructType([*markers.select(*rest).schema.fields, *fields]))


def scan_long(calls: DataFrame, marker: str = "marker_id", g: str = "call", y: str = "y") -> DataFrame:
    """The scan without covariates as one aggregation over long calls: (marker, n, maf, beta, t). Nothing but sums."""
    x = F.col(g).cast("double")
    sums = calls.groupBy(marker).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(F.col(y)).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(x * F.col(y)).alias("sxy"))
    xx, yy, xy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    beta = xy / xx
    out = sums.where(xx > 1e-9).select(marker, "n", (F.col("sx") / (2 * F.col("n"))).alias("f"), beta.alias("beta"), (xy * F.sqrt((F.col("n") - 2) / (xx * (yy - xy * xy / xx)))).alias("t"))
    return out.select(marker, "n", F.least("f", 1 - F.col("f")).alias("maf"), "beta", "t")


def covariate_scan_long(calls: DataFrame, marker: str = "marker_id", g: str = "call", y: str = "y", c: str = "c") -> DataFrame:
    """The scan with one covariate as an aggregation: both sides are freed of [1, c] by their sums alone."""
    x, v, w = F.col(g).cast("double"), F.col(y), F.col(c)
    pairs = {"xx": x * x, "vv": v * v, "ww": w * w, "xv": x * v, "xw": x * w, "vw": v * w, "x": x, "v": v, "w": w}
    s = calls.groupBy(marker).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in pairs.items()])
    centred = lambda a, b: F.col(a + b if a + b in pairs else b + a) - F.col(a) * F.col(b) / F.col("n")
    s = s.select(marker, "n", *[centred(a, b).alias(f"c{a}{b}") for a, b in ("xx", "vv", "ww", "xv", "xw", "vw")])
    own = F.col("cxx") - F.col("cxw") * F.col("cxw") / F.col("cww")
    shared = F.col("cxv") - F.col("cxw") * F.col("cvw") / F.col("cww")
    yss = F.col("cvv") - F.col("cvw") * F.col("cvw") / F.col("cww")
    return s.where(own > 1e-9).select(marker, "n", (shared / own).alias("beta"), (shared * F.sqrt((F.col("n") - 3) / (own * (yss - shared * shared / own)))).alias("t"))


# --- mixed model ---


def _least(negative: Callable[[float], float]) -> float:
    """Where the function of log delta is least in [-10, 10]: the best of a grid, then a golden section around it."""
    grid = np.linspace(-10, 10, 101)
    at = grid[int(np.argmin([negative(x) for x in grid]))]
    low, high = at - 0.2, at + 0.2
    for _ in range(60):
        a, b = high - 0.618033988749895 * (high - low), low + 0.618033988749895 * (high - low)
        low, high = (low, b) if negative(a) < negative(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _with_intercept(n: int, covariates: np.ndarray | None) -> np.ndarray:
    return np.ones((n, 1)) if covariates is None or not np.size(covariates) else np.column_stack([np.ones(n), covariates])


def mixed_basis(y: np.ndarray, kinship: np.ndarray, covariates: np.ndarray | None = None, samples: list | None = None) -> tuple[Basis, float]:
    """Whitened basis with variance ratio delta = var(e)/var(g) by restricted likelihood, estimated once for all markers."""
    y = np.asarray(y, float)
    n = len(y)
    c = _with_intercept(n, covariates)
    values, vectors = np.linalg.eigh((kinship + kinship.T) / 2)
    values = np.maximum(values, 0)
    yr, cr = vectors.T @ y, vectors.T @ c

    def negative(log_delta: float) -> float:
        w = 1 / (values + np.exp(log_delta))
        a = cr.T @ (cr * w[:, None])
        b = np.linalg.solve(a, cr.T @ (w * yr))
        r = yr - cr @ b
        d = n - c.shape[1]
        return 0.5 * (d * np.log((w * r * r).sum() / d) - np.log(w).sum() + np.linalg.slogdet(a)[1])

    delta = _least(negative)
    root = np.sqrt(1 / (values + delta))
    q = np.linalg.qr(cr * root[:, None])[0]
    yw = yr * root
    residual = yw - q @ (q.T @ yw)
    return Basis(q, residual, float(residual @ residual), n - c.shape[1] - 1, vectors, root, None if samples is None else tuple(samples)), delta


def low_rank_basis(y: np.ndarray, vectors: np.ndarray, values: np.ndarray, covariates: np.ndarray | None = None, rest: float = 0.0, delta: float | None = None, samples: list | None = None) -> tuple[Basis, float]:
    """The mixed model's basis for kinship U diag(values) U' + rest (I - U U'), U being samples x rank and orthonormal.

    Nothing of samples x samples is made: the likelihood needs U'[c, y] and the products of [c, y] with itself, and
    whitening changes a marker along U only. At full rank it is `mixed_basis`. delta is searched unless given.
    """
    y = np.asarray(y, float)
    n, r = vectors.shape
    c = _with_intercept(n, covariates)
    d = n - c.shape[1]
    both = np.column_stack([c, y])
    along = vectors.T @ both
    beyond = both.T @ both - along.T @ along

    def negative(log_delta: float) -> float:
        delta = np.exp(log_delta)
        w = 1 / (values + delta)
        products = along.T @ (along * w[:, None]) + beyond / (rest + delta) * (r < n)
        a, b = products[:-1, :-1], products[:-1, -1]
        left = max(products[-1, -1] - b @ np.linalg.solve(a, b), 1e-300)
        return 0.5 * (d * np.log(left / d) - np.log(w).sum() + (n - r) * np.log(rest + delta) + np.linalg.slogdet(a)[1])

    delta = _least(negative) if delta is None else delta
    gain = np.sqrt((rest + delta) / (values + delta)) - 1
    white = both + vectors @ (gain[:, None] * along)
    q = np.linalg.qr(white[:, :-1])[0]
    residual = white[:, -1] - q @ (q.T @ white[:, -1])
    return Basis(q, residual, float(residual @ residual), d - 1, samples=None if samples is None else tuple(samples), low=np.ascontiguousarray(vectors), gain=gain), delta


def conditional_basis(y: np.ndarray, covariates: np.ndarray | None, lead: np.ndarray, samples: list | None = None) -> Basis:
    """The basis with a lead marker's dosage among the covariates."""
    extra = np.asarray(lead, float)[:, None]
    return covariate_basis(y, extra if covariates is None or not np.size(covariates) else np.column_stack([covariates, extra]), samples)


def lead_marker(results: DataFrame, marker: str = "marker_id", p: str = "p") -> DataFrame:
    """The row of the smallest p; ties by id."""
    return results.where(F.col(p).isNotNull()).agg(F.min_by(F.struct(*results.columns), F.struct(p, marker)).alias("x")).select("x.*")
