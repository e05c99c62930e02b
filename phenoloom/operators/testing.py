"""Multiple testing and ranking: Bonferroni, Benjamini-Hochberg without a single-task sort, genomic inflation, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import array_literal
from ..functions.distributions import CHI2_1_MEDIAN, chi2_1_isf
from ..sources.stored import stored
from .numbering import numbered


def bonferroni(df: DataFrame, p: str = "p", out: str = "bonferroni") -> DataFrame:
    """min(p m, 1) with m the rows that have a p; m is one aggregated number, joined as a one-row side."""
    m = df.agg(F.count(p).alias("__m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.least(F.col(p) * F.col("__m"), F.lit(1.0))).drop("__m")


def counts_before(df: DataFrame, value: str, bins: int = 4096, by: list[str] | None = None) -> DataFrame:
    """(by..., v, n, bin, before, total): every distinct value with its rows, the rows with a smaller one, and all rows.

    Nothing is sorted as a whole. Rows with equal values are counted together; values are cut into bins at quantiles; sums
    over bins, a table of `bins` rows for each group, are windowed alone, and rows are windowed inside their bins.
    Counts are read for bounds, for sums and for places, so they are made once and stored.
    """
    by = by or []
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), "value-counts")
    bounds = counts.agg(F.percentile_approx("v", array_literal([k / bins for k in range(1, bins)], "double"), 10 * bins)).first()[0] or []
    counts = _binned(counts, sorted({float(b) for b in bounds}))
    over_bins = Window.partitionBy(*by).orderBy("bin")
    earlier, all_ = over_bins.rowsBetween(Window.unboundedPreceding, -1), over_bins.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_bin = counts.groupBy(*by, "bin").agg(F.sum("n").alias("__n"))
    sums = per_bin.select(*by, "bin", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(all_).alias("total"))
    inside = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(sums if by else F.broadcast(sums), [*by, "bin"])
    return joined.select(*by, "v", "n", "bin", (F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total")


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "q", bins: int = 4096) -> DataFrame:
    """q = min over p' >= p of p' m / rank(p'), at most 1. Null p stays null; equal p get equal q.

    Ranks come from `counts_before`; suffix minima are taken inside bins and then over the table of bins. The cost is that
    of one aggregation, one join and one sort spread over the bins.
    """
    raw = counts_before(df, p, bins).withColumn("__raw", F.col("v") * F.col("total") / (F.col("before") + F.col("n")))
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(0, Window.unboundedFollowing)
    raw = raw.withColumn("__suffix", F.min("__raw").over(inside))
    after = raw.groupBy("bin").agg(F.min("__raw").alias("__low")).select("bin", F.min("__low").over(Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    final = raw.join(F.broadcast(after), "bin").select(F.col("v").alias("__p"), F.least("__suffix", F.coalesce("__later", "__suffix"), F.lit(1.0)).alias(out))
    return df.join(final, F.col(p) == F.col("__p"), "left").drop("__p")


def _binned(counts: DataFrame, bounds: list[float]) -> DataFrame:
    """counts with `bin`, the number of bounds below v, by a search in the sorted array."""
    if not bounds:
        return counts.withColumn("bin", F.lit(0))
    at, names, ends = counts.columns.index("v"), counts.columns, np.array(bounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(ends, batch.column(at).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*names, "bin"])

    return counts.mapInArrow(work, counts.withColumn("bin", F.lit(0)).schema)


def corrected(df: DataFrame, p: str = "p") -> DataFrame:
    """df with q and bonferroni. Rows are counted in df itself, not in what the ranks made of it."""
    return benjamini_hochberg(bonferroni(df, p), p).select(*df.columns, "q", "bonferroni")


def genomic_inflation(df: DataFrame, p: str = "p", floor: float | None = 1e-300) -> DataFrame:
    """lambda_gc: median of chi squared over its expected median. The transform is monotone, so only the two central p
    values are transformed."""
    use = df.where(F.col(p).isNotNull() & (F.col(p) <= 1) & (F.col(p) >= 0 if floor is not None else F.col(p) > 0)).select((F.greatest(F.col(p), F.lit(floor)) if floor is not None else F.col(p)).alias("p"))
    # The lower and the upper middle value: with an even count these two are averaged after the transform.
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    middle = counts_before(use, "p").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    return middle.select(((chi2_1_isf(F.col("a")) + chi2_1_isf(F.col("b"))) / 2 / CHI2_1_MEDIAN).alias("lambda_gc"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., probability, quantile): exact linear-interpolated quantiles by counted places, so no task holds all values of a group."""
    by = by or []
    ranked = counts_before(df, value, by=by)
    place = F.col("probability") * (F.col("total") - 1)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    rows = ranked.withColumn("probability", F.explode(array_literal(probabilities, "double"))).where(holds(F.floor(place)) | holds(F.ceil(place)))
    low, high = F.max(F.when(holds(F.floor(place)), F.col("v"))), F.max(F.when(holds(F.ceil(place)), F.col("v")))
    found = rows.groupBy(*by, "probability", "total").agg(low.alias("__a"), high.alias("__b"))
    return found.select(*by, "probability", (F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place))).alias("quantile"))


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in the order: kept by every task before anything is moved."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, n: int, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """The first n rows of each group; tasks keep n a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def min_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """1, 1, 3 ranks from high to low: one more than the rows with a greater score. Null scores have no rank."""
    ranks = counts_before(df, score).select(F.col("v").alias("__s"), (F.col("total") - F.col("before") - F.col("n") + 1).cast("bigint").alias(out))
    return df.join(ranks, F.col(score).cast("double") == F.col("__s"), "left").drop("__s")


def sequence_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1..n by the first column of the order, high to low, then by the others. Rows without the first have no rank and go."""
    return numbered(df.where(order[0].isNotNull()), [order[0].desc(), *order[1:]], out)


def replicate(df: DataFrame, chromosome: int, lo: int, hi: int, p: str = "p", alpha: float = 0.05, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """Markers of a region in a second scan, `significant` by Bonferroni over the region alone."""
    region = df.where((F.col(chr_) == chromosome) & F.col(pos).between(lo, hi))
    return bonferroni(region, p).withColumn("significant", F.col("bonferroni") < alpha)


def summary(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """One row: n_markers, bonferroni_p, n_bonferroni_significant, n_bh_fdr."""
    q = benjamini_hochberg(df.select(p), p)
    m = F.count(p)
    return q.agg(m.alias("n_markers"), (alpha / m).alias("bonferroni_p"), F.count_if(F.col("q") < alpha).alias("n_bh_fdr"), F.min(p).alias("best_p"))
