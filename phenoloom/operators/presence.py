"""Scans of presence markers held sparsely: a row for each sample that carries a marker, none for those that don't.

A dense array for each marker suits common variants; words in texts, rare variants or items in orders are carried by few of
very many samples. For a 0/1 marker the linear scan needs three sums over the carriers and three over all samples, so
nothing of the size samples x markers is made, partial sums can be kept and added, and a marker that a third of the samples
carry is summed in every task before it is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided

#: Words are runs of digits, a-z (A-Z is lowered first) and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Distinct words of a text; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    lower = F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))


def carrier_sums(samples: DataFrame, markers: Column, y: str = "y") -> DataFrame:
    """(marker, n1, s1): carriers and their phenotype sum, from one row a sample with the array of markers that it carries.
    Samples without a phenotype don't count; a marker is listed once in an array."""
    return samples.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("__y"), F.explode(markers).alias("marker")).groupBy("marker").agg(F.count("*").alias("n1"), F.sum("__y").alias("s1"))


def sample_sums(samples: DataFrame, y: str = "y") -> DataFrame:
    """One row (n, s, ss): samples with a phenotype, its sum and its sum of squares."""
    c = F.col(y).cast("double")
    return samples.agg(F.count(c).alias("n"), F.coalesce(F.sum(c), F.lit(0.0)).alias("s"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias("ss"))


def presence_scan(carriers: DataFrame, totals: DataFrame, least: float = 0.01, most: float | None = None) -> DataFrame:
    """(marker, n1, frequency, beta, t, p) of markers with least <= frequency <= most (1 - least) from the two kinds of sums.

    y = a + beta g with g 0 or 1: beta is the covariance over g's variance, t has n - 2 degrees of freedom. A marker that
    all or none carry, or a phenotype without variance, has no beta, t and p. `totals` is one row, joined as such.
    """
    n, n1, s, s1, ss = (F.col(c) for c in ("n", "n1", "s", "s1", "ss"))
    most = 1 - least if most is None else most
    cov, vg, vy = s1 - n1 * s / n, n1 - n1 * n1 / n, ss - s * s / n
    rows = carriers.crossJoin(F.broadcast(totals)).withColumn("frequency", n1 / n).where(F.col("frequency").between(least, most))
    fit = (vg > 0) & (vy > 0) & (n > 2)
    # vg vy - cov^2 is the residual sum of squares times vg: zero if the marker explains all, and then t is infinite.
    rest = F.greatest(vg * vy - cov * cov, F.lit(0.0))
    rows = rows.withColumn("beta", F.when(fit, cov / vg)).withColumn("t", F.when(fit & (rest > 0), cov * F.sqrt((n - 2) / rest)).when(fit, F.signum(cov) * F.lit(float("inf"))))
    return rows.select("marker", "n1", "frequency", "beta", "t", F.when(F.abs("t") == float("inf"), F.lit(0.0)).otherwise(t_two_sided(F.col("t"), n - 2)).alias("p"))
