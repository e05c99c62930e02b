"""Column expressions: identifiers, coercion, genotype calls and marker statistics. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_literal(values, kind: str) -> Column:
    """A constant array of numbers as one literal, however long (an array of literals costs a call for each)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


# --- identifiers and coercion ---


def clean_id(c: ColumnLike) -> Column:
    """Identifier as text: trimmed, a trailing `.0` of numeric ids taken off."""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")


def number_or_null(c: ColumnLike) -> Column:
    """Number, or null where the text is none."""
    x = F.trim(col(c).cast("string"))
    return x.try_cast("double")


def number_strict(c: ColumnLike) -> Column:
    """Number; text that is none raises when read."""
    return F.when(col(c).isNull(), F.lit(None)).otherwise(F.coalesce(number_or_null(c), F.raise_error(F.concat(F.lit("not a number: "), col(c).cast("string"))).cast("double")))


def is_finite(c: ColumnLike) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """Held to [low, high]; NaN and null stay what they are."""
    x = col(c)
    return F.when(F.isnan(x), x).when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def marker_label(chr_: ColumnLike, index: ColumnLike) -> Column:
    return F.format_string("Chr%d_sim_%07d", col(chr_), col(index))


def short_id(chr_: ColumnLike, pos: ColumnLike) -> Column:
    return F.concat(F.lit("Chr"), col(chr_).cast("string"), F.lit("_"), col(pos).cast("string"))


def allele_id(chr_: ColumnLike, pos: ColumnLike, ref: ColumnLike, alt: ColumnLike) -> Column:
    return F.concat_ws("_", F.concat(F.lit("chr"), col(chr_).cast("string")), col(pos).cast("string"), F.coalesce(col(ref), F.lit("")), F.coalesce(col(alt), F.lit("")))


def id_part(c: ColumnLike, part: str) -> Column:
    """chr or pos out of `Chr3_123` or `chr3_123_A_G`."""
    group = {"chr": 1, "pos": 2}[part]
    return F.regexp_extract(col(c), r"^[Cc]hr(\d+)_(\d+)", group).try_cast("bigint")


def with_key(df: DataFrame, key: str, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """df with its join key; one is made of chromosome and position only where the table has none."""
    return df if key in df.columns else df.withColumn(key, short_id(chr_, pos))


def spread_position(index: ColumnLike, length: ColumnLike, markers: ColumnLike) -> Column:
    """Position of the index-th of so many markers spread over a chromosome, from 1."""
    return (F.floor((col(index) + 0.5) * col(length) / col(markers)) + 1).cast("bigint")


def sample_label(index: ColumnLike) -> Column:
    return F.format_string("SYN%04d", col(index))


# --- genotype calls ---


def is_biallelic_snv(ref: ColumnLike, alt: ColumnLike) -> Column:
    return col(ref).rlike("^[ACGT]$") & col(alt).rlike("^[ACGT]$")


def gt_dosage(gt: ColumnLike) -> Column:
    """Alternate alleles of a diploid call 0|1, 1/1, ... (the first colon part); null if not called or not 0/1."""
    call = F.split(col(gt), ":")[0]
    other = F.when(call.rlike(r"^[01][|/][01]$"), (F.substring(call, 1, 1).cast("tinyint") + F.substring(call, 3, 1).cast("tinyint")).cast("tinyint"))
    # Bare calls, nearly all there are, are compared, not taken apart.
    plain = F.when(col(gt).isin("0|0", "0/0"), F.lit(0)).when(col(gt).isin("0|1", "1|0", "0/1", "1/0"), F.lit(1)).when(col(gt).isin("1|1", "1/1"), F.lit(2))
    return F.coalesce(plain.cast("tinyint"), other)


def allele_dosage(call: ColumnLike, alleles: ColumnLike) -> Column:
    """0 for the first and 2 for the second allele of "A/B"; anything else is missing."""
    parts = F.split(col(alleles), "/")
    return F.when(col(call) == parts[0], F.lit(0)).when(col(call) == F.try_element_at(parts, F.lit(2)), F.lit(2)).cast("tinyint")


def missing_to_n(call: ColumnLike) -> Column:
    return F.coalesce(col(call), F.lit("N"))


def n_to_missing(call: ColumnLike) -> Column:
    return F.nullif(F.nullif(col(call), F.lit("N")), F.lit(""))


# --- one marker's dosage array ---


def all_called(dosage: ColumnLike) -> Column:
    return F.forall(col(dosage), lambda x: x.isNotNull())


def n_called(dosage: ColumnLike) -> Column:
    return F.size(F.filter(col(dosage), lambda x: x.isNotNull()))


def dosage_sum(dosage: ColumnLike) -> Column:
    return F.aggregate(col(dosage), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("bigint"))


def _frequency(dosage: ColumnLike, finish) -> Column:
    """One pass over the array for called samples and their alleles."""
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0)).cast("bigint")).alias("s"), (a["n"] + x.isNotNull().cast("bigint")).alias("n"))
    return F.aggregate(col(dosage), start, step, finish)


def allele_frequency(dosage: ColumnLike, ploidy: int) -> Column:
    """Mean over called samples divided by ploidy; null where nothing is called."""
    return _frequency(dosage, lambda a: F.when(a["n"] > 0, a["s"] / (a["n"] * ploidy)))


def minor_frequency(dosage: ColumnLike, ploidy: int) -> Column:
    return _frequency(dosage, lambda a: F.when(a["n"] > 0, F.least(a["s"] / (a["n"] * ploidy), 1 - a["s"] / (a["n"] * ploidy))))


def once(expression: Column) -> Column:
    """For a select list: the value as a column of its own that later filters and columns read, not compute again."""
    return F.explode(F.array(expression))


def missing_fraction(dosage: ColumnLike) -> Column:
    return 1 - n_called(dosage) / F.size(col(dosage))


def is_polymorphic(calls: ColumnLike) -> Column:
    return F.size(F.array_distinct(F.filter(col(calls), lambda x: x.isNotNull()))) >= 2


def mean_imputed(dosage: ColumnLike) -> Column:
    """Missing calls replaced by the marker's mean over called ones."""
    n = n_called(dosage)
    mean = F.when(n > 0, dosage_sum(dosage) / n)
    # The mean is bound once; inside the inner function it would be computed for every missing call.
    return F.transform(F.array(mean), lambda m: F.transform(col(dosage), lambda x: F.coalesce(x.cast("double"), m)))[0]


def gather(dosage: ColumnLike, places: ColumnLike) -> Column:
    """Array elements at 0-based places, in their order."""
    return F.transform(col(places), lambda i: F.get(col(dosage), i))


def interval_distance(pos: ColumnLike, lo: ColumnLike, hi: ColumnLike) -> Column:
    """0 inside the closed interval, else the distance to its nearer end."""
    return F.greatest(col(lo) - col(pos), col(pos) - col(hi), F.lit(0))
