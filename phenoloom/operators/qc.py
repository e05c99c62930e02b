"""Marker and sample quality control on marker rows (one dosage array each) or on long calls (marker, sample, call)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.stored import stored
from .numbering import numbered
from .samples import require_order, with_order


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the given order (`dropDuplicates` keeps an arbitrary one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def clean_phenotype(raw: DataFrame, sample: str, value: str, order: str) -> DataFrame:
    """(sample_id, y): normalised ids, numeric values, no nulls, the first row of each id in file order."""
    typed = raw.select(C.clean_id(sample).alias("sample_id"), C.number_or_null(value).alias("y"), F.col(order).alias("__order"))
    return keep_first(typed.where("sample_id is not null and y is not null"), ["sample_id"], [F.col("__order")]).drop("__order")


def maf_filter(markers: DataFrame, ploidy: int, low: float, high: float = 0.5, dosage: str = "dosage") -> DataFrame:
    """Adds maf and keeps low <= maf <= high."""
    rest = [c for c in markers.columns if c != "maf"]
    return markers.select(*rest, C.once(C.minor_frequency(dosage, ploidy)).alias("maf")).where((F.col("maf") >= low) & (F.col("maf") <= high))


def check_annotated_maf(markers: DataFrame, annotated: str, low: float, slack: float = 1e-6, dosage: str = "dosage", ploidy: int = 2) -> DataFrame:
    """Cheap prefilter on the annotation, then the annotation must agree with the genotypes or the query fails."""
    kept = markers.where(F.col(annotated) >= low - slack).withColumn("maf", C.minor_frequency(dosage, ploidy))
    agrees = F.abs(F.col("maf") - F.col(annotated)) <= slack
    checked = F.when(agrees, F.col("maf")).otherwise(F.raise_error(F.concat(F.lit("annotated frequency disagrees: "), F.col(annotated).cast("string"))).cast("double"))
    return kept.withColumn("maf", checked).where(F.col("maf") >= low)


def missing_by(calls: DataFrame, by: str, call: str = "call") -> DataFrame:
    """(by, n, n_missing, missing_fraction) of long calls."""
    missing = F.sum(F.col(call).isNull().cast("bigint"))
    return calls.groupBy(by).agg(F.count("*").alias("n"), missing.alias("n_missing"), (missing / F.count("*")).alias("missing_fraction"))


def call_rate_filter(calls: DataFrame, marker: str = "marker_id", sample: str = "sample_id", call: str = "call", most_missing: float = 0.2) -> DataFrame:
    """Calls of markers and samples with at most that share missing, both shares taken on the unfiltered table."""
    markers = missing_by(calls, marker, call).where(F.col("missing_fraction") <= most_missing).select(marker)
    samples = missing_by(calls, sample, call).where(F.col("missing_fraction") <= most_missing).select(sample)
    return calls.join(markers, marker, "left_semi").join(samples, sample, "left_semi")


def call_rate_arrays(markers: DataFrame, dosage: str = "dosage", most_missing: float = 0.2, samples: list | None = None) -> tuple[DataFrame, list[int]]:
    """(markers whose arrays hold the kept samples only, places of the kept samples); both shares on the unfiltered table.

    A marker's share is read off its array. Samples' missing calls are summed over arrays in every task, so what is shuffled
    is one number a task and sample. A table without markers keeps no sample. With the `samples` of the arrays, the arrays
    that are left say theirs.
    """
    require_order(markers, samples, dosage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                lost = batch.column(0).flatten().is_null().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(0)
                total, n = lost if total is None else total + lost, n + batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["missing", "n"])

    parts = markers.select(dosage).mapInArrow(work, "missing array<bigint>, n bigint")
    sums = parts.select("n", F.posexplode("missing").alias("place", "missing")).groupBy("place").agg((F.sum("missing") / F.sum("n")).alias("share"))
    kept = sorted(r["place"] for r in sums.where(F.col("share") <= most_missing).collect())
    rest = [c for c in markers.columns if c != dosage]
    # once(): gather reads the array at every kept place, and an expression inlined there would be computed that often.
    markers = markers.select(*rest, C.once(F.col(dosage)).alias(dosage))
    out = markers.where(C.missing_fraction(dosage) <= most_missing).select(*rest, C.gather(dosage, C.array_literal(kept, "int")).alias(dosage))
    return out if samples is None else with_order(out, [samples[k] for k in kept], dosage), kept


def impute_mean(calls: DataFrame, marker: str = "marker_id", call: str = "call") -> DataFrame:
    """Adds `imputed`: the call, or the marker's mean over called samples."""
    return calls.withColumn("imputed", F.coalesce(F.col(call).cast("double"), F.avg(call).over(Window.partitionBy(marker))))


def thin_every(markers: DataFrame, n: int, block: list[str], order: list[str]) -> DataFrame:
    """Rows 0, n, 2n, ... of every block, which may be of any size."""
    return numbered(markers, [F.asc(c) for c in order], "__i", block).where(F.pmod(F.col("__i") - 1, F.lit(n)) == 0).drop("__i")


def thin_by_distance(markers: DataFrame, spacing: int, chr_: str = "chr", pos: str = "pos", cells: int = 64) -> DataFrame:
    """(chr, pos) kept greedily from the left: the first, then each at least `spacing` after the last kept.

    Whether a position is kept depends on all before it, so a window can't say it. Chromosomes are cut into stretches of
    `cells` spacings, and each stretch is walked once for every place of its first spacing at which the walk can come in:
    that gives the place at which it leaves. A walk over stretches, a few for each chromosome, then finds where each is
    entered, and the stretches are walked for good. So no task holds more positions than a stretch has.
    """
    rows = markers.select(chr_, F.col(pos).cast("bigint").alias("__pos")).distinct()
    packed = stored(rows.groupBy(chr_, F.floor(F.col("__pos") / (spacing * cells)).alias("__cell")).agg(F.array_sort(F.collect_list("__pos")).alias("__p")), "stretches")
    schema = packed.schema
    chr_type = schema[chr_].dataType.simpleString()

    def walk(p: np.ndarray, at: int) -> list[int]:
        """Positions kept from the first one at or after `at` on."""
        out, k = [], int(np.searchsorted(p, at))
        while k < len(p):
            out.append(int(p[k]))
            k = int(np.searchsorted(p, p[k] + spacing))
        return out

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = np.asarray(batch.column(2)[k].values)
                # The walk comes in at a position of the first spacing, or at the first position beyond.
                first = p[: int(np.searchsorted(p, p[0] + spacing)) + 1]
                last = [walk(p, int(x))[-1] for x in first]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([last], pa.list_(pa.int64()))], [chr_, "__cell", "first", "last"])

    ends = packed.mapInArrow(leaves, f"{chr_} {chr_type}, __cell bigint, first array<bigint>, last array<bigint>")

    def step(acc, s):
        # The least position of the stretch that is far enough from the last one kept; null if none of the first ones is.
        entry = F.array_min(F.filter(s["first"], lambda x: acc["last"].isNull() | (x >= acc["last"] + spacing)))
        left = F.element_at(s["last"], F.array_position(s["first"], entry).cast("int"))
        return F.struct(F.coalesce(left, acc["last"]).alias("last"), F.concat(acc["entries"], F.array(F.struct(s["__cell"].alias("cell"), entry.alias("entry")))).alias("entries"))

    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<cell:bigint,entry:bigint>>").alias("entries"))
    order = ends.groupBy(chr_).agg(F.array_sort(F.collect_list(F.struct("__cell", "first", "last"))).alias("s"))
    entries = order.select(chr_, F.explode(F.aggregate("s", start, step)["entries"]).alias("e")).select(chr_, F.col("e.cell").alias("__cell"), F.col("e.entry").alias("__entry"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = walk(np.asarray(batch.column(2)[k].values), batch.column(3)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.array(found, pa.int64())], [chr_, pos])

    return packed.join(entries.where("__entry is not null"), [chr_, "__cell"]).select(chr_, "__cell", "__p", "__entry").mapInArrow(kept, f"{chr_} {chr_type}, {pos} bigint")


def fixed_blocks(markers: DataFrame, size: int, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """Adds local_row, block and chr_rows: rows of a chromosome in position order, cut at every `size`, and how many it has."""
    rows = numbered(markers, [F.asc(pos)], "local_row", [chr_], "chr_rows")
    return rows.withColumn("local_row", F.col("local_row") - 1).withColumn("block", F.floor(F.col("local_row") / size).cast("bigint"))


def equal_blocks(index, total, blocks):
    """Block of a row when m rows are cut into b blocks at floor(k m / b)."""
    i, m, b = C.col(index), C.col(total), C.col(blocks)
    guess = F.floor((i + 1) * b / m).cast("bigint")
    at = lambda k: F.floor(k * m / b)
    return F.when(at(guess) > i, guess - 1).when(at(guess + 1) <= i, guess + 1).otherwise(guess)


def global_index(markers: DataFrame, chr_: str = "chr", pos: str = "pos", tie: str = "marker_id") -> DataFrame:
    """Adds global_idx: rows of smaller chromosomes come first, then by position. Ranges are sorted, never the whole."""
    return numbered(markers, [F.asc(chr_), F.asc(pos), F.asc(tie)], "global_idx").withColumn("global_idx", F.col("global_idx") - 1)


def transpose(calls: DataFrame, row: str, column_order: str, value: str) -> DataFrame:
    """Long calls to one array for each row, elements in column order."""
    return calls.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(column_order, value))), lambda x: x[value]).alias("values"))


def to_long(markers: DataFrame, dosage: str = "dosage") -> DataFrame:
    """Marker rows to (…, sample_idx, call)."""
    rest = [c for c in markers.columns if c != dosage]
    return markers.select(*rest, F.posexplode(dosage).alias("sample_idx", "call"))


def value_counts(df: DataFrame, by: str, nulls_of: str, finite_of: str) -> DataFrame:
    """(by, n, nulls, finite): rows of every value, null included, with the null and the finite values of two other columns."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(nulls_of).isNull()).alias("nulls"), F.count_if(C.is_finite(finite_of)).alias("finite"))


def filled_blocks(blocks: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with at least one surviving marker; the others are skipped, not fitted on nothing."""
    return blocks.join(survivors.select(*keys).distinct(), keys, "left_semi")


def require(df: DataFrame, least: int, what: str) -> DataFrame:
    """df, after it has been made sure that it has so many rows."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"{what}: {found} rows, at least {least} are needed")
    return df


def pending_blocks(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned units without a result, for a run that goes on."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")
