"""Readers. All but single small metadata files go through Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

import io
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.samples import with_order


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", na: str = "") -> DataFrame:
    """Delimited text with a header, plain or gzip; without a schema all columns are text. Names are trimmed.

    A gzip file is read by one task; write it as Parquet once before more work.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", na)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, na: str = "NA") -> DataFrame:
    return read_csv(spark, path, schema, "\t", na)


def read_blocks(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All files of a folder or pattern, with source_block and, from names like Chr3_block7, chr and block."""
    df = read_csv(spark, path, sep=sep)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return df.withColumn("source_block", name).withColumn("file_chr", F.regexp_extract(name, r"(?i)chr_?(\d+)", 1).try_cast("int")).withColumn("file_block", F.regexp_extract(name, r"(?i)block_?(\d+)", 1).try_cast("int"))


def wide_markers(df: DataFrame, id_column: str, samples: list[str] | None = None) -> DataFrame:
    """One column for each sample to (marker_id, dosage) with the samples in the given order; an absent one is an error."""
    samples = samples or [c for c in df.columns if c != id_column]
    lost = [s for s in samples if s not in df.columns]
    if lost:
        raise ValueError(f"samples without a column: {lost[:5]}")
    return df.select(F.col(id_column).cast("string").alias("marker_id"), F.array(*[F.col(f"`{s}`").cast("tinyint") for s in samples]).alias("dosage"))


def select_markers(df: DataFrame, wanted: list[str], keys: list[str]) -> DataFrame:
    """Key columns and, in the order asked for, those of the wanted marker columns that the table has."""
    there = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *(w for w in wanted if w in there and w not in keys)]])


def mapped_columns(df: DataFrame, mapping: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns by their names in this run: {our name: its name}. A column that is absent is an error, or left out if optional."""
    lost = [theirs for ours, theirs in mapping.items() if theirs not in df.columns and ours not in optional]
    if lost:
        raise ValueError(f"columns that the table does not have: {lost}")
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in mapping.items() if theirs in df.columns])


def labelled_matrix(df: DataFrame) -> DataFrame:
    """A square table with row names in its first column to long (i, j, value)."""
    key, names = df.columns[0], df.columns[1:]
    cells = F.array(*[F.struct(F.lit(n).alias("j"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    return df.select(C.clean_id(f"`{key}`").alias("i"), F.explode(cells).alias("x")).select("i", "x.j", "x.value")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain, gzip or bgzip VCF text: (chrom, pos, id, ref, alt, info, format, calls); header lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return vcf_records(lines)


def vcf_records(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = F.split(column, "\t")
    at = lambda k: F.get(parts, F.lit(k))
    return lines.where(F.size(parts) >= 8).select(F.regexp_replace(at(0), "^chr", "").alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(7).alias("info"), at(8).alias("format"), F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0))).alias("calls"))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample, column) from the #CHROM line."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1)
    names = F.split("value", "\t")
    return head.select(F.posexplode(F.slice(names, 10, F.greatest(F.size(names) - 9, F.lit(0)))).alias("column", "sample")).select("sample", "column")


def info_value(info: str, key: str):
    """One number out of an INFO field; absent, several or non-finite values are null."""
    text = F.regexp_extract(F.concat(F.lit(";"), F.col(info)), rf";{re.escape(key)}=([^;]*)", 1)
    value = text.try_cast("double")
    return F.when(C.is_finite(value), value)


def genotypes_from_vcf(records: DataFrame, columns: list[int] | None = None, low: float = 0.05, annotation: str | None = None, samples: list | None = None) -> DataFrame:
    """Called biallelic SNVs as marker rows. Cheap tests on alleles and annotation come before any call is decoded. `samples`
    are the ids of the calls' columns; dosages then say whose they are."""
    kept = records.where(C.is_biallelic_snv("ref", "alt"))
    if annotation:
        kept = kept.withColumn("__annotated", info_value("info", annotation))
        kept = kept.where(F.when(F.col("__annotated").isNull(), F.raise_error(F.lit("frequency annotation missing")).cast("boolean")).otherwise(F.col("__annotated") >= low - 1e-6))
    calls = C.gather("calls", F.array(*[F.lit(c) for c in columns])) if columns is not None else F.col("calls")
    decoded = kept.select("*", C.once(F.transform(calls, lambda g: C.gt_dosage(g))).alias("dosage")).where(C.all_called("dosage"))
    decoded = decoded.select("*", C.once(C.minor_frequency("dosage", 2)).alias("maf"))
    if annotation:
        same = F.abs(F.col("maf") - F.col("__annotated")) <= 1e-6
        decoded = decoded.withColumn("maf", F.when(same, F.col("maf")).otherwise(F.raise_error(F.lit("frequency annotation disagrees")).cast("double")))
    out = decoded.where(F.col("maf") >= low)
    found = out.select(C.allele_id("chrom", "pos", "ref", "alt").alias("marker_id"), F.col("chrom").try_cast("int").alias("chr"), "pos", "ref", "alt", "maf", F.col("id").alias("rsid"), "dosage")
    ids = samples if samples is None or columns is None else [samples[c] for c in columns]
    return found if ids is None else with_order(found, ids)


def window_records(records: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records of a tabix-like window: start excluded, end included, 1-based."""
    return records.where((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") <= end))


def read_hapmap(spark: SparkSession, path: str, metadata: int = 11) -> DataFrame:
    """HapMap text: (rs, alleles, chr, pos, calls); `N` and empty calls are null."""
    return hapmap_rows(read_csv(spark, path, sep="\t", na="N"), metadata)


def hapmap_rows(df: DataFrame, metadata: int = 11) -> DataFrame:
    taxa = df.columns[metadata:]
    first = df.columns
    return df.select(F.col(f"`{first[0]}`").alias("rs"), F.col(f"`{first[1]}`").alias("alleles"), F.col(f"`{first[2]}`").try_cast("int").alias("chr"), F.col(f"`{first[3]}`").try_cast("bigint").alias("pos"), F.array(*[C.n_to_missing(f"`{t}`") for t in taxa]).alias("calls"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_npy(spark: SparkSession, path: str, name: str = "dosage") -> DataFrame:
    """Arrays of .npy files, rows as (file, row, dosage). Files are read as bytes by Spark, so they may lie in any store."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(data), allow_pickle=False))
                for start in range(0, len(a), 4096):
                    part = a[start : start + 4096].astype(float)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(start, start + len(part))), values], ["file", "row", name])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, f"file string, row bigint, {name} array<double>")


def read_npz(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One named array of .npz files, as read_npy does."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(data), allow_pickle=False)[key]
                rows = [list(map(str, np.atleast_1d(r))) for r in a]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(np.arange(len(rows))), pa.array(rows, pa.list_(pa.string()))], ["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, row bigint, values array<string>")


def read_hdf5_attribute(path: str, name: str, dataset: str | None = None):
    """An attribute of an HDF5 file or of one of its datasets, as Python values. Needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py package") from e

    with h5py.File(path) as f:
        value = (f[dataset] if dataset else f).attrs[name]
        return value.tolist() if hasattr(value, "tolist") else value


def read_hdf5_rows(spark: SparkSession, path: str, dataset: str, rows_per_task: int = 4096, columns: list[int] | None = None) -> DataFrame:
    """(row, dosage) of a two-dimensional HDF5 dataset on a path that all executors share, all its columns or the given ones in
    their order. Needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py package") from e
    import pandas as pd

    with h5py.File(path) as f:
        n = f[dataset].shape[0]

    def work(frames):
        for pdf in frames:
            with h5py.File(path) as f:
                for start in pdf["id"]:
                    a = f[dataset][start : start + rows_per_task]
                    a = a if columns is None else a[:, columns]
                    yield pd.DataFrame({"row": range(start, start + len(a)), "dosage": list(a.astype("int8"))})

    return spark.range(0, n, rows_per_task).mapInPandas(work, "row bigint, dosage array<tinyint>")


def panel(df: DataFrame, population: str, sample: str = "sample", column: str = "super_pop") -> DataFrame:
    """(sample, sample_idx) of one population in the panel's order of names; repeated samples are an error."""
    kept = df.where(F.col(column) == population).select(F.col(sample).alias("sample"))
    counted = kept.groupBy("sample").agg(F.count("*").alias("__n"))
    checked = F.when(F.col("__n") == 1, F.col("sample")).otherwise(F.raise_error(F.concat(F.lit("repeated sample: "), F.col("sample"))))
    return counted.select(checked.alias("sample")).withColumn("sample_idx", F.row_number().over(Window.orderBy("sample")) - 1)


def require_inputs(spark: SparkSession, *paths: str) -> None:
    """An error that names the first path that isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is None or not len(found):
            raise FileNotFoundError(p)
