"""Views of the driver tables as genotypes, phenotypes, maps, loci and results, by exact integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import with_order
from ..sources.stored import path_of, stored

SAMPLES = 300
#: Markers that a task makes the calls of.
TASK_ROWS = 2_000
#: Greatest id whose square times a factor of `below` is a 64-bit number.
MOST_ID = 400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, n: int = SAMPLES) -> DataFrame:
    """(sid, y, pop, y2): customers below n."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") < n).select(F.col("c_custkey").alias("sid"), F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("pop"), F.col("c_nationkey").cast("double").alias("y2"))


def marker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mid, chr, pos, thr): parts as markers on five chromosomes."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mid"), (F.col("p_size") % 5 + 1).cast("int").alias("chr"), (F.col("p_partkey") * 997).alias("pos"), (5 + F.col("p_size") % 46).alias("thr"))


def below(k: int, sid, mid, thr):
    """Whether a sample has the first or second allele at a marker; of columns or of arrays."""
    a, b, c, last = {1: (31, 17, 13, mid), 2: (37, 11, 29, sid)}[k]
    modulus = {1: 101, 2: 103}[k]
    return ((sid * sid * a + mid * mid * b + sid * mid * c + last) % modulus) < thr


def per_sample(markers: DataFrame, ids: list[int], name: str, kind: str, make: Callable) -> DataFrame:
    """markers with a column of what `make(sid, mid, thr, known)` gives for rows of markers by all samples; `known` is false
    for markers without id or threshold.

    A map of markers is a small file, one task or a few, while calls are hundreds a row: rows are dealt to tasks by their
    number first.
    """
    rest, sid = markers.columns, np.array(ids, np.int64)
    if len(ids) and not 0 <= sid.min() <= sid.max() <= MOST_ID:
        raise ValueError(f"sample ids outside 0 to {MOST_ID}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TASK_ROWS):
                part = whole.slice(start, TASK_ROWS)
                columns = [part.column(part.schema.get_field_index(c)) for c in ("mid", "thr")]
                mid, thr = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
                if len(mid) and not 0 <= mid.min() <= mid.max() <= MOST_ID:
                    raise ValueError(f"marker ids outside 0 to {MOST_ID}")
                known = ~(columns[0].is_null().to_numpy(zero_copy_only=False) | columns[1].is_null().to_numpy(zero_copy_only=False))
                made = make(sid[None, :], mid[:, None], thr[:, None], np.broadcast_to(known[:, None], (len(mid), len(sid))))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*rest, name])

    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in markers.schema.fields], f"{name} {kind}"])
    return markers.repartition(markers.count() // TASK_ROWS + 1).mapInArrow(work, fields)


def missing(sid, mid):
    return (sid * 7 + mid * 3) % 17 == 0


#: Genotype tables written by this application, by their arguments.
_written: dict[tuple, tuple] = {}


def genotypes(spark: SparkSession, sf_dir: str, n: int = SAMPLES, ploidy: int = 2, with_missing: bool = False) -> DataFrame:
    """(mid, chr, pos, dosage): marker rows with one array element for each sample. Made once and stored, as genotypes are
    read, not computed, by whatever scans them."""
    key = (spark.sparkContext.applicationId, sf_dir, n, ploidy, with_missing)
    if key not in _written or existing(spark, _written[key][0]) is None:
        made = stored(with_order(_genotypes(spark, sf_dir, n, ploidy, with_missing), sample_ids(spark, sf_dir, n)), "genotypes")
        _written[key] = (path_of(made), made.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def call_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map with `calls`: the samples' calls as a VCF holds them, tabs between; none of sample 5 at every tenth marker."""

    def made(sid: np.ndarray, mid: np.ndarray, thr: np.ndarray, known: np.ndarray) -> pa.Array:
        text = np.empty((len(mid), sid.size, 4), np.uint8)
        text[:, :, :] = np.frombuffer(b"0|0\t", np.uint8)
        text[:, :, 0] += below(1, sid, mid, thr)
        text[:, :, 2] += below(2, sid, mid, thr)
        text[(mid % 10 == 0) & (sid == 5)] = np.frombuffer(b".|.\t", np.uint8)
        # A row ends without a tab.
        lines = [row.tobytes()[:-1].decode() for row in text]
        return pa.array(lines, pa.string(), mask=~known.all(1))

    return per_sample(marker_map(spark, sf_dir), sample_ids(spark, sf_dir), "calls", "string", made)


def existing(spark: SparkSession, path: str) -> str | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def sample_ids(spark: SparkSession, sf_dir: str, n: int = SAMPLES) -> list[int]:
    """Ids in the order of the dosage arrays; at most n numbers."""
    return [r["sid"] for r in samples(spark, sf_dir, n).select("sid").orderBy("sid").collect()]


def _genotypes(spark: SparkSession, sf_dir: str, n: int, ploidy: int, with_missing: bool) -> DataFrame:
    """No join: the sample ids are one list, made on the driver."""

    def made(sid: np.ndarray, mid: np.ndarray, thr: np.ndarray, known: np.ndarray) -> pa.Array:
        g = sum(below(k, sid, mid, thr).astype(np.int8) for k in range(1, ploidy + 1))
        lost = ~known | missing(sid, mid) if with_missing else ~known
        offsets = pa.array(np.arange(len(mid) + 1) * sid.size, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(g.ravel(), pa.int8(), mask=lost.ravel()))

    ids = sample_ids(spark, sf_dir, n)
    return per_sample(marker_map(spark, sf_dir), ids, "dosage", "array<tinyint>", made).select("mid", "chr", "pos", "dosage")


def calls(spark: SparkSession, sf_dir: str, n: int = SAMPLES, ploidy: int = 2, with_missing: bool = False) -> DataFrame:
    """Long calls (mid, chr, pos, sid, y, y2, call)."""
    people = samples(spark, sf_dir, n).select(F.struct("sid", "y", "y2").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("people"))
    g = genotypes(spark, sf_dir, n, ploidy, with_missing)
    zipped = g.crossJoin(F.broadcast(people)).select("mid", "chr", "pos", F.explode(F.arrays_zip("people", "dosage")).alias("x"))
    return zipped.select("mid", "chr", "pos", F.col("x.people.sid").alias("sid"), F.col("x.people.y").alias("y"), F.col("x.people.y2").alias("y2"), F.col("x.dosage").cast("int").alias("call"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus_id, chr, locus_pos): suppliers as planted loci."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("locus_id"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("chr"), (F.col("s_suppkey") * 19777).alias("locus_pos"))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mid, chr, pos, p): a p-like number in (0, 1) with ties for every marker."""
    m = marker_map(spark, sf_dir)
    h = (F.col("mid") * 7919 + F.col("mid") * F.col("mid") * 31) % 1009
    return m.select("mid", "chr", "pos", ((h + 1) * (h + 1) * (h + 1) / F.lit(1.1e9)).alias("p"))


def importance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mid, fold, model, importance) from line items: fold and model by arithmetic."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mid"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.when(F.col("l_linenumber") % 2 == 0, "RF").otherwise("GB").alias("model"), F.col("l_extendedprice").alias("importance"))


# The same views as SQL, for the oracle.
SAMPLES_SQL = f"s as (select c_custkey sid, c_acctbal y, c_mktsegment pop, cast(c_nationkey as double) y2 from customer where c_custkey < {SAMPLES})"
MAP_SQL = "m as (select p_partkey mid, cast(p_size % 5 + 1 as int) chr, p_partkey * 997 pos, 5 + p_size % 46 thr from part)"
A1 = "(case when (sid*sid*31 + mid*mid*17 + sid*mid*13 + mid) % 101 < thr then 1 else 0 end)"
A2 = "(case when (sid*sid*37 + mid*mid*11 + sid*mid*29 + sid) % 103 < thr then 1 else 0 end)"


def calls_sql(ploidy: int = 2, with_missing: bool = False) -> str:
    g = f"{A1} + {A2}" if ploidy == 2 else A1
    if with_missing:
        g = f"case when (sid*7+mid*3)%17=0 then null else {g} end"
    return f"{SAMPLES_SQL}, {MAP_SQL}, g as (select mid, chr, pos, sid, y, y2, {g} call from s cross join m)"


LOCI_SQL = "l as (select s_suppkey locus_id, cast(s_suppkey % 5 + 1 as int) chr, s_suppkey * 19777 locus_pos from supplier)"
P_SQL = f"{MAP_SQL}, h as (select *, (mid * 7919 + mid * mid * 31) % 1009 h from m), p as (select mid, chr, pos, (h+1)*(h+1)*(h+1)/cast(1.1e9 as double) p from h)"
IMPORTANCE_SQL = "i as (select l_partkey mid, cast(l_orderkey % 5 as int) fold, case when l_linenumber % 2 = 0 then 'RF' else 'GB' end model, l_extendedprice importance from lineitem)"
