"""Readers and writers on files made here."""

import numpy as np
import pytest
from phenoloom.functions import columns as C
from phenoloom.sources import readers, sinks
from phenoloom.streaming import ingest
from pyspark.sql import functions as F

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
chr1\t100\trs1\tA\tG\t.\tPASS\tAF=0.5;MAF_X=0.5\tGT\t0|1\t1|1\t0|0
chr1\t200\trs2\tA\tGT\t.\tPASS\tMAF_X=0.2\tGT\t0|1\t1|1\t0|0
chr2\t300\trs3\tC\tT\t.\tPASS\tMAF_X=0.1666666667\tGT:DP\t0/1:3\t0/0:2\t0|0:1
chr2\t400\trs4\tC\tT\t.\tPASS\tMAF_X=0.4\tGT\t.|.\t0/0\t0|1
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    path = str(tmp_path / "a.vcf")
    found = {r["rsid"]: r for r in readers.genotypes_from_vcf(readers.read_vcf(spark, path), annotation="MAF_X").collect()}
    assert set(found) == {"rs1", "rs3"} and found["rs1"]["dosage"] == [1, 2, 0] and found["rs1"]["marker_id"] == "chr1_100_A_G"
    assert [r["sample"] for r in readers.vcf_samples(spark, path).orderBy("column").collect()] == ["S1", "S2", "S3"]
    window = readers.window_records(readers.read_vcf(spark, path), "2", 300, 400)
    assert [r["pos"] for r in window.collect()] == [400]
    with pytest.raises(Exception, match="disagrees"):
        readers.genotypes_from_vcf(readers.read_vcf(spark, path).withColumn("info", F.lit("MAF_X=0.3")), annotation="MAF_X").collect()


def test_delimited_and_wide(spark, tmp_path):
    (tmp_path / "Chr2_block7.csv").write_text("Marker ,s1,s2\nm1,0,1\nm2,1,1\n")
    df = readers.read_blocks(spark, str(tmp_path))
    assert df.columns[0] == "Marker" and df.first()["file_block"] == 7 and df.first()["file_chr"] == 2
    wide = readers.wide_markers(df.select("Marker", "s1", "s2"), "Marker", ["s2", "s1"])
    assert {r["marker_id"]: r["dosage"] for r in wide.collect()} == {"m1": [1, 0], "m2": [1, 1]}
    with pytest.raises(ValueError):
        readers.wide_markers(df, "Marker", ["s9"])
    with pytest.raises(FileNotFoundError):
        readers.require_inputs(spark, str(tmp_path / "nothing*"))


def test_hapmap_and_matrix(spark, tmp_path):
    head = "rs alleles chrom pos strand assembly center protLSID assayLSID panel QCcode T1 T2 T3".replace(" ", "\t")
    (tmp_path / "h.txt").write_text(head + "\nr1\tA/C\t1\t5\t+\t.\t.\t.\t.\t.\t.\tA\tN\tC\n")
    row = readers.read_hapmap(spark, str(tmp_path / "h.txt")).withColumn("d", F.transform("calls", lambda c: C.allele_dosage(c, F.col("alleles")))).first()
    assert row["calls"] == ["A", None, "C"] and row["d"] == [0, None, 2] and row["pos"] == 5
    (tmp_path / "k.csv").write_text("id,a,b\na,1.0,0.5\nb,0.5,1.0\n")
    assert readers.labelled_matrix(readers.read_csv(spark, str(tmp_path / "k.csv"))).count() == 4


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.int8).reshape(2, 3))
    np.savez(tmp_path / "x.npz", taxa=np.array(["a", "b"]))
    assert [r["dosage"] for r in readers.read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert [r["values"] for r in readers.read_npz(spark, str(tmp_path / "x.npz"), "taxa").orderBy("row").collect()] == [["a"], ["b"]]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 0, 5, [0, 1])], "marker_id string, chr int, block int, pos bigint, dosage array<tinyint>")
    out = str(tmp_path / "m")
    sinks.write_markers(m, out)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_markers(m, out)
    assert spark.read.parquet(out).count() == 1
    for _ in range(2):
        sinks.append_run(spark.createDataFrame([(1, 0.5)], "seed int, r2 double"), str(tmp_path / "runs"), ["seed"])
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    sinks.write_text(m, str(tmp_path / "t"), gzip=True)
    sinks.write_report({"n": 1}, spark, str(tmp_path / "r"))
    sinks.write_json(m, str(tmp_path / "j"))
    assert readers.read_manifest(spark, str(tmp_path / "j")).count() == 1
    sinks.remove(spark, out)


def test_panel_rejects_repeats(spark):
    df = spark.createDataFrame([("a", "EUR"), ("b", "EUR"), ("c", "AFR")], "sample string, super_pop string")
    assert [r["sample"] for r in readers.panel(df, "EUR").orderBy("sample_idx").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="repeated sample"):
        readers.panel(df.union(df), "EUR").collect()


def test_stream_of_blocks(spark, tmp_path):
    from phenoloom.operators.scan import covariate_basis

    rng = np.random.default_rng(0)
    rows = [(str(i), 1, i, [int(v) for v in rng.integers(0, 3, 30)]) for i in range(20)]
    m = spark.createDataFrame(rows, "marker_id string, chr int, pos bigint, dosage array<tinyint>")
    m.write.parquet(str(tmp_path / "in"))
    stream = ingest.marker_stream(spark, str(tmp_path / "in"), m.schema)
    ingest.scan_stream(stream, covariate_basis(rng.normal(size=30)), 0.01, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
