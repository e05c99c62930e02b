"""The order of samples travels with the dosage column; permuted orders are errors in every scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoloom.operators import qc, samples, scan
from phenoloom.plans import pipelines
from phenoloom.sources import readers
from phenoloom.sources.stored import stored

IDS = [f"S{k}" for k in range(40)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = [(k, 1, k * 1000, rng.integers(0, 3, 40).tolist()) for k in range(30)]
    markers = spark.createDataFrame(rows, "marker_id int, chr int, pos bigint, dosage array<tinyint>")
    return samples.with_order(markers, IDS), rng.normal(size=40)


def test_digest_tells_orders_apart():
    assert samples.digest(["a", "b"]) != samples.digest(["b", "a"]) != samples.digest(["ab"]) and samples.digest([1, 2]) == samples.digest(["1", "2"])
    assert samples.digest([]) != samples.digest([""])


def test_order_survives_plans_and_files(spark, data, tmp_path):
    markers, _ = data
    known = samples.digest(IDS)
    kept = qc.maf_filter(markers.where("pos > 0"), 2, 0.01)
    assert samples.order_of(kept) == known
    assert samples.order_of(stored(kept)) == known
    kept.write.parquet(str(tmp_path / "m"))
    again = spark.read.parquet(str(tmp_path / "m"))
    assert samples.order_of(again) == known == samples.order_of(again.join(again.select("marker_id"), "marker_id"))
    assert samples.order_of(markers.withColumn("dosage", F.reverse("dosage"))) is None


@pytest.mark.parametrize("plan", [lambda m, y, ids: pipelines.genome_scan(m, y, n_pcs=0, samples=ids), lambda m, y, ids: pipelines.mixed_scan(m, y, samples=ids), lambda m, y, ids: pipelines.conditional_scan(m, y, samples=ids)], ids=["genome", "mixed", "conditional"])
def test_scans_refuse_another_order(data, plan):
    markers, y = data
    assert plan(markers, y, IDS).count() > 0
    with pytest.raises(ValueError, match="another order"):
        plan(markers, y, IDS[::-1])
    with pytest.raises(ValueError, match="another order"):
        plan(markers, y, IDS[:-1])
    with pytest.raises(ValueError, match="name the samples"):
        plan(markers, y, None)


def test_scan_compares_with_its_basis(data):
    markers, y = data
    with pytest.raises(ValueError, match="another order"):
        scan.scan(markers, scan.covariate_basis(y, samples=[*IDS[1:], IDS[0]]))
    assert scan.scan(markers, scan.covariate_basis(y)).count() == 30


def test_call_rate_filter_says_who_is_left(spark):
    rows = [(k, [None if s == 2 else (k + s) % 3 for s in range(4)]) for k in range(9)]
    markers = samples.with_order(spark.createDataFrame(rows, "marker_id int, dosage array<int>"), list("abcd"))
    out, kept = qc.call_rate_arrays(markers, most_missing=0.3, samples=list("abcd"))
    assert kept == [0, 1, 3] and samples.order_of(out) == samples.digest(list("abd"))
    with pytest.raises(ValueError, match="another order"):
        qc.call_rate_arrays(markers, samples=list("abdc"))


def test_vcf_calls_name_their_samples(spark):
    lines = spark.createDataFrame([("chr1\t5\tr\tA\tG\t.\tPASS\t.\tGT\t0|1\t1|1\t0|0",)], "value string")
    found = readers.genotypes_from_vcf(readers.vcf_records(lines), columns=[2, 0], samples=["a", "b", "c"])
    assert samples.order_of(found) == samples.digest(["c", "a"]) and found.first()["dosage"] == [0, 1]


def test_covariates_are_lined_up_by_id(spark):
    table = spark.createDataFrame([("b", 2.0, "5"), ("a", 1.0, "4"), ("z", 9.0, "9")], "s string, x double, w string")
    assert samples.lined_up(table, ["a", "b"], "s", ["x", "w"]).tolist() == [[1.0, 4.0], [2.0, 5.0]]
    with pytest.raises(ValueError, match="complete row: c"):
        samples.lined_up(table, ["a", "c"], "s", ["x"])
    with pytest.raises(ValueError, match="complete row: a"):
        samples.lined_up(table.union(table), ["a"], "s", ["x"])
    assert samples.lined_up(table, [], "s", ["x", "w"]).shape == (0, 2)
