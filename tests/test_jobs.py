"""Both jobs: their SQL, reruns, growing input, odd rows, and a run that breaks off."""

import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from jobs import association_report, queries, text_association
from jobs.common import exists, read_config
from phenoloom.operators import joins, presence

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows_as_sql(spark, small, name):
    before = dict(spark.conf.getAll)
    assert compare(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) == ""
    assert dict(spark.conf.getAll) == before


def rows(df):
    return sorted(map(str, df.collect()))


# --- report ---


def test_report_tables(spark, small, tmp_path):
    config = read_config("association_report")
    found = association_report.run(spark, small, str(tmp_path), config)
    first = {t: rows(spark.read.parquet(f"{tmp_path}/{t}")) for t in ("associations", "loci")} | {"summary": rows(spark.read.json(f"{tmp_path}/summary"))}
    assert sorted(p for p in os.listdir(f"{tmp_path}/associations") if "=" in p) == [f"chr={k}" for k in range(1, 6)]
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert summary["n_markers"] == found.count() and summary["n_fdr"] == found.where("significant").count() > 0 and summary["lambda_gc"] > 0
    hits = found.where("significant").toPandas()
    for r in spark.read.parquet(f"{tmp_path}/loci").collect():
        near = hits[(hits.chr == r["chr"]) & ((hits.pos - r["locus_pos"]).abs() <= config["window"])]
        assert r["n_significant"] == len(near) and (not len(near) or r["best_p"] == near.p.min())
    association_report.run(spark, small, str(tmp_path), config)
    assert first == {t: rows(spark.read.parquet(f"{tmp_path}/{t}")) for t in ("associations", "loci")} | {"summary": rows(spark.read.json(f"{tmp_path}/summary"))}


def test_report_cleans_rows(spark, tmp_path):
    tables = tmp_path / "in"
    spark.createDataFrame([("1.0", " 7.0", "0.01", 2), ("1", "7", "0.5", 3), ("1", "7", "0.3", 1), ("2", "7", "0", 1), ("2", "8", "NA", 1), ("2", "8", "nan", 2), ("2", "9", "4", 1), ("2", None, "0.1", 1)], "block string, marker string, p string, o int").write.parquet(f"{tables}/r.parquet")
    spark.createDataFrame([(7, 1, 50), (8, 1, 60), (9, 2, 70)], "m int, c int, x int").write.parquet(f"{tables}/m.parquet")
    spark.createDataFrame([(1, 1, 5)], "l int, c int, x int").write.parquet(f"{tables}/l.parquet")
    config = {"results": {"table": "r", "block": "block", "marker": "marker", "p": "p", "order": ["o"]}, "map": {"table": "m", "marker": "m", "chr": "c", "pos": "x"}, "loci": {"table": "l", "locus": "l", "chr": "c", "pos": "x"}, "alpha": 0.05, "window": 100, "tiny": 1e-300}
    found = association_report.run(spark, str(tables), str(tmp_path / "out"), config)
    assert sorted((r["block"], r["marker"], r["chr"], r["p"]) for r in found.collect()) == [("1", "7", 1, 0.3), ("2", "7", 1, 1e-300), ("2", "9", 2, 1.0)]
    spark.createDataFrame([(7, 1, 50)], "m int, c int, x int").write.mode("overwrite").parquet(f"{tables}/m.parquet")
    with pytest.raises(ValueError, match="markers without a match: 9"):
        association_report.run(spark, str(tables), str(tmp_path / "out"), config)


# --- texts that arrive ---


@pytest.fixture
def growing(spark, small, tmp_path):
    """A copy of the tables, with the documents in a folder that has a third of them, and a function that adds a third."""
    docs = spark.read.parquet(f"{small}/documents.parquet").repartitionByRange(3, "doc_id").cache()
    (tmp_path / "in").mkdir()
    shutil.copy(f"{small}/labels.parquet", tmp_path / "in/labels.parquet")

    def add(k):
        docs.where(F.spark_partition_id() == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/documents.parquet")

    add(0)
    return str(tmp_path / "in"), add


def test_growing_input(spark, growing, tmp_path):
    tables, add = growing
    config = read_config("text_association")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    one = rows(text_association.run(spark, tables, out, checkpoint, config))
    add(1)
    two = rows(text_association.run(spark, tables, out, checkpoint, config))
    assert one != two
    totals = {r["batch"]: r["n"] for r in spark.read.parquet(f"{out}/totals").collect()}
    add(2)
    text_association.run(spark, tables, out, checkpoint, config)
    later = {r["batch"]: r["n"] for r in spark.read.parquet(f"{out}/totals").collect()}
    assert len(totals) == 2 and len(later) == 3 and all(later[b] == n for b, n in totals.items())
    assert rows(text_association.run(spark, tables, out, checkpoint, config)) == rows(text_association.run(spark, tables, f"{tmp_path}/out2", f"{tmp_path}/checkpoint2", config))
    assert len(spark.read.parquet(f"{out}/totals").collect()) == 3


def test_a_batch_that_broke_off_is_taken_again(spark, growing, tmp_path, monkeypatch):
    tables, _ = growing
    config = read_config("text_association")
    whole = presence.sample_sums

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(presence, "sample_sums", fails)
    with pytest.raises(Exception, match="lost"):
        text_association.run(spark, tables, f"{tmp_path}/out", f"{tmp_path}/checkpoint", config)
    monkeypatch.setattr(presence, "sample_sums", whole)
    # What the broken batch had written is there already; its partition must be replaced, not added to.
    text_association.add_batch(spark.read.parquet(f"{tables}/documents.parquet"), 0, spark.read.parquet(f"{tables}/labels.parquet").select(F.col("doc_id").alias("__id"), F.lit(1.0).alias("y")), f"{tmp_path}/out", config["samples"])
    again = rows(text_association.run(spark, tables, f"{tmp_path}/out", f"{tmp_path}/checkpoint", config))
    assert again == rows(text_association.run(spark, tables, f"{tmp_path}/out2", f"{tmp_path}/checkpoint2", config))


def test_no_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    assert text_association.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", read_config("text_association")).count() == 0


def test_presence_scan_equals_dense_regression(spark):
    rng = np.random.default_rng(5)
    g, y = rng.random((60, 9)) < np.linspace(0, 1, 9), rng.normal(size=60)
    g[:, 3], g[:, 5] = y > 0, False
    samples = spark.createDataFrame([(float(v), [f"m{k}" for k in np.flatnonzero(row)]) for v, row in zip(y, g, strict=True)] + [(None, ["m1"])], "y double, held array<string>")
    found = {r["marker"]: r for r in presence.presence_scan(presence.carrier_sums(samples, F.col("held")), presence.sample_sums(samples), 0.0, 1.0).collect()}
    for k in range(9):
        x = g[:, k].astype(float)
        if x.any():
            r = found[f"m{k}"]
            assert r["n1"] == x.sum()
            if x.std() == 0:
                assert r["beta"] is r["t"] is r["p"] is None
                continue
            cor = np.corrcoef(x, y)[0, 1]
            assert np.isclose(r["beta"], np.polyfit(x, y, 1)[0]) and np.isclose(r["t"], cor * np.sqrt(58 / (1 - cor**2))) and 0 <= r["p"] <= 1
        else:
            assert f"m{k}" not in found
    exact = spark.createDataFrame([(float(k % 2), ["a"] if k % 2 else []) for k in range(10)] + [], "y double, held array<string>")
    r = presence.presence_scan(presence.carrier_sums(exact, F.col("held")), presence.sample_sums(exact)).first()
    assert (r["beta"], r["t"], r["p"]) == (1.0, float("inf"), 0.0)


def test_words(spark):
    row = spark.createDataFrame([("Ab ab, ÄB-9 x_y",), (None,)], "t string").select(presence.words("t").alias("w")).collect()
    assert row[0]["w"] == ["ab", "Äb", "9", "x", "y"] and row[1]["w"] == []


def test_command_line(small, tmp_path):
    """The command line makes and stops its own session."""
    done = subprocess.run([sys.executable, "-m", "jobs.association_report", small, str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and os.path.exists(tmp_path / "out/summary/_SUCCESS")


def test_helpers(spark, tmp_path):
    assert not exists(spark, str(tmp_path / "nothing"))
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"a": 1}))
    assert read_config(str(path)) == {"a": 1}


def test_report_reads_results_once(spark, small, tmp_path, monkeypatch):
    """Cleaned rows go into one stored table; ids that are whole numbers are not read as text."""
    made, cleaned = [], association_report.cleaned
    monkeypatch.setattr(association_report, "cleaned", lambda *a: made.append(cleaned(*a)) or made[-1])
    read = spark.sparkContext.accumulator(0)
    config = read_config("association_report")
    seen = F.udf(lambda p: read.add(1) or p, "double")
    spark.udf.register("seen", seen.asNondeterministic())
    config["results"] = config["results"] | {"p": f"seen({config['results']['p']})"}
    association_report.run(spark, small, str(tmp_path), config)
    assert read.value == spark.read.parquet(f"{small}/lineitem.parquet").count()
    plain = cleaned(spark.read.parquet(f"{small}/lineitem.parquet"), read_config("association_report")["results"], 1e-300)
    assert "regexp_replace" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_a_result_without_marker_is_an_error(spark, tmp_path):
    known = spark.createDataFrame([("a", 1)], "marker string, chr int")
    left = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "marker string, p double")
    with pytest.raises(ValueError, match="markers without a match: b"):
        joins.join_matched(left, known, "marker", "markers")
    assert joins.join_matched(left.where("p > 0.2"), known, "marker").select("marker", "p", "chr").collect() == [("a", 0.5, 1)]
