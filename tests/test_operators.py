"""Operators against plain versions of themselves, guards, and runs that go on where they stopped."""

import numpy as np
import pytest
from phenoloom.functions import columns as C
from phenoloom.operators import joins, ml, qc, reports, scan, simulate, testing
from phenoloom.plans import pipelines
from phenoloom.sources import readers, stored
from pyspark.sql import functions as F


def places(spark, rng, n, chromosomes=3, span=5_000, name="m"):
    rows = [(i, int(rng.integers(1, chromosomes + 1)), int(rng.integers(0, span))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} int, chr int, pos bigint")


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, markers = places(spark, rng, 250)
    loci = [(i, int(rng.integers(1, 5)), int(rng.integers(0, 6_000))) for i in range(60)]
    df = spark.createDataFrame(loci, "l int, chr int, locus_pos bigint")
    for bins in (1, 7, 4096):
        got = {r["l"]: (r["distance"], r["m"]) for r in joins.nearest(df, markers.select("chr", "pos", "m"), "l", bins=bins).collect()}
        assert got == {i: min(((abs(p - at), m) for m, c, p in rows if c == chr_), default=(None, None)) for i, chr_, at in loci}


def test_regions_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, points = places(spark, rng, 300)
    points = points.withColumn("score", F.pmod(F.col("m") * 37, F.lit(101)))
    spans = [(i, int(rng.integers(1, 5)), (lo := int(rng.integers(0, 5_500))), lo + int(rng.integers(0, 400)) * (1 if i else 20)) for i in range(40)]
    regions = spark.createDataFrame(spans, "region_id int, chr int, lo bigint, hi bigint")
    inside = sorted((r["m"], r["region_id"]) for r in joins.in_regions(points, regions.withColumnRenamed("chr", "chr")).collect())
    assert inside == sorted((m, i) for m, c, p in rows for i, chr_, lo, hi in spans if c == chr_ and lo <= p <= hi)
    got = {r["region_id"]: r for r in joins.region_report(points, regions, "score", "m", 150).collect()}
    for i, chr_, lo, hi in spans:
        d = sorted((max(lo - p, p - hi, 0), m) for m, c, p in rows if c == chr_)
        near = [(-(m * 37 % 101), m) for x, m in d if x <= 150]
        assert (got[i]["n_in_window"], got[i]["closest_distance"], got[i]["closest_marker"], got[i]["best_marker"]) == (len(near), *(d[0] if d else (None, None)), min(near)[1] if near else None)


def test_chromosome_of_many_ranges(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 50, 80)
    ends = np.cumsum(sizes)
    table = spark.createDataFrame([(k, int(e - n), int(e)) for k, (n, e) in enumerate(zip(sizes, ends, strict=True))], "chr int, start bigint, end bigint")
    got = {r["global_idx"]: r["chr"] for r in joins.chromosome_of(spark.range(int(ends[-1])).withColumnRenamed("id", "global_idx"), table).collect()}
    assert got == {i: int(np.searchsorted(ends, i, side="right")) for i in range(int(ends[-1]))}


def test_ranks_and_quantiles_by_counted_bins(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.integers(0, 40, 300)] + [None]
    df = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in enumerate(x)], "i int, v double, g string")
    got = {r["i"]: r["k"] for r in testing.min_rank(df, "v", "k").collect()}
    assert got == {i: None if v is None else 1 + sum(w is not None and w > v for w in x) for i, v in enumerate(x)}
    numbered = {r["i"]: r["k"] for r in testing.sequence_rank(df.where("v is not null"), [F.col("v"), F.asc("i")], "k").collect()}
    assert numbered == {i: k for k, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(x) if v is not None), 1)}
    for r in testing.quantiles(df, "v", [0.0, 0.3, 0.5, 0.999], ["g"]).collect():
        assert r["quantile"] == pytest.approx(np.quantile([v for i, v in enumerate(x) if v is not None and "ab"[i % 2] == r["g"]], r["probability"]))
    counted = testing.counts_before(df, "v", bins=5).collect()
    assert all(r["before"] == sum(w is not None and w < r["v"] for w in x) and r["total"] == 300 for r in counted)


def test_thinning_of_dense_markers(spark):
    """No gap anywhere: many stretches to a chromosome, entered wherever the walk before them ends."""
    rng = np.random.default_rng(5)
    rows = [(c, int(p)) for c in (1, 2) for p in rng.choice(40_000, 3_000, replace=False)] + [(3, 10), (3, 900_000)]
    got = sorted(tuple(r) for r in qc.thin_by_distance(spark.createDataFrame(rows, "chr int, pos bigint"), 100, cells=8).collect())
    want, last = [], {}
    for c, p in sorted(rows):
        if p >= last.get(c, -100) + 100:
            want.append((c, p))
            last[c] = p
    assert got == want


def test_call_rates_on_arrays_are_those_on_long_calls(spark):
    rng = np.random.default_rng(6)
    rows = [(m, [None if rng.random() < (0.5 if m % 7 == 0 or s % 5 == 0 else 0.05) else int(rng.integers(0, 3)) for s in range(30)]) for m in range(60)]
    df = spark.createDataFrame(rows, "marker_id int, dosage array<tinyint>")
    kept, samples = qc.call_rate_arrays(df)
    long = qc.call_rate_filter(df.select("marker_id", F.posexplode("dosage").alias("sample_id", "call")))
    want = {}
    for r in long.collect():
        want.setdefault(r["marker_id"], {})[r["sample_id"]] = r["call"]
    assert {r["marker_id"]: dict(zip(samples, r["dosage"], strict=True)) for r in kept.collect()} == want and len(samples) < 30
    assert qc.call_rate_arrays(df.limit(0))[1] == []


def test_guards(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "id int") for r in (range(5), range(3, 9)))
    assert joins.require_matched(a.where("id > 2"), b, "id").count() == 2
    with pytest.raises(ValueError, match="samples without a match: 0"):
        joins.require_matched(a.orderBy("id").limit(1), b, "id", "samples")
    matrix = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3)], "i int, j int, k double")
    ids = spark.createDataFrame([(0, 0), (7, 1)], "id int, idx int")
    with pytest.raises(ValueError, match="7"):
        joins.square_subset(matrix, ids)
    assert joins.square_subset(matrix, ids, strict=False).count() == 1
    y = np.arange(4.0)
    basis = scan.covariate_basis(y, samples=["a", "b", "c", "d"])
    markers = spark.createDataFrame([("m", [0, 1, 2, 1])], "marker_id string, dosage array<tinyint>")
    with pytest.raises(ValueError, match="from place 1 on"):
        scan.scan(markers, basis, samples=["a", "c", "b", "d"])
    with pytest.raises(Exception, match="4 samples"):
        scan.scan(markers.withColumn("dosage", F.slice("dosage", 1, 3)), basis).collect()
    assert scan.scan(markers.withColumn("dosage", F.array_repeat(F.lit(1), 4)), basis, samples=list("abcd")).first()["p"] is None
    blocks = spark.createDataFrame([(1, 0), (1, 1)], "chr int, block int")
    assert qc.filled_blocks(blocks, blocks.where("block = 1").withColumn("marker", F.lit("m")), ["chr", "block"]).count() == 1
    planted = spark.createDataFrame([("m",), ("x",)], "marker_id string")
    assert simulate.planted_dosages(markers, planted.where("marker_id = 'm'")).first()["dosage"] == [0, 1, 2, 1]
    with pytest.raises(Exception, match="planted marker lost"):
        simulate.planted_dosages(markers, planted).select("marker_id").collect()


def test_constant_and_explained_markers_have_no_estimate():
    rng = np.random.default_rng(7)
    c = rng.normal(size=(50, 2))
    g = np.vstack([np.ones(50), c[:, 0] * 3 - c[:, 1], rng.integers(0, 3, 50)])
    beta, t, p = scan.scan_block(g, scan.covariate_basis(rng.normal(size=50), c))
    assert np.isnan([beta[:2], t[:2], p[:2]]).all() and np.isfinite([beta[2], t[2], p[2]]).all()
    perfect = scan.scan_block(g[2:], scan.covariate_basis(2 * g[2] + 1))
    assert perfect[0][0] == pytest.approx(2) and perfect[2][0] < 1e-200


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 20, 0.5)], "Chromosome int, bp bigint, imp double")
    out = readers.mapped_columns(df, {"chr": "Chromosome", "pos": "bp", "value": "imp", "fold": "Fold"}, ("fold",))
    assert out.columns == ["chr", "pos", "value"] and C.with_key(out, "marker_id").first()["marker_id"] == "Chr1_20"
    assert C.with_key(out.withColumn("marker_id", F.lit("own")), "marker_id").first()["marker_id"] == "own"
    with pytest.raises(ValueError, match="Fold"):
        readers.mapped_columns(df, {"fold": "Fold"})
    assert readers.select_markers(df, ["imp", "nothing", "bp"], ["Chromosome"]).columns == ["Chromosome", "imp", "bp"]


def test_trees_take_every_cut_and_any_depth():
    """The best cut lies between two of 200 values; a staircase of 90 steps needs 90 leaves in a row."""
    x = np.arange(200.0)[:, None]
    y = (x[:, 0] > 136.5).astype(float)
    assert ml._best_split(x, y, np.array([0]), 1)[2] == pytest.approx(136.5)
    steps = np.arange(90.0)[:, None]
    tree = ml.Tree(None, 1, 1, np.random.default_rng(0)).fit(steps, 1.5 ** steps[:, 0], np.zeros(1))
    assert np.allclose(tree.predict(steps), 1.5 ** steps[:, 0])


def test_report_points(spark):
    rows = [(i, 1 + i // 5, 10 * (i % 5) + 1, float(i * 7 % 11)) for i in range(10)]
    m = spark.createDataFrame(rows, "marker_id int, chr int, pos bigint, value double")
    got = {r["marker_id"]: r for r in reports.importance_manhattan(m, "value", m.where("marker_id = 3"), 3).collect()}
    least = sorted((v for *_, v in rows), reverse=True)[2]
    assert all(r["x"] == p + 41 * (c - 1) and r["in_top"] == (v >= least) and r["planted"] == (i == 3) for i, c, p, v in rows for r in [got[i]])
    pairs = spark.createDataFrame([(0, 1, 0.5), (1, 2, None)], "a int, b int, r2 double")
    cells = {(r["i"], r["j"]): (r["r2"], r["label_i"]) for r in reports.ld_map(pairs, m.where("marker_id < 3"), m.where("marker_id = 1")).collect()}
    assert cells == {(0, 1): (0.5, ""), (1, 0): (0.5, "1"), (1, 2): (None, "1"), (2, 1): (None, ""), (0, 0): (1.0, ""), (1, 1): (1.0, "1"), (2, 2): (1.0, "")}


def test_constants(spark):
    plant = simulate.reference_chromosomes(spark, "plant")
    assert plant.agg(F.sum("markers"), F.sum("blocks")).first() == (3_557_529, 108) and sum(simulate.MAF_COUNTS) == 3_557_529
    assert simulate.reference_chromosomes(spark, "human").count() == 22 and simulate.human_windows(spark).count() == 26


def test_series_of_runs_goes_on(spark, tmp_path):
    path, made = str(tmp_path / "runs"), []
    build = pipelines.synthetic_benchmark

    def counted(*a, **k):
        made.append(k["seed"])
        return build(*a, **k)

    pipelines.synthetic_benchmark = counted
    try:
        args = {"blind": {"chromosomes": [(1, 100_000, 20, 1)], "causal": 2}}, 40, 2, 3, (4, 3), (4, 3)
        run = lambda seeds: pipelines.multi_seed_validation(spark, path, args[0], seeds, args[1], args[2], args[3], args[4], args[5]).collect()
        first, second = run([1]), run([1, 2])
    finally:
        pipelines.synthetic_benchmark = build
    assert made == [1, 2] and {r["n_runs"] for r in first} == {1} and {r["n_runs"] for r in second} == {2}
    units = spark.createDataFrame([(1,), (2,)], "unit int")
    seen = []
    work = lambda df: (seen.append(df.count()), df.withColumn("n", F.col("unit") * 10))[1]
    assert pipelines.resume(units.where("unit = 1"), str(tmp_path / "units"), ["unit"], work).count() == 1
    assert sorted(r["n"] for r in pipelines.resume(units, str(tmp_path / "units"), ["unit"], work).collect()) == [10, 20] and seen == [1, 1]


def test_stored_tables_are_removed(spark):
    import os

    table = stored.stored(spark.range(3))
    path = stored.path_of(table)
    assert os.path.isdir(path)
    stored.discard(table)
    assert not os.path.exists(path)
