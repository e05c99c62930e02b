"""Closed forms and definitions: scans against least squares, adjusted p values, tails, folds, generators."""

import numpy as np
import pytest
from phenoloom.functions import distributions as D
from phenoloom.operators import joins, ml, qc, scan, simulate, structure, testing
from phenoloom.plans import pipelines
from pyspark.sql import functions as F


def ols_t(g, y, c):
    x = np.column_stack([np.ones(len(y)), c, g])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    s2 = r @ r / (len(y) - x.shape[1])
    return b[-1], b[-1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[-1, -1])


def test_scan_is_full_least_squares():
    rng = np.random.default_rng(0)
    y, c, g = rng.normal(size=80), rng.normal(size=(80, 3)), rng.integers(0, 3, (20, 80)).astype(float)
    beta, t, p = scan.scan_block(g, scan.covariate_basis(y, c))
    for k in range(20):
        b, tt = ols_t(g[k], y, c)
        assert beta[k] == pytest.approx(b, rel=1e-9) and t[k] == pytest.approx(tt, rel=1e-9)
    assert ((p > 0) & (p <= 1)).all()
    with pytest.raises(ValueError):
        scan.covariate_basis(np.array([1.0, np.nan]))


def test_mixed_model_is_generalised_least_squares():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (200, 60)).astype(float)
    z = g - g.mean(1, keepdims=True)
    k = z.T @ z / 200
    y, c = rng.normal(size=60), rng.normal(size=(60, 2))
    basis, delta = scan.mixed_basis(y, k, c)
    beta, t, _ = scan.scan_block(g[:5], basis)
    v = np.linalg.inv(k + delta * np.eye(60))
    for m in range(5):
        x = np.column_stack([np.ones(60), c, g[m]])
        a = np.linalg.inv(x.T @ v @ x)
        b = a @ x.T @ v @ y
        r = y - x @ b
        s2 = r @ v @ r / (60 - x.shape[1])
        assert beta[m] == pytest.approx(b[-1], rel=1e-6) and t[m] == pytest.approx(b[-1] / np.sqrt(s2 * a[-1, -1]), rel=1e-6)
    same, _ = scan.mixed_basis(y, np.eye(60), c)
    plain = scan.scan_block(g[:5], scan.covariate_basis(y, c))
    assert np.allclose(scan.scan_block(g[:5], same)[1], plain[1])


def test_tails(spark):
    t = np.array([0.0, 1.0, -2.5, 10.0, 80.0])
    p = D.t_two_sided_array(t, 492)
    assert p[0] == 1 and p[4] == pytest.approx(3.6e-284, rel=0.05)
    jvm = [r[0] for r in spark.createDataFrame([(float(x),) for x in t], "t double").select(D.t_two_sided(F.col("t"), 492)).collect()]
    assert np.allclose(p[:4], jvm[:4], rtol=1e-9)
    assert np.allclose(D.normal_cdf_array(D.normal_ppf_array(np.array([1e-6, 0.3, 0.5, 0.999]))), [1e-6, 0.3, 0.5, 0.999])
    chi = spark.createDataFrame([(0.05,), (0.5,)], "p double").select(D.chi2_1_isf(F.col("p"))).collect()
    assert chi[0][0] == pytest.approx(3.841458820694) and chi[1][0] == pytest.approx(D.CHI2_1_MEDIAN)


@pytest.mark.parametrize("p", [[0.01, 0.04, 0.03, 0.005], [0.2, 0.2, 0.2, 0.9, None], [1.0], [0.5, 0.01, 0.01, 0.01, 0.02, 0.9, 0.9]])
def test_benjamini_hochberg_by_definition(spark, p):
    got = {r["i"]: r["q"] for r in testing.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), bins=3).collect()}
    used = [x for x in p if x is not None]
    for i, x in enumerate(p):
        want = None if x is None else min(1.0, min(y * len(used) / sum(z <= y for z in used) for y in used if y >= x))
        assert got[i] == (want if want is None else pytest.approx(want))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "marker_id string, chr int, pos bigint, p double, dosage array<tinyint>")
    assert testing.benjamini_hochberg(empty).count() == 0
    assert testing.genomic_inflation(empty).collect()[0][0] is None
    assert qc.thin_by_distance(empty, 10).count() == 0
    assert structure.gram(empty)[1] == 0


def test_inflation_of_even_counts(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "p double")
    want = np.mean([D.normal_ppf_array(np.array([1 - x / 2]))[0] ** 2 for x in (0.4, 0.6)]) / D.CHI2_1_MEDIAN
    assert testing.genomic_inflation(df).collect()[0][0] == pytest.approx(want)


def test_greedy_thinning(spark):
    m = spark.createDataFrame([(1, p) for p in range(5, 576, 30)] + [(2, 7), (2, 7), (2, 106), (2, 107)], "chr int, pos bigint")
    got = sorted(tuple(r) for r in qc.thin_by_distance(m, 100).collect())
    assert got == [(1, 5), (1, 125), (1, 245), (1, 365), (1, 485), (2, 7), (2, 107)]


def test_nearest_limit_is_closed(spark):
    loci = spark.createDataFrame([(1, 1, 200_000), (2, 1, 500_001), (3, 9, 1)], "locus_id int, chr int, locus_pos bigint")
    markers = spark.createDataFrame([("a", 1, 100_000), ("b", 1, 400_000)], "m string, chr int, pos bigint")
    got = {r["locus_id"]: (r["distance"], r["hit"]) for r in joins.nearest(loci, markers.select("chr", "pos", "m"), "locus_id", 100_000).collect()}
    assert got == {1: (100_000, True), 2: (100_001, False), 3: (None, None)}


def test_binned_interval_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    markers = spark.createDataFrame([(i, int(rng.integers(1, 3)), int(rng.integers(0, 10_000))) for i in range(300)], "m int, chr int, pos bigint")
    loci = spark.createDataFrame([(i, int(rng.integers(1, 3)), int(rng.integers(0, 10_000))) for i in range(40)], "l int, chr int, locus_pos bigint")
    small = sorted((r["m"], r["l"]) for r in joins.within_distance(markers, loci, 250).collect())
    monkeypatch.setattr(joins, "SMALL", 5)
    assert sorted((r["m"], r["l"]) for r in joins.within_distance(markers, loci, 250).collect()) == small


def test_folds():
    assert np.bincount(ml.kfold(503, 5, 1)).tolist() == [101, 101, 101, 100, 100]
    assert (ml.kfold(50, 5, 3) == ml.kfold(50, 5, 3)).all()


def test_screening_does_not_see_test_samples(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), 1, i % 2, [int(v) for v in rng.integers(0, 3, 40)]) for i in range(30)]
    markers = spark.createDataFrame(rows, "marker_id string, chr int, block int, dosage array<tinyint>")
    y, folds = rng.normal(size=40), ml.kfold(40, 4, 0)
    changed = y.copy()
    changed[folds == 2] = rng.permutation(changed[folds == 2]) + 50
    pick = lambda v: sorted((r["block"], r["model"], r["marker_id"]) for r in ml.screen(markers, v, folds, 3, (8, 8)).where("fold = 2").collect())
    assert pick(y) == pick(changed)


def test_trees_find_a_planted_signal():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (150, 20)).astype(float)
    y = 2 * x[:, 3] + 0.1 * rng.normal(size=150)
    for fit in (ml.random_forest(x, y, 30), ml.gradient_boosting(x, y, 40)):
        assert fit[1].argmax() == 3 and np.corrcoef(fit[0](x), y)[0, 1] > 0.9


def test_generated_blocks_do_not_depend_on_partitions(spark):
    plan = simulate.block_plan(spark, [(1, 30_000, 120, 3)])
    a = {r["marker_id"]: r["dosage"] for r in simulate.genotypes(plan, 20, 7).collect()}
    b = {r["marker_id"]: r["dosage"] for r in simulate.genotypes(plan.repartition(5), 20, 7).collect()}
    assert a == b and len(a) == 120
    linked = {r["marker_id"]: r["dosage"] for r in simulate.genotypes(plan, 20, 7, linked=True).collect()}
    assert len(linked) == 120


def test_planted_signal_is_recovered(spark):
    markers, truth, y = pipelines.synthetic_benchmark(spark, [(1, 300_000, 80, 2)], 200, 11, 2)
    found = scan.scan(markers, scan.covariate_basis(y)).orderBy("p").limit(10)
    assert {r["marker_id"] for r in truth.collect()} & {r["marker_id"] for r in found.collect()}


def test_components_explain_all(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [int(v) for v in rng.integers(0, 3, 12)]) for i in range(50)]
    scores, share = structure.principal_components(spark.createDataFrame(rows, "marker_id int, dosage array<tinyint>"), 11)
    assert share.sum() == pytest.approx(1, abs=1e-6) and scores.shape == (12, 11)
    g = np.array([r[1] for r in rows], float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, ddof=1, keepdims=True)
    assert np.allclose(scores @ scores.T, z.T @ z, atol=1e-8)


def _plain_split(x, y, features, leaf):
    """A cut at a time, as trees are defined."""
    best, total, n = None, y.sum(), len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values, sums = x[order, f], np.cumsum(y[order])
        for k in range(max(leaf, 1), n - max(leaf, 1) + 1):
            if k < n and values[k] > values[k - 1]:
                gain = sums[k - 1] ** 2 / k + (total - sums[k - 1]) ** 2 / (n - k) - total * total / n
                if gain > 1e-12 and (best is None or gain > best[0]):
                    best = (float(gain), int(f), float((values[k - 1] + values[k]) / 2))
    return best


@pytest.mark.parametrize("n", [2, 5, 24, 25, 90])
def test_cuts_of_bytes_and_doubles_are_the_same(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        x, y, leaf = rng.binomial(2, rng.uniform(0, 0.6, 12), (n, 12)), rng.normal(size=n), int(rng.integers(1, 4))
        want = _plain_split(x, y, range(12), leaf)
        xt, rows, every = np.ascontiguousarray(x.T, np.int8), np.arange(n), np.arange(12)
        assert ml._best_split(x, y, every, leaf) == want
        assert ml._best_cut(xt, rows, y, every, leaf, y.sum()) == want
        if n <= ml.FEW:
            assert ml._best_of_few(xt, rows, y, every, leaf, y.sum()) == want


def test_a_forest_holds_dosages_as_bytes():
    """No copy of all features as doubles, for the fit or for a node of it."""
    import tracemalloc

    x = np.random.default_rng(1).binomial(2, 0.3, (50, 40_000)).astype(np.int8)
    tracemalloc.start()
    ml.random_forest(x, np.arange(50.0), 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * x.nbytes


def test_ranks_count_values_once(spark):
    """The table is read once, however often its counts are; bins are the bounds below a value."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "double").asNondeterministic()
    df = spark.range(1000).select(seen(F.col("id").cast("double") % 37).alias("v"))
    found = testing.counts_before(df, "v", bins=8).orderBy("v").collect()
    assert read.value == 1000
    assert [r["v"] for r in found] == [float(k) for k in range(37)] and found[-1]["before"] + found[-1]["n"] == 1000 == found[0]["total"]
    assert [r["bin"] for r in found] == sorted(r["bin"] for r in found) and found[-1]["bin"] > 4


def test_corrected_is_both_corrections(spark):
    df = spark.createDataFrame([(k, (k * k % 101) / 101 if k % 7 else None) for k in range(200)], "k int, p double")
    both = testing.bonferroni(testing.benjamini_hochberg(df))
    found = testing.corrected(df)
    assert found.columns == both.columns and sorted(map(repr, found.collect())) == sorted(map(repr, both.collect()))
