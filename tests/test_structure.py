"""Block products of linkage, blocked components and the low-rank mixed model, each against the plain matrix form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoloom.operators import components, linkage, scan, structure
from phenoloom.plans import pipelines


def table(spark, g, pos=None, chr_=None):
    rows = [(k, int(chr_[k]) if chr_ is not None else 1, int(pos[k]) if pos is not None else k, [None if np.isnan(v) else int(v) for v in row]) for k, row in enumerate(g)]
    return spark.createDataFrame(rows, "marker_id int, chr int, pos bigint, dosage array<tinyint>").repartition(5)


def plain_pairs(g, pos, chr_, window):
    out = {}
    for a in range(len(g)):
        for b in range(a + 1, len(g)):
            if chr_[a] == chr_[b] and abs(pos[a] - pos[b]) <= window:
                both = ~np.isnan(g[a]) & ~np.isnan(g[b])
                x, y = g[a][both], g[b][both]
                r2 = np.corrcoef(x, y)[0, 1] ** 2 if len(x) and x.std() > 0 and y.std() > 0 else None
                out[a, b] = (abs(pos[a] - pos[b]), int(both.sum()), r2)
    return out


@pytest.fixture(scope="module")
def dense():
    """40 markers in one bin and others spread over bins, a chromosome of its own, missing calls, a constant marker."""
    rng = np.random.default_rng(11)
    g = rng.integers(0, 3, (90, 37)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    g[7], g[8] = 1, np.nan
    pos = np.r_[rng.integers(1000, 1099, 40), rng.integers(0, 3000, 50)]
    return g, pos, np.r_[np.ones(75, int), np.full(15, 2)]


@pytest.mark.parametrize("tile", [256, 7])
def test_pairs_of_arrays(spark, dense, tile):
    g, pos, chr_ = dense
    found = linkage.ld_pairs_arrays(table(spark, g, pos, chr_), 100, tile=tile).collect()
    want = plain_pairs(g, pos, chr_, 100)
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == set(want)
    for r in found:
        d, n, r2 = want[r["a"], r["b"]]
        assert (r["distance"], r["n"]) == (d, n) and ((r["r2"] is None) == (r2 is None)) and (r2 is None or abs(r["r2"] - r2) < 1e-9)


@pytest.mark.parametrize("samples", [4096, 5])
def test_pairs_of_long_calls(spark, dense, samples):
    g, pos, chr_ = dense
    calls = table(spark, g, pos, chr_).select("marker_id", "chr", "pos", F.posexplode("dosage").alias("s", "call")).where("call is not null").withColumn("sample_id", F.concat(F.lit("s"), F.col("s").cast("string")))
    found = {(r["a"], r["b"]): r for r in linkage.ld_pairs(calls, 100, tile=16, samples=samples).collect()}
    want = {k: v for k, v in plain_pairs(g, pos, chr_, 100).items() if 8 not in k}
    assert set(found) == set(want)
    for k, (d, n, r2) in want.items():
        assert (found[k]["distance"], found[k]["n"]) == (d, n) and (r2 is None or abs(found[k]["r2"] - r2) < 1e-9)


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "marker_id int, chr int, pos bigint, dosage array<tinyint>")
    assert linkage.ld_pairs_arrays(none, 10).collect() == []
    one = spark.createDataFrame([(1, 1, 5, [0, 1]), (2, None, 5, [0, 1]), (None, 1, 5, [0, 1])], none.schema)
    assert linkage.ld_pairs_arrays(one, 10).collect() == []
    assert linkage.ld_by_distance(linkage.ld_pairs_arrays(one, 10), [0, 10]).collect() == []


def test_medians_by_distance(spark, dense):
    g, pos, chr_ = dense
    found = {r["bin"]: r for r in linkage.ld_by_distance(linkage.ld_pairs_arrays(table(spark, g, pos, chr_), 100), [0, 20, 100]).collect()}
    want = [v for v in plain_pairs(g, pos, chr_, 100).values() if v[2] is not None]
    for k, (low, high) in enumerate(((0, 20), (20, 100))):
        own = [r2 for d, _, r2 in want if low <= d < high]
        assert found[k]["pairs"] == len(own) and abs(found[k]["median_r2"] - np.median(own)) < 1e-9


# --- components ---


def structured(markers=300, samples=120, groups=4, seed=2):
    rng = np.random.default_rng(seed)
    f = rng.uniform(0.1, 0.9, (markers, groups))
    return rng.binomial(2, f[:, rng.integers(0, groups, samples)]).astype(float)


@pytest.mark.parametrize("scale", ["zscore", "vanraden", "centre"])
def test_same_subspace_as_dense(spark, scale):
    g = structured()
    markers = table(spark, g).cache()
    found = components.components(markers, 120, 8, scale, block=9)
    total, divisor = structure.gram(markers, scale)
    total = total / divisor if scale == "vanraden" else total
    values, vectors = np.linalg.eigh(total)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert np.allclose(found.values, values, rtol=1e-10) and found.residuals.max() <= 1e-10
    assert np.isclose(found.trace, np.trace(total)) and np.allclose(found.share, values / np.trace(total))
    assert np.linalg.norm(found.vectors @ found.vectors.T - vectors @ vectors.T) < 1e-8
    assert found.vectors.shape == (120, 8) and found.passes > 1


def test_scores_are_the_dense_ones(spark):
    g = structured()
    markers = table(spark, g)
    dense, share = structure.principal_components(markers, 3)
    found = components.components(markers, 120, 3)
    assert np.allclose(found.scores, dense, atol=1e-6) and np.allclose(found.share, share)


def test_a_basis_that_is_cut_back(spark):
    g = structured(400, 200, 6, 5)
    markers = table(spark, g).cache()
    found = components.components(markers, 200, 5, block=6, most_columns=24)
    values = np.linalg.eigvalsh(structure.gram(markers)[0])[::-1][:5]
    assert np.allclose(found.values, values, rtol=1e-9) and found.residuals.max() <= 1e-10


def test_more_samples_than_a_square_holds(spark):
    """5,000 samples and two components that stand out: a pass sends a thin block, no square matrix is made."""
    group = np.arange(5000) % 3
    rows = spark.range(0, 400, 1, 8).select(F.col("id").cast("int").alias("marker_id"), F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda s: F.when((F.xxhash64("id", s % 3) % 7) > 0, (F.xxhash64("id", s) % 2 == 0).cast("tinyint")).otherwise(F.lit(0).cast("tinyint"))).alias("dosage"))
    with pytest.raises(Exception, match="more than 4000 samples"):
        structure.gram(rows)
    found = components.components(rows, 5000, 2, tolerance=1e-6)
    for g in range(3):
        own = found.vectors[group == g]
        assert own.std(0).max() < 0.5 * found.vectors.std(0).max()
    assert found.residuals.max() <= 1e-6 and np.allclose(found.vectors.T @ found.vectors, np.eye(2), atol=1e-9)


def test_components_of_little(spark):
    none = spark.createDataFrame([], "marker_id int, dosage array<tinyint>")
    assert components.components(none, 4, 2).vectors.shape == (4, 0)
    flat = table(spark, np.ones((3, 5)))
    assert components.components(flat, 5, 2).values.size == 0
    one = components.components(table(spark, np.array([[0.0, 1, 2, 2]])), 4, 3)
    assert one.values.shape == (1,) and np.isclose(one.share[0], 1)
    with pytest.raises(Exception, match="doesn't have 6 samples"):
        components.components(flat, 6, 2)


# --- mixed model ---


@pytest.fixture(scope="module")
def related():
    g = structured(200, 80)
    z = g - g.mean(1, keepdims=True)
    k = z.T @ z / 60
    rng = np.random.default_rng(4)
    return g, k, rng.multivariate_normal(np.zeros(80), k + np.eye(80)), rng.normal(size=(80, 2))


def test_full_rank_is_the_dense_model(related):
    g, k, y, c = related
    dense, delta = scan.mixed_basis(y, k, c)
    values, vectors = np.linalg.eigh(k)
    low, same = scan.low_rank_basis(y, vectors, np.maximum(values, 0), c)
    assert np.isclose(delta, same, rtol=1e-6)
    for a, b in zip(scan.scan_block(g, dense), scan.scan_block(g, low), strict=True):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-6)


def test_low_rank_is_generalised_least_squares(related):
    g, k, y, c = related
    values, vectors = np.linalg.eigh(k)
    u, s, rest = vectors[:, -6:], values[-6:], values[:-6].mean()
    basis, delta = scan.low_rank_basis(y, u, s, c, rest)
    v = u * s @ u.T + rest * (np.eye(80) - u @ u.T) + delta * np.eye(80)
    inverse = np.linalg.inv(v)
    beta, t, _ = scan.scan_block(g[:5], basis)
    for k_, x in enumerate(g[:5]):
        design = np.column_stack([np.ones(80), c, x])
        a = np.linalg.inv(design.T @ inverse @ design)
        b = a @ design.T @ inverse @ y
        r = y - design @ b
        assert np.isclose(beta[k_], b[-1]) and np.isclose(t[k_], b[-1] / np.sqrt(a[-1, -1] * (r @ inverse @ r) / 76))


def test_mixed_scan_of_full_rank(spark, related):
    g, _, y, _ = related
    markers = table(spark, g).cache()
    dense = {r["marker_id"]: r for r in pipelines.mixed_scan(markers, y, 2).collect()}
    low = {r["marker_id"]: r for r in pipelines.mixed_scan(markers, y, 2, rank=79).collect()}
    assert set(dense) == set(low)
    for k in dense:
        assert np.allclose([dense[k]["beta"], dense[k]["t"], dense[k]["p"]], [low[k]["beta"], low[k]["t"], low[k]["p"]], rtol=1e-4, atol=1e-6)


def test_subindex_is_of_the_matrix_of_all_vectors(spark, small):
    """Every third row and column of all vectors' products: it grows with the square of the vectors."""
    from phenoloom.plans import queries as Q

    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    keep = [k for k, r in enumerate(rows) if r["vec_id"] % 3 == 0]
    want = (x @ x.T)[np.ix_(keep, keep)]
    got = np.full(want.shape, np.nan)
    found = Q.kinship_subindex(spark, small).collect()
    for r in found:
        got[r["row"], r["col"]] = r["k"]
    assert len(found) == len(keep) ** 2
    np.testing.assert_allclose(got, want, atol=1e-5)


def test_products_of_all_rows_are_not_dealt_as_pairs(spark):
    """Blocks are exchanged before they meet; pairs of them, quadratic in number, never are. Rows without a value have no cell."""
    from phenoloom.operators import joins

    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(70, None)], "id bigint, v array<double>")
    ids = rows.where("id % 3 = 1").select("id", ((70 - F.col("id")) / 3).cast("bigint").alias("idx"))
    every, some = structure.gram_long(rows, "id", "v", 16), structure.gram_long(rows, "id", "v", 16, ids)
    for df in (every, some):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("CartesianProduct")]
    full = np.full((70, 70), np.nan)
    for r in every.collect():
        full[r["i"], r["j"]] = r["product"]
    np.testing.assert_allclose(full, x @ x.T, atol=1e-12)
    want = {(r["row"], r["col"]): r["product"] for r in joins.square_subset(every, ids.where("id < 70")).collect()}
    got = {(r["row"], r["col"]): r["product"] for r in some.collect()}
    assert want.keys() == got.keys() and len(got) == 23**2 and np.allclose([want[k] for k in got], list(got.values()))
