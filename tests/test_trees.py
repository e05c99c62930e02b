"""Trees that grow together against trees grown node by node."""

import numpy as np
import pytest
from phenoloom.operators import ml


class Every:
    """Draws all features, in their order."""

    def choice(self, n, k, replace):
        return np.arange(n)


def grown(x, y, weight, depth, leaf):
    xt = ml._coded(x)
    grove = ml.Grove(y, weight, depth, leaf)
    while (asked := grove.ask()) is not None:
        found = ml.best_cuts(xt, asked, np.tile(np.arange(len(xt)), (len(asked), 1)), leaf)
        grove.tell(*found, lambda k, found=found: xt[found[1][k]] > found[2][k, None])
    return grove


@pytest.mark.parametrize(("depth", "leaf", "kind"), [(None, 1, "bytes"), (3, 1, "bytes"), (None, 4, "bytes"), (None, 1, "doubles"), (2, 3, "missing")])
def test_trees_grown_together_are_trees_grown_alone(monkeypatch, depth, leaf, kind):
    """Every cut may be any feature here, so draws don't matter; arrays are cut in pieces of a node or two."""
    monkeypatch.setattr(ml, "AT_ONCE", 200)
    rng = np.random.default_rng(leaf)
    x = rng.binomial(2, 0.4, (80, 9)).astype(np.int8 if kind == "bytes" else float)
    if kind == "doubles":
        x += rng.normal(size=x.shape)
    elif kind == "missing":
        x[rng.random(x.shape) < 0.1] = np.nan
    y, weight = rng.normal(size=80) + np.nan_to_num(x[:, 2]), ml.bootstrap(rng, 6, np.arange(60), 80)
    grove = grown(x, y, weight, depth, leaf)
    tree, _, gain = grove.importance()
    for t in range(6):
        rows, own = np.repeat(np.arange(80), weight[t]), np.zeros(9)
        alone = ml.Tree(depth, leaf, 9, Every()).grow(ml._coded(x), rows, y[rows], own)
        seen = np.unique(rows)
        np.testing.assert_allclose(grove.out[t, seen], alone.predict(x[seen]))
        assert gain[tree == t].sum() == pytest.approx(own.sum())
    np.testing.assert_allclose(grove.values(ml._coded(x)), grove.out)


def test_draws_are_sets_all_alike():
    for features, k in ((5, 2), (6, 4), (1, 1), (9, 9)):
        d = ml._drawn(np.random.default_rng(3), 4000, features, k)
        assert (np.diff(d, axis=1) > 0).all() and d.min() == 0 and d.max() == features - 1
        share = np.bincount(d.ravel(), minlength=features) / 4000
        assert np.allclose(share, k / features, atol=0.05)
    pairs = np.unique(ml._drawn(np.random.default_rng(5), 10_000, 5, 2), axis=0, return_counts=True)[1]
    assert len(pairs) == 10 and np.allclose(pairs, 1000, atol=150)


def test_a_forest_asks_by_levels(monkeypatch):
    """A call of array functions for each node of 20 trees, not for each level of all, is what 72,000 forests have no time for."""
    calls, cuts = [], ml.best_cuts
    monkeypatch.setattr(ml, "best_cuts", lambda xt, asked, *a: calls.append(len(asked)) or cuts(xt, asked, *a))
    rng = np.random.default_rng(8)
    ml.random_forest(rng.binomial(2, 0.4, (200, 100)).astype(np.int8), rng.normal(size=200), 20)
    assert len(calls) < 60 and sum(calls) > 1000


def test_folds_of_a_unit_are_one_group(spark):
    """Genotypes are dealt once for each model, not for each fold of it as well; a fold's rows don't depend on the others."""
    rng = np.random.default_rng(4)
    rows = [(str(i), 1, i % 2, [int(v) for v in rng.integers(0, 3, 30)]) for i in range(20)]
    markers = spark.createDataFrame(rows, "marker_id string, chr int, block int, dosage array<tinyint>")
    found = ml.screen(markers, rng.normal(size=30), ml.kfold(30, 3, 1), 2, (4, 4))
    sent = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sent.size() == 1 and "array(RF, GB)" in found._jdf.queryExecution().analyzed().toString()
    got = found.collect()
    assert len(got) == 3 * 2 * 2 * 2 and {(r["fold"], r["model"], r["rank"]) for r in got} == {(f, m, k) for f in range(3) for m in ("RF", "GB") for k in (1, 2)}


def test_models_of_all_markers_are_grown_over_a_table(spark):
    """Out of fold and as a whole; files and tasks of a few markers give the same rows as one of all."""
    rng = np.random.default_rng(11)
    x = rng.binomial(2, 0.4, (60, 40)).astype(np.int8)
    y, folds, pcs = 2.0 * x[:, 7] + rng.normal(size=60), ml.kfold(60, 3, 1), rng.normal(size=(60, 2))
    markers = spark.createDataFrame([(f"m{k:02}", x[:, k].tolist()) for k in range(40)], "marker_id string, dosage array<tinyint>")
    for own in (None, pcs):
        rows = {}
        for parts, size in ((1, 4000), (7, 5)):
            ml.FILE_ROWS, kept = size, ml.FILE_ROWS
            try:
                rows[parts] = sorted(ml.refine_all(markers.repartition(parts), y, folds, own, (20, 3)).collect(), key=lambda r: (r["kind"], r["key"]))
            finally:
                ml.FILE_ROWS = kept
        assert rows[1] == rows[7]
        told = [r for r in rows[1] if r["kind"] == "prediction"]
        assert sorted(int(r["key"]) for r in told) == list(range(60)) and all(folds[int(r["key"])] == r["fold"] for r in told)
        weight = {r["key"]: (r["rf"], r["gb"]) for r in rows[1] if r["kind"] == "importance"}
        assert sorted(weight) == [f"m{k:02}" for k in range(40)] and max(weight, key=weight.get) == "m07"
        shares = np.sum(list(weight.values()), 0)
        assert np.allclose(shares, 1) if own is None else (shares[0] < 1 and shares[1] < 1 + 1e-9)
        assert np.corrcoef([r["rf"] for r in told], [y[int(r["key"])] for r in told])[0, 1] > 0.1
    # Held-out samples don't matter to their predictions.
    other = y.copy()
    other[folds == 1] += rng.normal(size=(folds == 1).sum())
    one, two = ({r["key"]: (r["rf"], r["gb"]) for r in ml.refine_all(markers, v, folds, None, (5, 3)).where("kind = 'prediction' and fold = 1").collect()} for v in (y, other))
    assert one == two and len(one) == (folds == 1).sum()


@pytest.mark.parametrize("kind", ["bytes", "missing"])
def test_cuts_found_in_parts_are_those_of_the_whole(kind):
    rng = np.random.default_rng(12)
    x = rng.binomial(2, 0.4, (50, 30)).astype(np.int8 if kind == "bytes" else float)
    if kind == "missing":
        x[rng.random(x.shape) < 0.1] = np.nan
    xt, weight = ml._coded(x), ml.bootstrap(rng, 5, np.arange(50), 50)
    grove = ml.Grove(rng.normal(size=50), weight, None, 1)
    while (asked := grove.ask()) is not None:
        drawn = ml._drawn(rng, len(asked), 30, 5)
        whole, parts = ml.best_cuts(xt, asked, drawn, 1), ml._Best(len(asked), 50)
        for own in np.array_split(rng.permutation(30), 4):
            parts.look(np.ascontiguousarray(xt[own]), own, asked, drawn, 1)
        good = whole[0] > 1e-12
        for a, b in zip(whole, (parts.gain, parts.feature, parts.cut), strict=True):
            np.testing.assert_allclose(a[good], b[good])
        assert (parts.above[good] == (xt[whole[1][good]] > whole[2][good, None])).all() and np.isinf(parts.gain[~good]).all()
        grove.tell(*whole, lambda k, w=whole: xt[w[1][k]] > w[2][k, None])


def test_prediction_and_refit_look_at_every_marker(spark, small):
    from phenoloom.plans import queries as Q

    m, _ = Q._ml_data(spark, small)
    got = [r["key"] for r in Q.predict_and_refit(spark, small).where("kind = 'importance'").collect()]
    assert sorted(got) == sorted(r["marker_id"] for r in m.select("marker_id").collect())
