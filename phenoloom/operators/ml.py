"""Folds, tree ensembles on dosages, metrics, and the screen-then-refine designs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import discard, stored
from .joins import small_side
from .numbering import numbered

# --- folds and metrics ---


def kfold(n: int, k: int, seed: int) -> np.ndarray:
    """Fold of each of n samples: a seeded permutation cut into k parts, the first n mod k one longer."""
    order = np.random.RandomState(seed).permutation(n)
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    folds = np.empty(n, int)
    folds[order] = np.repeat(np.arange(k), sizes)
    return folds


def metrics(df: DataFrame, y: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """n, r2, rmse, mae of the scored rows, as a whole or by group; the mean of y is that of the same rows."""
    e = F.col(y) - F.col(prediction)
    spread = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count("*")
    aggs = [F.count("*").alias("n"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]
    return df.groupBy(*(by or [])).agg(*aggs)


def require_complete(oof: DataFrame, *predictions: str) -> DataFrame:
    """oof, with an error where a sample has no prediction."""
    out = oof
    for p in predictions:
        out = out.withColumn(p, F.when(F.col(p).isNotNull(), F.col(p)).otherwise(F.raise_error(F.lit(f"a sample has no {p} prediction")).cast("double")))
    return out


# --- trees on dosages (values 0, 1, 2) or any numbers ---


def _coded(x: np.ndarray) -> np.ndarray:
    """Features x samples: bytes if all values are dosages 0, 1, 2, else doubles."""
    if x.dtype == np.int8 and (not x.size or (x.min() >= 0 and x.max() <= 2)):
        return np.ascontiguousarray(x.T)
    x = np.asarray(x, float)
    small = np.isin(x, (0.0, 1.0, 2.0)).all()
    return np.ascontiguousarray(x.T, np.int8 if small else float)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int) -> tuple[float, int, float] | None:
    """The best cut of samples x features; see _best_cut."""
    return _best_cut(np.asarray(x, float).T, np.arange(len(y)), y, features, leaf, y.sum())


def _best_of_few(xt: np.ndarray, rows: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int, total: float) -> tuple[float, int, float] | None:
    """_best_cut for a few samples' dosages, where a call of an array function costs more than its sums; the same bits."""
    n, total, own = len(rows), float(total), y.tolist()
    base, best, found = total * total / n, 1e-12, None
    for f, values in zip(features.tolist(), xt[features[:, None], rows].tolist(), strict=True):
        n0, n1 = values.count(0), values.count(1)
        if n0 == n or n1 == n or not (n0 or n1):
            continue
        below = 0.0
        for value, left, cut in ((0, n0, 0.5 if n1 else 1.0), (1, n0 + n1, 1.5)):
            if value and not n1:
                break
            for v, one in zip(values, own, strict=True):
                if v == value:
                    below += one
            if leaf <= left <= n - leaf and 0 < left < n:
                gain = below * below / left + (total - below) * (total - below) / (n - left) - base
                if gain > best:
                    best, found = gain, (gain, f, cut)
    return found


def _best_cut(xt: np.ndarray, rows: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int, total: float) -> tuple[float, int, float] | None:
    """(gain, feature, cut) of the first best cut of those features on those samples; y is that of the rows, total its sum. All features at a
    time; sums run in the order of the sorted rows, so that both kinds of values give the same bits."""
    n = len(y)
    base = total * total / n
    v = xt[features[:, None], rows]
    if v.dtype == np.int8:
        # Two cuts: after 0 and after 1.
        zero, one = v == 0, v == 1
        left = np.empty((len(v), 2), np.int64)
        zero.sum(1, out=left[:, 0])
        one.sum(1, out=left[:, 1])
        left[:, 1] += left[:, 0]
        valid = (left >= max(leaf, 1)) & (n - left >= max(leaf, 1))
        ones = left[:, 1] > left[:, 0]
        valid[:, 1] &= ones
        if not valid.any():
            return None
        both = np.empty((len(v), 2 * n))
        np.multiply(zero, y, out=both[:, :n])
        np.multiply(one, y, out=both[:, n:])
        below = both.cumsum(1)[:, n - 1 :: n]
        left[~valid] = 1
    else:
        order = np.argsort(v, axis=1, kind="stable")
        values = np.take_along_axis(v, order, 1)
        # A cut between every two neighbouring values, however many there are.
        left = np.arange(1, n)[None, :]
        valid = (values[:, 1:] > values[:, :-1]) & (left >= leaf) & (n - left >= leaf)
        if not valid.any():
            return None
        below = np.cumsum(y[order], axis=1)[:, :-1]
    gain = np.where(valid, below**2 / left + (total - below) ** 2 / (n - left) - base, -np.inf)
    f, at = divmod(int(gain.argmax()), gain.shape[1])
    if not gain[f, at] > 1e-12:
        return None
    if v.dtype == np.int8:
        cut = 1.5 if at else (0.5 if ones[f] else 1.0)
    else:
        cut = float((values[f, at] + values[f, at + 1]) / 2)
    return float(gain[f, at]), int(features[f]), cut


#: Samples of a node whose cuts are found in plain loops.
FEW = 24


class Tree:
    """A regression tree grown node by node, of any depth if that is None; importance is the summed drop of squared error by
    feature. Ensembles grow as a Grove; this is the plain form that it is held against."""

    def __init__(self, depth: int | None, leaf: int, per_split: int, rng: np.random.Generator):
        self.depth, self.leaf, self.per_split, self.rng = depth, leaf, per_split, rng

    def fit(self, x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> "Tree":
        return self.grow(np.asarray(x, float).T, np.arange(len(y)), y, importance)

    def grow(self, xt: np.ndarray, samples: np.ndarray, y: np.ndarray, importance: np.ndarray) -> "Tree":
        """Fits to the columns `samples` of features x samples, which may be named more than once; y is theirs."""
        self.nodes: list[tuple] = []
        todo = [(samples, np.asarray(y, float), 0, -1, False)]
        n_features = len(xt)
        per_split = min(self.per_split, n_features)
        while todo:
            at, own, level, parent, is_right = todo.pop()
            me, n = len(self.nodes), len(at)
            if parent >= 0:
                node = self.nodes[parent]
                self.nodes[parent] = (*node[:2], node[2] if is_right else me, me if is_right else node[3], node[4])
            split, total = None, own.sum() if n > 1 else own[0]
            if (self.depth is None or level < self.depth) and n >= 2 * self.leaf:
                features = self.rng.choice(n_features, per_split, replace=False)
                # One sample, drawn several times, has no cut.
                if n > 1 and (at != at[0]).any():
                    split = (_best_of_few if n <= FEW and xt.dtype == np.int8 else _best_cut)(xt, at, own, features, self.leaf, total)
            if split is None:
                self.nodes.append((-1, 0.0, -1, -1, float(total / n)))
                continue
            gain, f, cut = split
            importance[f] += gain
            self.nodes.append((f, cut, -1, -1, 0.0))
            right = xt[f, at] > cut
            left = ~right
            todo += [(at[right], own[right], level + 1, me, True), (at[left], own[left], level + 1, me, False)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.values(np.asarray(x).T)

    def values(self, xt: np.ndarray) -> np.ndarray:
        """Predictions for the columns of features x samples."""
        feature, cut, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        at = np.zeros(xt.shape[1], int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            rows = np.flatnonzero(inner)
            go = xt[feature[at[rows]], rows] > cut[at[rows]]
            at[rows] = np.where(go, right[at[rows]], left[at[rows]])


def _drawn(rng: np.random.Generator, nodes: int, features: int, per_split: int) -> np.ndarray:
    """nodes x per_split features, ascending and all different in a row, every set as likely as any other."""
    if per_split * per_split > 2 * features:
        return np.sort(rng.random((nodes, features)).argpartition(per_split - 1, 1)[:, :per_split], 1)
    out, again = np.empty((nodes, per_split), np.int64), np.arange(nodes)
    # Rows that name a feature twice are drawn anew as a whole; three in five name none.
    while again.size:
        out[again] = np.sort(rng.integers(features, size=(again.size, per_split)), 1)
        again = again[(out[again, 1:] == out[again, :-1]).any(1)]
    return out


def _drawn_by(rngs: list[np.random.Generator], nodes: list[int], features: int) -> np.ndarray:
    """The square root of the features for nodes of several groups, each drawn by its own generator."""
    per_split = max(1, int(np.sqrt(features)))
    return np.concatenate([_drawn(rng, m, features, per_split) for rng, m in zip(rngs, nodes, strict=True) if m])


class Asked:
    """Nodes to be cut: node j has the entries start[j] up to start[j] + size[j] of sample, weight (how often it was drawn) and
    own (its target, that often); n and total are a node's sums of these."""

    def __init__(self, sample: np.ndarray, weight: np.ndarray, own: np.ndarray, node: np.ndarray, nodes: int):
        self.sample, self.weight, self.own, self.node = sample, weight, own, node
        self.size = np.bincount(node, minlength=nodes)
        self.start = np.cumsum(self.size) - self.size
        self.n, self.total = np.bincount(node, weight, nodes), np.bincount(node, own, nodes)

    def __len__(self) -> int:
        return len(self.size)


#: Dosages that are looked at in one array operation.
AT_ONCE = 50_000


def _byte_cuts(values: np.ndarray, pair: np.ndarray, weight: np.ndarray, own: np.ndarray, n: np.ndarray, total: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of every pair of a node and a feature: after 0 or after 1. values, pair, weight, own: an item for each pair
    and entry of its node; n, total: by pair."""
    key, items = pair * 3 + values, 3 * len(n)
    left = np.bincount(key, weight, items).reshape(-1, 3)[:, :2].cumsum(1)
    below = np.bincount(key, own, items).reshape(-1, 3)[:, :2].cumsum(1)
    n, total, ones, least = n[:, None], total[:, None], left[:, 1] > left[:, 0], max(leaf, 1)
    valid = (left >= least) & (n - left >= least)
    valid[:, 1] &= ones
    left = np.where(valid, left, 1)
    # A node of one sample's weight has no valid cut, nor a divisor for one.
    gain = np.where(valid, below**2 / left + (total - below) ** 2 / np.where(valid, n - left, 1) - total**2 / n, -np.inf)
    second = gain[:, 1] > gain[:, 0]
    return gain.max(1), np.where(second, 1.5, np.where(ones, 0.5, 1.0))


def _plain_cut(xt: np.ndarray, asked: Asked, j: int, features: np.ndarray, leaf: int) -> tuple[float, int, float]:
    """(gain, feature, cut) of a node on features of any values."""
    own = slice(asked.start[j], asked.start[j] + asked.size[j])
    times = asked.weight[own].astype(int)
    return _best_cut(xt, np.repeat(asked.sample[own], times), np.repeat(asked.own[own] / asked.weight[own], times), features, leaf, asked.total[j]) or (-np.inf, 0, 0.0)


def best_cuts(xt: np.ndarray, asked: Asked, drawn: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, cut) of every node: the first best cut of its drawn features; gain is -inf where there is none."""
    nodes, k = drawn.shape
    gain, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes)
    if xt.dtype != np.int8:
        for j in range(nodes):
            gain[j], feature[j], cut[j] = _plain_cut(xt, asked, j, drawn[j], leaf)
        return gain, feature, cut
    flat, first = xt.ravel(), 0
    while first < nodes:
        end = max(first + 1, int(np.searchsorted(asked.start + asked.size, asked.start[first] + AT_ONCE // k, side="right")))
        own = slice(asked.start[first], asked.start[end - 1] + asked.size[end - 1])
        node = asked.node[own]
        values = flat.take(drawn[node] * xt.shape[1] + asked.sample[own, None]).ravel()
        pair = ((node - first)[:, None] * k + np.arange(k)).ravel()
        gains, cuts = _byte_cuts(values, pair, np.repeat(asked.weight[own], k), np.repeat(asked.own[own], k), np.repeat(asked.n[first:end], k), np.repeat(asked.total[first:end], k), leaf)
        at = gains.reshape(-1, k).argmax(1)
        rows = np.arange(end - first)
        gain[first:end], feature[first:end], cut[first:end] = gains.reshape(-1, k)[rows, at], drawn[first:end][rows, at], cuts.reshape(-1, k)[rows, at]
        first = end
    return gain, feature, cut


class Grove:
    """Trees that grow together, a level at a time. It holds trees x samples, and never looks at a feature itself: ask() gives
    the nodes that may be cut, tell() takes their cuts, wherever these were found.

    weight: how often each tree drew each sample, 0 for samples that are only to be predicted; target: what the trees fit.
    `out` is every tree's prediction of every sample."""

    def __init__(self, target: np.ndarray, weight: np.ndarray, depth: int | None, leaf: int):
        self.depth, self.leaf, self.level = depth, leaf, 0
        self.trees, self.samples = weight.shape
        self.out = np.zeros(weight.shape)
        tree, self._sample = np.nonzero(weight)
        self._weight = weight[tree, self._sample].astype(float)
        self._own = np.broadcast_to(target, weight.shape)[tree, self._sample] * self._weight
        self._node, self._tree = tree, np.arange(self.trees)
        # Which open node a tree's sample is in; all samples go down the trees.
        self._in, self._all, self._first = np.repeat(self._tree, self.samples), np.arange(weight.size), 0
        self.cuts: list[tuple[np.ndarray, ...]] = []
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def ask(self) -> Asked | None:
        """The nodes that may be cut, none if the trees are grown."""
        m = len(self._tree)
        if not m:
            return None
        n, total, own = np.bincount(self._node, self._weight, m), np.bincount(self._node, self._own, m), np.bincount(self._node, minlength=m)
        self._value = total / n
        self.out.ravel()[self._all] = self._value[self._in]
        # One sample, drawn several times, has no cut.
        may = (n >= 2 * self.leaf) & (own > 1) & (self.depth is None or self.level < self.depth)
        self._may = np.flatnonzero(may)
        if not self._may.size:
            self._close(np.full(m, -1), np.zeros(m), np.full(m, -1))
            self._tree = self._tree[:0]
            return None
        number = np.cumsum(may) - 1
        keep = np.flatnonzero(may[self._node])
        keep = keep[np.argsort(self._node[keep], kind="stable")]
        return Asked(self._sample[keep], self._weight[keep], self._own[keep], number[self._node[keep]], len(self._may))

    def _close(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> None:
        self.nodes.append((feature, cut, child, self._value))
        self._first += len(feature)

    def nodes_of(self, groups: int) -> list[int]:
        """How many of the nodes asked for are in each of so many groups of as many trees; nodes are in the order of trees."""
        return np.bincount(self._tree[self._may] * groups // self.trees, minlength=groups).tolist()

    def tell(self, gain: np.ndarray, feature: np.ndarray, cut: np.ndarray, right: Callable[[np.ndarray], np.ndarray]) -> None:
        """Cuts of the nodes asked for; right(k) says which samples lie above the cut of each of the nodes k, a row each."""
        m, good = len(self._tree), np.flatnonzero(gain > 1e-12)
        split, above = self._may[good], right(good)
        self.cuts.append((self._tree[split], feature[good], gain[good]))
        rank = np.full(m, -1)
        rank[split] = np.arange(len(split))
        of, at, child = np.full(m, -1), np.zeros(m), np.full(m, -1)
        of[split], at[split], child[split] = feature[good], cut[good], self._first + m + 2 * np.arange(len(split))
        self._close(of, at, child)
        r = rank[self._node]
        keep = r >= 0
        self._sample, self._weight, self._own, r = self._sample[keep], self._weight[keep], self._own[keep], r[keep]
        self._node = 2 * r + above[r, self._sample]
        r = rank[self._in]
        keep = r >= 0
        self._all, r = self._all[keep], r[keep]
        self._in = 2 * r + above[r, self._all % self.samples]
        self._tree, self.level = np.repeat(self._tree[split], 2), self.level + 1

    def grow(self, xt: np.ndarray, rngs: list[np.random.Generator]) -> "Grove":
        """Grows on features x samples that are all here, the square root of the features at each node. The first trees draw
        from the first of `rngs`, as many from the next, so no draw depends on trees of another."""
        while (asked := self.ask()) is not None:
            drawn = _drawn_by(rngs, self.nodes_of(len(rngs)), len(xt))
            found = best_cuts(xt, asked, drawn, self.leaf)
            self.tell(*found, lambda k, found=found: xt[found[1][k]] > found[2][k, None])
        return self

    def importance(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tree, feature, gain) of all cuts: the drop of squared error."""
        return tuple(np.concatenate(c) for c in zip(*self.cuts, strict=True)) if self.cuts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def values(self, xt: np.ndarray) -> np.ndarray:
        """Predictions, trees x columns of features x samples."""
        feature, cut, child, value = (np.concatenate(c) for c in zip(*self.nodes, strict=True))
        at = np.repeat(np.arange(self.trees)[:, None], xt.shape[1], 1)
        while True:
            t, s = np.nonzero(feature[at] >= 0)
            if not t.size:
                return value[at]
            own = at[t, s]
            at[t, s] = child[own] + (xt[feature[own], s] > cut[own])


def forest_importance(grove: Grove, trees: range) -> tuple[np.ndarray, np.ndarray]:
    """(features that cut, their importance, which sums to 1) of some trees: a tree's cuts share 1 among them, trees count alike."""
    tree, feature, gain = grove.importance()
    share = gain / np.bincount(tree, gain, grove.trees)[tree]
    own = (tree >= trees.start) & (tree < trees.stop)
    return _summed(feature[own], share[own])


def boosting_importance(groves: list[Grove], tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(features that cut, their importance, which sums to 1) of one tree of each grove: a cut counts by its gain."""
    own = [(f[t == tree], g[t == tree]) for t, f, g in (grove.importance() for grove in groves)]
    return _summed(*(np.concatenate(c) for c in zip(*own, strict=True))) if own else (np.zeros(0, int), np.zeros(0))


def _summed(feature: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(feature, return_inverse=True)
    return names, np.bincount(at, part, len(names)) / (part.sum() or 1.0)


def _dense(n: int, names: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n)
    out[names] = values
    return out


def bootstrap(rng: np.random.Generator, trees: int, rows: np.ndarray, samples: int) -> np.ndarray:
    """trees x samples: how often each of `rows` was drawn, as many draws as rows."""
    drawn = rows[rng.integers(0, len(rows), (trees, len(rows)))]
    return np.bincount((np.arange(trees)[:, None] * samples + drawn).ravel(), minlength=trees * samples).reshape(trees, samples)


def subsampled(rng: np.random.Generator, rows: np.ndarray, samples: int, share: float = 0.8) -> np.ndarray:
    """1 for that share of `rows`, 0 for other samples."""
    out = np.zeros(samples, int)
    out[rng.choice(rows, max(1, int(share * len(rows))), replace=False)] = 1
    return out


def _forests(xt: np.ndarray, targets: list[np.ndarray], rows: list[np.ndarray], trees: int, leaf: int, seeds: list[int]) -> Grove:
    """A forest for each target, on those rows of it."""
    rngs = [np.random.default_rng(s) for s in seeds]
    weight = np.concatenate([bootstrap(rng, trees, r, xt.shape[1]) for rng, r in zip(rngs, rows, strict=True)])
    return Grove(np.repeat(targets, trees, 0), weight, None, leaf).grow(xt, rngs)


def _boostings(xt: np.ndarray, targets: list[np.ndarray], rows: list[np.ndarray], rounds: int, depth: int, rate: float, subsample: float, seeds: list[int]) -> list[Grove]:
    """A grove for each round, with a tree for each target, on those rows of it."""
    rngs, targets, out = [np.random.default_rng(s) for s in seeds], np.asarray(targets), []
    now = np.repeat([[t[r].mean()] for t, r in zip(targets, rows, strict=True)], xt.shape[1], 1)
    for _ in range(rounds):
        weight = np.stack([subsampled(rng, r, xt.shape[1], subsample) for rng, r in zip(rngs, rows, strict=True)])
        out.append(Grove(targets - now, weight, depth, 1).grow(xt, rngs))
        now = now + rate * out[-1].out
    return out


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 300, leaf: int = 1, seed: int = 42):
    """(predict, importance): bootstrap trees, square root of the features at each split, no limit of depth."""
    xt, y = _coded(np.asarray(x)), np.asarray(y, float)
    grove = _forests(xt, [y], [np.arange(len(y))], trees, leaf, [seed])
    return (lambda z: grove.values(np.asarray(z).T).mean(0)), _dense(len(xt), *forest_importance(grove, range(trees)))


def gradient_boosting(x: np.ndarray, y: np.ndarray, rounds: int = 150, depth: int = 3, rate: float = 0.05, subsample: float = 0.8, seed: int = 42):
    """(predict, importance): trees on residuals from the mean, on samples of the rows."""
    xt, y = _coded(np.asarray(x)), np.asarray(y, float)
    groves = _boostings(xt, [y], [np.arange(len(y))], rounds, depth, rate, subsample, [seed])
    return (lambda z: y.mean() + rate * np.sum([g.values(np.asarray(z).T)[0] for g in groves], axis=0)), _dense(len(xt), *boosting_importance(groves, 0))


def mllib_forest(features: DataFrame, trees: int = 500, leaf: int = 1, seed: int = 42):
    """The forest as a distributed pyspark.ml estimator, for more samples than a task holds; columns features, y. Its trees
    are at most 30 deep and values are cut into at most four bins, enough for dosages."""
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(labelCol="y", numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=leaf, maxDepth=30, maxBins=4, seed=seed).fit(features)


def mllib_boosting(features: DataFrame, rounds: int = 300, depth: int = 3, rate: float = 0.05, seed: int = 42):
    """Boosting as a pyspark.ml estimator. Its later trees fit twice the residual, so half the rate is meant."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate / 2, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=seed).fit(features)


# --- screening and refinement ---


def _dosages(column: pa.Array, samples: int) -> np.ndarray:
    """Markers x samples; whole dosages stay bytes, missing ones are NaN."""
    flat = column.flatten()
    flat = flat.cast(pa.float64()) if flat.null_count else flat
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), samples)


def _by_marker(table: pa.Table, samples: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, samples x markers) in the order of ids."""
    order = pc.sort_indices(table, [("marker_id", "ascending")])
    own = _dosages(table.column("dosage").combine_chunks(), samples)
    return table.column("marker_id").combine_chunks().take(order), own[order.to_numpy()].T


def screen(markers: DataFrame, y: np.ndarray, folds: np.ndarray, keep: int | None = 10, trees: tuple[int, int] = (300, 150), depth: int = 3, leaf: int = 1, seed: int = 42, target: dict[int, np.ndarray] | None = None, unit: list[str] | None = None, model_names: tuple[str, ...] = ("RF", "GB"), leaky: bool = False) -> DataFrame:
    """(fold, unit..., marker_id, model, importance, rank): best markers of every unit in every outer fold, all without `keep`.

    A model of a unit (a block, window or chromosome) is a task of its own; the trees of all folds grow together there, each
    fold by its own draws. Only training samples of a fold are looked at, unless `leaky`: then one pass over all samples, fold
    -1. `target` gives another training target by fold (residuals on covariates) in the order of all samples.
    """
    unit = unit or ["chr", "block"]
    seed0, y, folds = seed, np.asarray(y, float), np.asarray(folds)
    schema = ", ".join(["fold int", *[f"{u} {markers.schema[u].dataType.simpleString()}" for u in unit], "marker_id string, model string, importance double, rank int"])
    runs = [-1] if leaky else list(range(int(folds.max()) + 1))
    rows, targets = [np.flatnonzero(folds != f) for f in runs], [np.asarray(target[f] if target else y, float) for f in runs]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        *place, model = (k.as_py() for k in key)
        markers_, x = _by_marker(table, len(y))
        xt, own = _coded(x), sum(map(ord, "|".join(map(str, place)))) % 997
        seeds = [seed0 + 1009 * (f + 1) + own for f in runs]
        if model == "RF":
            grove = _forests(xt, targets, rows, trees[0], leaf, seeds)
            found = [forest_importance(grove, range(k * trees[0], (k + 1) * trees[0])) for k in range(len(runs))]
        else:
            groves = _boostings(xt, targets, rows, trees[1], depth, 0.05, 0.8, seeds)
            found = [boosting_importance(groves, k) for k in range(len(runs))]
        importance = np.array([_dense(len(xt), *f) for f in found])
        best = np.argsort(-importance, 1, kind="stable")[:, :keep]
        n, folds_ = best.shape[1], len(runs)
        columns = [pa.array(np.repeat(runs, n), pa.int32()), *(pa.repeat(pa.scalar(v, table.schema.field(u).type), n * folds_) for u, v in zip(unit, place, strict=True))]
        columns += [markers_.take(pa.array(best.ravel())), pa.repeat(pa.scalar(model), n * folds_), pa.array(np.take_along_axis(importance, best, 1).ravel()), pa.array(np.tile(np.arange(1, n + 1), folds_), pa.int32())]
        return pa.table(columns, names=["fold", *unit, "marker_id", "model", "importance", "rank"])

    models = F.explode(F.array(*[F.lit(m) for m in model_names])).alias("model")
    return markers.select(*unit, F.col("marker_id").cast("string").alias("marker_id"), "dosage", models).groupBy(*unit, "model").applyInArrow(run, schema)


def screening_log(screened: DataFrame, keys: list[str], selected) -> DataFrame:
    """(keys..., n_screened, n_selected): markers that each fold and block looked at, and those that `selected` holds for."""
    return screened.groupBy(*keys).agg(F.count("*").alias("n_screened"), F.count_if(selected).alias("n_selected"))


def refine(markers: DataFrame, candidates: DataFrame, y: np.ndarray, folds: np.ndarray, pcs: np.ndarray | None = None, trees: tuple[int, int] = (500, 300), depth: int = 3, leaf: int = 1, seed: int = 42) -> DataFrame:
    """Joint models on each fold's pooled candidates: one row (fold, kind, key, rf, gb, pc_only).

    kind `prediction`: key is the sample_idx of a held-out sample; kind `importance`: key is a marker id. Candidates are
    few (keep x units x models), their genotypes are gathered by a join and each fold is one task.
    """
    pool = candidates.select("fold", "marker_id").distinct()
    gathered = markers.select(F.col("marker_id").cast("string").alias("marker_id"), "dosage").join(small_side(pool), "marker_id")
    y, folds, n_pcs = np.asarray(y, float), np.asarray(folds), 0 if pcs is None else pcs.shape[1]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fold = key[0].as_py()
        markers_, x = _by_marker(table, len(y))
        if pcs is not None:
            x = np.column_stack([pcs, x])
        train, test = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
        rf, rf_importance = random_forest(x[train], y[train], trees[0], leaf, seed + fold)
        gb, gb_importance = gradient_boosting(x[train], y[train], trees[1], depth, seed=seed + 10_000 + fold)
        c = np.column_stack([np.ones(len(y)), pcs]) if pcs is not None else np.ones((len(y), 1))
        only = c[test] @ np.linalg.lstsq(c[train], y[train], rcond=None)[0]
        n, m = len(test), len(markers_)
        values = [np.concatenate(v) for v in ((rf(x[test]), rf_importance[n_pcs:]), (gb(x[test]), gb_importance[n_pcs:]), (only, np.full(m, np.nan)))]
        keys = pa.chunked_array([pa.array(list(map(str, test)), markers_.type), markers_]).combine_chunks()
        kinds = pa.array(["prediction"] * n + ["importance"] * m)
        columns = [pa.repeat(pa.scalar(fold, pa.int32()), n + m), kinds, keys, *(pa.array(v) for v in values[:2]), pa.array(values[2], mask=np.arange(n + m) >= n)]
        return pa.table(columns, names=["fold", "kind", "key", "rf", "gb", "pc_only"])

    return gathered.groupBy("fold").applyInArrow(run, "fold int, kind string, key string, rf double, gb double, pc_only double")


#: Markers in a file of those that `refine_all` passes over.
FILE_ROWS = 4_000


class _Best:
    """Cuts of the nodes asked for, the best so far: gain, feature, cut, and which samples lie above."""

    def __init__(self, nodes: int, samples: int):
        self.gain, self.feature, self.cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes)
        self.above = np.zeros((nodes, samples), bool)

    def look(self, xt: np.ndarray, number: np.ndarray, asked: Asked, drawn: np.ndarray, leaf: int) -> None:
        """Looks at the drawn features that are among rows of xt, which have these numbers. Of equal gains the smaller number's stays."""
        order = np.argsort(number)
        known = number[order]
        node, slot = np.nonzero((drawn >= known[0]) & (drawn <= known[-1]))
        feature = drawn[node, slot]
        at = np.searchsorted(known, feature)
        here = known[at] == feature
        node, feature, row = node[here], feature[here], order[at[here]]
        if not node.size:
            return
        gain, cut = _pair_cuts(xt, asked, node, row, leaf)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        most = np.maximum.reduceat(gain, first)
        group = np.cumsum(np.diff(node, prepend=-1) != 0) - 1
        # Pairs are in the order of nodes and features: the first of the best ones.
        best = np.flatnonzero(gain == most[group])
        best = best[np.unique(group[best], return_index=True)[1]]
        best = best[gain[best] > 1e-12]
        own = node[best]
        best = best[(gain[best] > self.gain[own]) | ((gain[best] == self.gain[own]) & (feature[best] < self.feature[own]))]
        own = node[best]
        self.gain[own], self.feature[own], self.cut[own], self.above[own] = gain[best], feature[best], cut[best], xt[row[best]] > cut[best, None]


def _pair_cuts(xt: np.ndarray, asked: Asked, node: np.ndarray, row: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of pairs of a node and a row of xt."""
    gain, cut, first = np.full(len(node), -np.inf), np.zeros(len(node)), 0
    if xt.dtype != np.int8:
        for q, (j, r) in enumerate(zip(node, row, strict=True)):
            gain[q], _, cut[q] = _plain_cut(xt, asked, j, np.array([r]), leaf)
        return gain, cut
    flat, ends = xt.ravel(), np.cumsum(asked.size[node])
    while first < len(node):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
        own, size = node[first:end], asked.size[node[first:end]]
        pair = np.repeat(np.arange(end - first), size)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size - asked.start[own], size)
        values = flat.take(row[first:end][pair] * xt.shape[1] + asked.sample[entry])
        gain[first:end], cut[first:end] = _byte_cuts(values, pair, asked.weight[entry], asked.own[entry], asked.n[own], asked.total[own], leaf)
        first = end
    return gain, cut


def _cuts_of_table(table: DataFrame, pcs: np.ndarray, features: int, asked: list[tuple[Asked, int, list[int], list[int]]]) -> list[_Best]:
    """The best cuts of all nodes asked for, with (leaf, nodes of each run, seeds of their draws), over a table of (number, dosage) and the first
    features, which are pcs. Tasks draw alike and look at their own rows; an aggregate keeps the best of a node."""
    samples = len(pcs)

    def draw() -> list[np.ndarray]:
        return [_drawn_by([np.random.default_rng(s) for s in seeds], nodes, features) for _, _, nodes, seeds in asked]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, best = None, [_Best(len(a), samples) for a, *_ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = drawn or draw()
            xt = _coded(_dosages(batch.column(1), samples).T)
            for b, d, (a, leaf, *_) in zip(best, drawn, asked, strict=True):
                b.look(xt, batch.column(0).to_numpy(), a, d, leaf)
        for k, b in enumerate(best):
            own = np.flatnonzero(np.isfinite(b.gain))
            above = pa.array([r.tobytes() for r in np.packbits(b.above[own], axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(own), pa.array(b.gain[own]), pa.array(-b.feature[own]), pa.array(b.cut[own]), above], ["ask", "node", "gain", "before", "cut", "above"])

    out = [_Best(len(a), samples) for a, *_ in asked]
    if not features:
        return out
    if pcs.shape[1]:
        for b, d, (a, leaf, *_) in zip(out, draw(), asked, strict=True):
            b.look(np.ascontiguousarray(pcs.T), np.arange(pcs.shape[1]), a, d, leaf)
    found = table.select("number", "dosage").mapInArrow(work, "ask int, node bigint, gain double, before bigint, cut double, above binary")
    for r in found.groupBy("ask", "node").agg(F.max(F.struct("gain", "before", "cut", "above")).alias("b")).collect():
        b, j, own = out[r["ask"]], r["node"], r["b"]
        if own["gain"] > b.gain[j]:
            b.gain[j], b.feature[j], b.cut[j] = own["gain"], -own["before"], own["cut"]
            b.above[j] = np.unpackbits(np.frombuffer(own["above"], np.uint8), count=samples)
    return out


def refine_all(markers: DataFrame, y: np.ndarray, folds: np.ndarray, pcs: np.ndarray | None = None, trees: tuple[int, int] = (500, 300), depth: int = 3, leaf: int = 1, seed: int = 42, rate: float = 0.05) -> DataFrame:
    """Joint models of all markers, of any number: rows as `refine` has them, predictions of every fold's held-out samples and,
    as fold -1, importances of the models of all samples for every marker.

    No task holds the markers as a whole: they are numbered and stored, the trees of all folds grow together, and a level of
    them is a pass in which every task looks at its own markers. The driver holds trees x samples. Passes are as many as
    levels: those of the deepest tree of the forests, or depth times rounds of boosting, which go along.
    """
    named = stored(markers.select(F.col("marker_id").cast("string").alias("marker_id"), "dosage"), "named")
    y, folds, n = np.asarray(y, float), np.asarray(folds), len(y)
    pcs, count = np.zeros((n, 0)) if pcs is None else np.asarray(pcs, float), named.count()
    numbers = numbered(named, [F.asc("marker_id")], "number").withColumn("number", F.col("number") - 1 + pcs.shape[1])
    table = stored(numbers.repartition(count // FILE_ROWS + 1), "features")
    discard(named)
    runs = [-1, *range(int(folds.max()) + 1)]
    rows = [np.flatnonzero(folds != f) for f in runs]
    rngs = [[np.random.default_rng(seed + extra + f) for f in runs] for extra in (0, 10_000)]
    forest = Grove(y, np.concatenate([bootstrap(rng, trees[0], r, n) for rng, r in zip(rngs[0], rows, strict=True)]), None, leaf)
    now, rounds = np.repeat([[y[r].mean()] for r in rows], n, 1), []

    def boosted() -> Asked | None:
        """Nodes of the round that goes on, or of the next one; none after the last."""
        nonlocal now
        while True:
            asked = rounds[-1].ask() if rounds else None
            if asked is not None:
                return asked
            now = now + rate * rounds[-1].out if rounds else now
            if len(rounds) == trees[1]:
                return None
            rounds.append(Grove(y - now, np.stack([subsampled(rng, r, n) for rng, r in zip(rngs[1], rows, strict=True)]), depth, 1))

    growing = [True, True]
    while any(growing):
        asked = [ask() if go else None for go, ask in zip(growing, (forest.ask, boosted), strict=True)]
        growing = [a is not None for a in asked]
        groves = [(g, a, own) for g, a, own in zip((forest, rounds[-1] if rounds else None), asked, rngs, strict=True) if a is not None]
        if groves:
            # A run draws by its own seeds, so no prediction depends on what other runs see.
            best = _cuts_of_table(table, pcs, count + pcs.shape[1], [(a, g.leaf, g.nodes_of(len(runs)), [int(rng.integers(2**62)) for rng in own]) for g, a, own in groves])
            for (g, *_), b in zip(groves, best, strict=True):
                g.tell(b.gain, b.feature, b.cut, lambda k, b=b: b.above[k])
    spark, c, predicted = markers.sparkSession, np.column_stack([np.ones(n), pcs]), []
    for k, f in enumerate(runs[1:], 1):
        test, rf = np.flatnonzero(folds == f), forest.out[k * trees[0] : (k + 1) * trees[0]].mean(0)
        only = c[test] @ np.linalg.lstsq(c[rows[k]], y[rows[k]], rcond=None)[0]
        predicted += [(f, "prediction", str(s), float(rf[s]), float(now[k, s]), float(o)) for s, o in zip(test, only, strict=True)]
    cut = [dict(zip(*(v.tolist() for v in own), strict=True)) for own in (forest_importance(forest, range(trees[0])), boosting_importance(rounds, 0))]
    used = spark.createDataFrame([(f, cut[0].get(f, 0.0), cut[1].get(f, 0.0)) for f in sorted({*cut[0], *cut[1]})], "number bigint, rf double, gb double")
    of = table.select("number", "marker_id").join(F.broadcast(used), "number", "left")
    importance = of.select(F.lit(-1).alias("fold"), F.lit("importance").alias("kind"), F.col("marker_id").alias("key"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("rf", "gb")], F.lit(None).cast("double").alias("pc_only"))
    return spark.createDataFrame(predicted, "fold int, kind string, key string, rf double, gb double, pc_only double").unionByName(importance)


def importance_table(refined: DataFrame, candidates: DataFrame, n_folds: int, selection_scope: str = "model") -> DataFrame:
    """Mean importances over all folds (0 where a marker was not in the pool), folds that selected it, min ranks.

    selection_scope `model`: a fold counts for a model if that model's screening chose the marker; `pool`: for both.
    """
    from .testing import min_rank

    mean = refined.where("kind = 'importance'").groupBy(F.col("key").alias("marker_id")).agg((F.sum("rf") / n_folds).alias("rf_mean_importance"), (F.sum("gb") / n_folds).alias("gb_mean_importance"))
    chosen = candidates.groupBy("marker_id").agg(*[F.count_distinct(F.when(F.lit(selection_scope == "pool") | (F.col("model") == m), F.col("fold"))).cast("int").alias(f"{m.lower()}_selection_folds") for m in ("RF", "GB")])
    out = mean.join(chosen, "marker_id")
    return min_rank(min_rank(out, "rf_mean_importance", "rf_rank"), "gb_mean_importance", "gb_rank")


def accumulate_importance(rows: DataFrame, n_folds: int, keys: list[str], value: str = "importance") -> DataFrame:
    """Sum over folds by the number of folds: a fold without the marker counts as 0."""
    return rows.groupBy(*keys).agg((F.sum(value) / n_folds).alias("mean_importance"))


def selection_folds(rows: DataFrame, scope: str = "model", marker: str = "marker_id", model: str = "model", fold: str = "fold") -> DataFrame:
    keys = [marker, model] if scope == "model" else [marker]
    return rows.groupBy(*keys).agg(F.count_distinct(fold).alias("selection_folds"))
