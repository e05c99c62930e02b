"""End-to-end plans: genome scan, mixed-model scan, nested screen and refine, conditional scan, multi-seed benchmark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, ml, qc, reports, scan, simulate, structure, testing
from ..operators.samples import require_order
from ..sources.sinks import append_run
from ..sources.stored import discard, stored


def genome_scan(markers: DataFrame, y: np.ndarray, low_maf: float = 0.05, n_pcs: int = 10, thin: int | None = 100_000, ploidy: int = 2, samples: list | None = None) -> DataFrame:
    """Frequency filter, principal components of thinned markers, covariate-adjusted scan, adjusted p values.

    The markers are read twice (components, scan) and never shuffled; only p values are. `samples` are the phenotype's ids in
    its order, which must be the markers' order where these say one.
    """
    require_order(markers, samples, named=True)
    kept = qc.maf_filter(markers, ploidy, low_maf)
    covariates = None
    if n_pcs:
        thinned = kept
        if thin:
            keep = qc.thin_by_distance(kept, thin)
            thinned = kept.join(keep, ["chr", "pos"], "left_semi")
        few = len(y) <= structure.MOST_SAMPLES
        covariates = structure.principal_components(thinned, n_pcs)[0] if few else components.components(stored(thinned, "thinned"), len(y), n_pcs).scores
    # Statistics are a few numbers a marker and are used three times; genotypes must not be scanned again for that.
    found = stored(scan.scan(kept, scan.covariate_basis(y, covariates, samples)), "scan")
    return testing.corrected(found)


def mixed_scan(markers: DataFrame, y: np.ndarray, n_covariates: int = 3, low_maf: float = 0.01, ploidy: int = 2, kinship: np.ndarray | None = None, rank: int | None = None, delta: float | None = None, samples: list | None = None) -> DataFrame:
    """Mixed-model scan with kinship and its first eigenvectors; variance components are estimated once for all blocks.

    With `rank`, kinship is its first eigenvectors and one value for all other directions, found without a samples x samples
    matrix; that is for more samples than a square matrix of them can be held. `samples` as in genome_scan."""
    require_order(markers, samples, named=True)
    kept = qc.maf_filter(markers, ploidy, low_maf)
    if rank is None:
        k = structure.kinship_vanraden(kept) if kinship is None else kinship
        basis, delta = scan.mixed_basis(y, k, structure.kinship_covariates(k, n_covariates) if n_covariates else None, samples)
    else:
        kept = stored(kept, "kept-markers")
        found = components.components(kept, len(y), rank, "vanraden")
        others = len(y) - found.vectors.shape[1]
        rest = max(0.0, (found.trace - found.values.sum()) / others) if others else 0.0
        basis, delta = scan.low_rank_basis(y, found.vectors, found.values, found.vectors[:, :n_covariates], rest, delta, samples)
    return testing.benjamini_hochberg(stored(scan.scan(kept, basis), "scan")).withColumn("delta", F.lit(delta))


def conditional_scan(markers: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, marker: str = "marker_id", samples: list | None = None) -> DataFrame:
    """(marker, p, p_conditional, significant before and after): the best marker becomes a covariate of a second scan.
    `samples` as in genome_scan."""
    require_order(markers, samples, named=True)
    first = stored(scan.scan(markers, scan.covariate_basis(y, covariates, samples)).select(marker, "p"), "scan")
    lead = scan.lead_marker(first, marker)
    row = markers.join(F.broadcast(lead.select(marker)), marker, "left_semi").select(marker, "dosage").limit(1).collect()
    if not row:
        return first.withColumn("p_conditional", F.lit(None).cast("double"))
    second = scan.scan(markers.where(F.col(marker) != row[0][marker]), scan.conditional_basis(y, covariates, np.array(row[0]["dosage"], float), samples))
    out = first.join(second.select(marker, F.col("p").alias("p_conditional")), marker, "left")
    m = first.agg(F.count("*").alias("m"))
    return out.withColumn("lead", F.col(marker) == row[0][marker]).crossJoin(F.broadcast(m)).withColumn("significant", F.col("p") < 0.05 / F.col("m")).withColumn("significant_conditional", F.col("p_conditional") < 0.05 / F.col("m")).drop("m")


def nested_cv(markers: DataFrame, y: np.ndarray, k: int = 5, seed: int = 42, keep: int = 10, stage1: tuple[int, int] = (300, 150), stage2: tuple[int, int] = (500, 300), unit: list[str] | None = None, pcs: np.ndarray | None = None, residual_target: bool = False, depth: int = 3, leaf: int = 1) -> tuple[DataFrame, DataFrame]:
    """(candidates, refined) of the leakage-safe design: screening sees a fold's training samples only."""
    folds = ml.kfold(len(y), k, seed)
    target = None
    if residual_target and pcs is not None:
        target = {}
        for f in range(k):
            train = folds != f
            c = np.column_stack([np.ones(len(y)), pcs])
            target[f] = y - c @ np.linalg.lstsq(c[train], y[train], rcond=None)[0]
    candidates = stored(ml.screen(markers, y, folds, keep, stage1, depth, leaf, seed, target, unit), "candidates")
    return candidates, stored(ml.refine(markers, candidates, y, folds, pcs, stage2, depth, leaf, seed), "refined")


def leaky_two_stage(markers: DataFrame, y: np.ndarray, keep_per_block: int = 25, k: int = 5, seed: int = 42, stage1: tuple[int, int] = (300, 150), stage2: tuple[int, int] = (500, 300), unit: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The design whose screening sees all samples: the best keep x blocks of each model as a whole, then one joint model."""
    unit = unit or ["chr", "block"]
    folds = ml.kfold(len(y), k, seed)
    n_blocks = markers.select(*unit).distinct().count()
    screened = stored(ml.screen(markers, y, folds, None, stage1, seed=seed, unit=unit, leaky=True), "screened")
    best = [testing.top(screened.where(F.col("model") == m), keep_per_block * n_blocks, [F.desc("importance"), F.asc("marker_id")]) for m in ("RF", "GB")]
    pool = stored(best[0].unionByName(best[1]), "pool")
    discard(screened)
    every = pool.drop("fold").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return pool, ml.refine(markers, every, y, folds, None, stage2, seed=seed)


def predict_and_refit(markers: DataFrame, y: np.ndarray, k: int = 5, seed: int = 42, trees: tuple[int, int] = (500, 300), depth: int = 3, leaf: int = 1, pcs: np.ndarray | None = None) -> DataFrame:
    """Out-of-fold predictions of every sample, then the same models on all samples: (fold, kind, key, rf, gb, pc_only).

    Rows of kind `prediction` come from the fold that held the sample out; rows of kind `importance` with fold -1 from the
    refit. All markers may be cut by every tree, and no task holds them all.
    """
    return ml.refine_all(markers, y, ml.kfold(len(y), k, seed), pcs, trees, depth, leaf, seed)


def synthetic_benchmark(spark: SparkSession, chromosomes: list[tuple[int, int, int, int]], samples: int, seed: int, causal: int = 20, linked: bool = False, bins: list[tuple[float, float, float]] | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(markers, planted, y): generated genotypes, planted markers with unit-norm effects, simulated phenotype."""
    markers = stored(simulate.genotypes(simulate.block_plan(spark, chromosomes), samples, seed, bins, linked), "markers")
    planted = simulate.pick_causal(markers, causal, seed).collect()
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=len(planted))
    weights /= np.linalg.norm(weights)
    y = simulate.phenotype(np.array([r["dosage"] for r in planted], float), weights, seed)
    truth = spark.createDataFrame([(r["marker_id"], r["chr"], r["pos"], r["maf"], float(w)) for r, w in zip(planted, weights, strict=True)], "marker_id string, chr int, pos bigint, maf double, weight double")
    return markers, truth, y


def multi_seed(spark: SparkSession, seeds: list[int], run: Callable[[SparkSession, int], dict]) -> DataFrame:
    """One row of results for each seed."""
    return spark.createDataFrame([{"seed": s, **run(spark, s)} for s in seeds])


def multi_seed_validation(spark: SparkSession, path: str, scenarios: dict[str, dict], seeds: list[int], samples: int, k: int = 3, keep: int = 10, stage1: tuple[int, int] = (150, 75), stage2: tuple[int, int] = (250, 150)) -> DataFrame:
    """Runs of the nested design on generated data, one for each scenario and seed, and their summary by scenario and model.

    `scenarios` holds the arguments of `synthetic_benchmark` by name. Every finished run is appended to the table at `path`
    before the next one begins; a run that is there already is not made again, so a broken series goes on where it stopped.
    What a run stores on its way is removed after it.
    """
    planned = spark.createDataFrame([(name, s) for name in scenarios for s in seeds], "scenario string, seed int")
    done = existing(spark, path)
    todo = planned if done is None else qc.pending_blocks(planned, done, ["scenario", "seed"])
    for row in sorted(todo.collect()):
        markers, truth, y = synthetic_benchmark(spark, samples=samples, seed=row["seed"], **scenarios[row["scenario"]])
        candidates, refined = nested_cv(markers, y, k, keep=keep, stage1=stage1, stage2=stage2)
        oof = refined.where("kind = 'prediction'").select(F.col("key").cast("int").alias("sample_idx"), "rf", "gb")
        both = oof.join(spark.createDataFrame(list(enumerate(y.tolist())), "sample_idx int, y double"), "sample_idx")
        score = {m: ml.metrics(both, "y", m).first() for m in ("rf", "gb")}
        found = recovery(markers, truth, refined, candidates, k).where("in_top").count()
        rows = [(row["scenario"], row["seed"], m, float(score[m]["r2"]), float(score[m]["rmse"]), found) for m in ("rf", "gb")]
        append_run(spark.createDataFrame(rows, "scenario string, seed int, model string, r2 double, rmse double, n_recovered bigint"), path, ["scenario", "seed", "model"])
        discard(markers, candidates, refined)
    runs = spark.read.parquet(path).join(F.broadcast(planned), ["scenario", "seed"], "left_semi").withColumn("recovered", F.col("n_recovered") > 0)
    return reports.aggregate_runs(runs, ["scenario", "model"], ["r2", "rmse"], ["recovered"])


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resume(planned: DataFrame, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all planned units: those without a result at `path` are run and appended, the others are read."""
    spark = planned.sparkSession
    done = existing(spark, path)
    pending = planned if done is None else qc.pending_blocks(planned, done, keys)
    if done is None or pending.limit(1).count():
        append_run(run(pending), path, keys)
    return spark.read.parquet(path)


def recovery(markers: DataFrame, truth: DataFrame, refined: DataFrame, candidates: DataFrame, n_folds: int, top: int = 50) -> DataFrame:
    """Planted markers against the ranking; truth is joined here and nowhere before."""
    places = markers.select("marker_id", "chr", "pos").dropDuplicates(["marker_id"])
    table = ml.importance_table(refined, candidates, n_folds).join(places, "marker_id", "left")
    return reports.causal_recovery(truth, table, "rf_rank", top)
