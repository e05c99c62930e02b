"""Report and plot data: Manhattan and QQ coordinates, recovery of planted markers, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import short_id
from .joins import nearest
from .ml import metrics
from .testing import bonferroni, counts_before, genomic_inflation, quantiles


def offsets(markers: DataFrame, chr_: str = "chr", pos: str = "pos", lengths: DataFrame | None = None, ticks: str = "middle") -> DataFrame:
    """(chr, length, offset, tick): chromosome lengths (given, or the greatest position) summed up before each."""
    sizes = lengths.select(chr_, F.col("length").alias("length")) if lengths is not None else markers.groupBy(chr_).agg(F.max(pos).alias("length"))
    before = F.coalesce(F.sum("length").over(Window.orderBy(chr_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    out = sizes.withColumn("offset", before)
    if ticks == "middle":
        return out.withColumn("tick", F.col("offset") + F.col("length") / 2)
    spans = markers.groupBy(chr_).agg(F.min(pos).alias("__a"), F.max(pos).alias("__b"))
    return out.join(spans, chr_).withColumn("tick", F.col("offset") + (F.col("__a") + F.col("__b")) / 2).drop("__a", "__b")


def chromosome_lengths(markers: DataFrame, given: DataFrame | None = None, chr_: str = "chr", pos: str = "pos", margin: float = 1.05) -> DataFrame:
    """(chr, length): from the manifest where it says so, else the greatest position and a margin."""
    seen = markers.groupBy(chr_).agg(F.floor(F.max(pos) * margin).cast("bigint").alias("__seen"))
    if given is None:
        return seen.withColumnRenamed("__seen", "length")
    return seen.join(F.broadcast(given.select(chr_, "length")), chr_, "left").select(chr_, F.coalesce("length", "__seen").cast("bigint").alias("length"))


def manhattan(results: DataFrame, p: str = "p", floor: float = 1e-300, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """results with x (cumulative position), y (-log10 p) and a colour by chromosome."""
    at = offsets(results, chr_, pos).select(chr_, "offset", F.pmod(F.row_number().over(Window.orderBy(chr_)) - 1, F.lit(2)).alias("colour"))
    return results.join(F.broadcast(at), chr_).withColumn("x", F.col("offset") + F.col(pos)).withColumn("y", -F.log10(F.greatest(F.col(p), F.lit(floor)))).drop("offset")


def qq(results: DataFrame, p: str = "p", floor: float = 1e-300) -> DataFrame:
    """(p, n, expected, observed): -log10 of p and of its expected value (rank - 0.5)/m, one row for each distinct p.

    Rows of equal p stand for a run of ranks; the middle rank of the run is taken."""
    rank = F.col("before") + F.col("n") - (F.col("n") - 1) / 2
    observed = -F.log10(F.greatest("v", F.lit(floor)))
    return counts_before(results, p).select(F.col("v").alias("p"), "n", (-F.log10((rank - 0.5) / F.col("total"))).alias("expected"), observed.alias("observed"))


def rank_quantiles(recovered: DataFrame, rank: str, candidates: int) -> DataFrame:
    """(i, expected, observed): sorted ranks of planted markers over all candidates against i/(k+1); equal ranks count on."""
    places = counts_before(recovered, rank).withColumn("i", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
    return places.select("i", (F.col("i") / (F.col("total") + 1)).alias("expected"), (F.col("v") / candidates).alias("observed"))


def regional(results: DataFrame, chromosome: int, span: tuple[int, int], gene: tuple[int, int], p: str = "p", alpha: float = 0.05, floor: float = 1e-300, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """A region's points: y (-log10 p), a label where p is significant among all results, and whether the gene holds it."""
    region = bonferroni(results, p).where((F.col(chr_) == chromosome) & F.col(pos).between(*span))
    label = F.when(F.col("bonferroni") < alpha, short_id(chr_, pos)).otherwise("")
    return region.withColumn("label", label).withColumn("in_gene", F.col(pos).between(*gene)).withColumn("y", -F.log10(F.greatest(F.col(p), F.lit(floor))))


def zoom_pairs(points: DataFrame, most_expected: float, most_observed: float) -> DataFrame:
    """Points of a QQ table inside a zoomed view: both coordinates at most their limit."""
    return points.where((F.col("expected") <= most_expected) & (F.col("observed") <= most_observed))


def importance_manhattan(importance: DataFrame, value: str, truth: DataFrame, top_n: int = 50, marker: str = "marker_id", chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """importance with x (cumulative position), `threshold` (the value of the top_n-th marker), in_top and planted."""
    at = offsets(importance, chr_, pos).select(chr_, "offset")
    least = importance.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(top_n).agg(F.min(value).alias("threshold"))
    stars = truth.select(F.col(marker)).distinct().withColumn("__star", F.lit(True))
    out = importance.join(F.broadcast(at), chr_).withColumn("x", F.col("offset") + F.col(pos)).crossJoin(F.broadcast(least)).join(stars, marker, "left")
    return out.withColumn("in_top", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False))).withColumn("planted", F.coalesce("__star", F.lit(False))).drop("offset", "__star")


def predicted_vs_actual(oof: DataFrame, y: str, prediction: str) -> DataFrame:
    """(actual, predicted, residual, r2): points of a scored table with the score of all of them."""
    score = metrics(oof.where(F.col(prediction).isNotNull()), y, prediction).select("r2")
    points = oof.where(F.col(prediction).isNotNull()).select(F.col(y).alias("actual"), F.col(prediction).alias("predicted"), (F.col(y) - F.col(prediction)).alias("residual"))
    return points.crossJoin(F.broadcast(score))


def fold_scores(oof: DataFrame, y: str, predictions: list[str], fold: str = "fold") -> DataFrame:
    """(model, fold, r2) bars; models whose column the table does not have are left out."""
    out = None
    for p in (p for p in predictions if p in oof.columns):
        rows = metrics(oof.where(F.col(p).isNotNull()), y, p, [fold]).select(F.lit(p).alias("model"), fold, "r2")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else oof.sparkSession.createDataFrame([], "model string, fold int, r2 double")


def ld_map(pairs: DataFrame, markers: DataFrame, hits: DataFrame, marker: str = "marker_id") -> DataFrame:
    """(i, j, r2, label_i, label_j): both triangles and the diagonal of a region's r2 by the markers' places in position order; hits have a label."""
    labelled = markers.select(marker, "pos").join(hits.select(marker).distinct().withColumn("__hit", F.lit(True)), marker, "left")
    # A region's markers are few; their places are those of one sorted region.
    places = labelled.select(F.col(marker).alias("m"), (F.row_number().over(Window.orderBy("pos", marker)) - 1).alias("at"), F.when(F.col("__hit"), F.col(marker).cast("string")).otherwise("").alias("label"))
    cells = pairs.select("a", "b", "r2").union(pairs.select("b", "a", "r2")).union(places.select(F.col("m").alias("a"), F.col("m").alias("b"), F.lit(1.0).alias("r2")))
    side = lambda c, k: places.select(F.col("m").alias(c), F.col("at").alias(k), F.col("label").alias(f"label_{k}"))
    return cells.join(side("a", "i"), "a").join(side("b", "j"), "b").select("i", "j", "r2", "label_i", "label_j")


def causal_recovery(truth: DataFrame, importance: DataFrame, rank: str, top: int = 50, within: int = 60_000, marker: str = "marker_id") -> DataFrame:
    """Per planted marker: its rank, whether it is in the top, whether a top marker is near, and the nearest one's distance."""
    ranked = truth.join(importance.select(marker, F.col(rank).alias("final_rank")), marker, "left")
    best = importance.where(F.col(rank) <= top).select("chr", "pos", F.col(marker).alias("near_marker"))
    at = nearest(truth.select(marker, "chr", F.col("pos").alias("locus_pos")), best, marker, within)
    at = at.select(marker, F.coalesce("hit", F.lit(False)).alias("any_top_within"), F.col("distance").alias("best_top_distance"))
    return ranked.join(at, marker).withColumn("in_top", F.coalesce(F.col("final_rank") <= top, F.lit(False)))


def nearest_loci(loci: DataFrame, lists: dict[str, DataFrame], within: int = 100_000, locus: str = "locus_id") -> DataFrame:
    """(list, locus, rank, distance, marker, status): nearest ranked marker of every list; the rank only if near enough."""
    out = None
    for name, ranked in lists.items():
        found = nearest(loci.select(locus, "chr", "locus_pos"), ranked.select("chr", "pos", "rank", "marker_id"), locus, within, tie=["rank", "marker_id"])
        status = F.when(F.col("distance").isNull(), "no marker on chromosome").when(F.col("hit"), "near").otherwise("not in top list")
        rows = found.select(F.lit(name).alias("list"), locus, F.when(F.col("hit"), F.col("rank")).cast("double").alias("rank"), "distance", F.col("marker_id").alias("marker"), status.alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


def aggregate_runs(runs: DataFrame, by: list[str], values: list[str], flags: list[str]) -> DataFrame:
    """Mean, sd (ddof 1), min, max of values, any of flags and the number of runs, by scenario."""
    aggs = [F.count("*").alias("n_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    aggs += [F.bool_or(f).alias(f"{f}_any") for f in flags]
    return runs.groupBy(*by).agg(*aggs)


def unpivot_models(runs: DataFrame, keys: list[str], columns: dict[str, str], value: str) -> DataFrame:
    """One row for each run and model from a column for each model."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias(value)) for m, c in columns.items()])
    return runs.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.model", f"x.{value}")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_a, n_b, n_both) of two id lists."""
    both = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full")
    return both.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"))


def qqplot_pairs(a: DataFrame, b: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """(k, a, b): sorted values of two results against each other at `bins` quantiles, found by counted places."""
    probabilities = [(k + 0.5) / bins for k in range(bins)]
    sides = [quantiles(df, value, probabilities).select("probability", F.col("quantile").alias(name)) for df, name in ((a, "a"), (b, "b"))]
    k = F.round(F.col("probability") * bins - 0.5).cast("int").alias("k")
    return sides[0].join(sides[1], "probability").select(k, "a", "b")


def model_comparison(results: dict[str, DataFrame], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """(model, n, lambda_gc, n_bonferroni, best_p): one row for each scan of the same trait, for a table of their inflation."""
    out = None
    for name, found in results.items():
        n = F.count(p)
        counts = found.agg(n.alias("n"), F.min(p).alias("best_p"))
        hits = bonferroni(found.select(p), p).agg(F.count_if(F.col("bonferroni") < alpha).alias("n_bonferroni"))
        row = counts.crossJoin(hits).crossJoin(genomic_inflation(found, p)).select(F.lit(name).alias("model"), "n", "lambda_gc", "n_bonferroni", "best_p")
        out = row if out is None else out.unionByName(row)
    return out
