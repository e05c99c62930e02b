"""Joins by id, by position and to the nearest locus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.stored import discard, stored

#: Rows of a side that may be broadcast.
SMALL = 200_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it is known to have few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def align(samples: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `other` in the order of `samples`: sample_idx from 0, unmatched samples with nulls."""
    numbered = samples.select(key, (F.row_number().over(Window.orderBy(order)) - 1).alias("sample_idx"))
    return numbered.join(other, key, "left")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(key), key, "left_anti")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right has."""
    return left.join(right.select(key), key, "left_semi")


def require_matched(left: DataFrame, right: DataFrame, key: str, what: str = "ids") -> DataFrame:
    """left, after it has been made sure that right has every key of it; an error names some that are missing."""
    lost = [r[key] for r in unmatched(left, right, key).select(key).limit(5).collect()]
    if lost:
        raise ValueError(f"{what} without a match: {', '.join(map(str, lost))}")
    return left


def join_matched(left: DataFrame, right: DataFrame, key: str, what: str = "ids") -> DataFrame:
    """left joined with right, stored, after it has been made sure that right has every key; left is computed once for both."""
    met = stored(left.join(right.withColumn("__known", F.lit(True)), key, "left"), "matched")
    lost = [r[key] for r in met.where("__known is null").select(key).limit(5).collect()]
    if lost:
        discard(met)
        raise ValueError(f"{what} without a match: {', '.join(map(str, lost))}")
    return met


def grid(spark, **axes: int) -> DataFrame:
    """Every combination of numbers from 0 below each axis's size."""
    out = None
    for name, size in axes.items():
        one = spark.range(size).withColumnRenamed("id", name)
        out = one if out is None else out.crossJoin(one)
    return out


def grid_of(*axes: DataFrame) -> DataFrame:
    """Every combination of the rows of small tables, such as scenarios, seeds and folds; a table of many rows is an error."""
    out = None
    for axis in axes:
        if axis.limit(SMALL + 1).count() > SMALL:
            raise ValueError(f"an axis of more than {SMALL} rows")
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out


def merge_suffixed(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two results; other columns get the suffixes."""
    named = [df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys]) for df, s in zip((a, b), suffixes, strict=True)]
    return named[0].join(named[1], keys)


def square_subset(matrix: DataFrame, ids: DataFrame, key: str = "id", i: str = "i", j: str = "j", strict: bool = True) -> DataFrame:
    """Cells of a long square matrix whose row and column are both among the ids, with their new places. An id that the
    matrix does not have is an error, or left out where not `strict`."""
    if strict:
        require_matched(ids.select(key), matrix.select(F.col(i).alias(key)).distinct(), key, "matrix ids")
    a = ids.select(F.col(key).alias(i), F.col("idx").alias("row"))
    b = ids.select(F.col(key).alias(j), F.col("idx").alias("col"))
    return matrix.join(small_side(a), i).join(small_side(b), j)


def within_distance(markers: DataFrame, loci: DataFrame, distance: int, how: str = "inner", chr_: str = "chr", pos: str = "pos", locus_pos: str = "locus_pos") -> DataFrame:
    """Marker-locus pairs on one chromosome at most `distance` apart.

    Both sides are cut into bins as wide as the distance; a locus is listed in its bin and the two beside it, so each pair
    meets in exactly one bin and a marker is tested against the loci of three bins, not of its chromosome. A locus table that
    is counted to be small is broadcast in that form.
    """
    width = max(1, distance)
    near = F.abs(F.col(pos) - F.col(locus_pos)) <= distance
    binned = loci.withColumnRenamed(chr_, "__chr").withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(locus_pos) / width) + d)))
    left = markers.withColumn("__at", F.floor(F.col(pos) / width))
    out = left.join(small_side(binned), (F.col(chr_) == F.col("__chr")) & (F.col("__at") == F.col("__bin")) & near, how)
    return out.drop("__at", "__bin", "__chr")


def nearest(loci: DataFrame, markers: DataFrame, locus: str, most: int | None = None, chr_: str = "chr", pos: str = "pos", locus_pos: str = "locus_pos", tie: list[str] | None = None, bins: int = 4096) -> DataFrame:
    """Every locus with its nearest marker of the chromosome and their distance; `hit` says if that is at most `most`.

    Ties go by the tie columns. Loci on a chromosome without markers keep nulls. Positions are cut into `bins` bins: a locus
    meets the markers of its own bin, the last marker of the filled bin before and the first one of the filled bin after,
    which two windows over the bins find. So a locus meets a bin's markers, not a chromosome's.
    """
    right = markers.withColumnRenamed(chr_, "__chr")
    rest = [c for c in right.columns if c not in ("__chr", pos)]
    tie = tie or rest
    reach = right.agg(F.max(pos)).first()[0]
    width = max(1, int(reach or 0) // bins + 1)
    marker = F.struct(*[F.col(t) for t in tie], *[F.col(c) for c in [*rest, pos] if c not in tie])
    packed = right.select("__chr", F.floor(F.col(pos) / width).alias("__bin"), F.col(pos).alias("__pos"), marker.alias("__m"))
    ends = packed.groupBy("__chr", "__bin").agg(F.min(F.struct("__pos", "__m")).alias("__first"), F.min(F.struct(-F.col("__pos"), F.col("__m"))).alias("__last"))
    places = loci.select(locus, F.col(chr_).alias("__chr"), locus_pos, F.floor(F.col(locus_pos) / width).alias("__bin"))
    # Bins that a locus or a marker is in; their number does not grow with the markers.
    w = Window.partitionBy("__chr").orderBy("__bin")
    every = places.select("__chr", "__bin").distinct().join(ends, ["__chr", "__bin"], "full")
    around = every.select("__chr", "__bin", F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__last"), F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__first"))
    beside = places.join(around, ["__chr", "__bin"]).select(locus, locus_pos, F.explode(F.array("__last.__m", "__first.__m")).alias("__m")).where("__m is not null")
    own = packed.select("__chr", "__bin", "__m").join(small_side(places), ["__chr", "__bin"]).select(locus, locus_pos, "__m")
    met = own.unionByName(beside)
    found = met.groupBy(locus).agg(F.min(F.struct(F.abs(F.col(f"__m.{pos}") - F.col(locus_pos)).alias("distance"), F.col("__m"))).alias("__best"))
    out = loci.join(found.select(locus, "__best.distance", "__best.__m.*"), locus, "left")
    return out.withColumn("hit", F.col("distance") <= most) if most is not None else out


def in_regions(points: DataFrame, regions: DataFrame, chr_: str = "chr", pos: str = "pos", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Points in closed intervals, one row for each pair. A region is listed in the bins that it touches, which are as wide as
    regions are on average, so a point meets the regions of its bin only."""
    right = regions.withColumnRenamed(chr_, "__chr").where(F.col(lo) <= F.col(hi))
    width = max(1, int(right.agg(F.avg(F.col(hi) - F.col(lo) + 1)).first()[0] or 1))
    listed = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    inside = (F.col(chr_) == F.col("__chr")) & (F.floor(F.col(pos) / width) == F.col("__bin")) & F.col(pos).between(F.col(lo), F.col(hi))
    return points.join(small_side(listed), inside).drop("__chr", "__bin")


def region_report(points: DataFrame, regions: DataFrame, score: str, marker: str, window: int = 0, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    """Per region: markers in the widened window, nearest marker and its distance, best-scored marker in the window.

    Markers in the window come by bins; the nearest marker is one inside the region or the nearest to one of its ends.
    """
    wide = regions.select("region_id", chr_, (F.col("lo") - window).alias("__a"), (F.col("hi") + window).alias("__b"), "lo", "hi")
    near = in_regions(points.select(chr_, pos, marker, score), wide, chr_, pos, "__a", "__b")
    distance = C.interval_distance(pos, "lo", "hi")
    inside = near.groupBy("region_id").agg(F.count("*").alias("n_in_window"), F.min(F.struct(distance.alias("d"), F.col(marker).alias("m"))).alias("__in"), F.min_by(marker, F.struct(-F.col(score), F.col(marker))).alias("best_marker"))
    places = points.select(chr_, pos, F.col(marker).alias("m"))
    out = regions.select("region_id", chr_, "lo", "hi").join(inside, "region_id", "left")
    for end in ("lo", "hi"):
        at = nearest(regions.select("region_id", chr_, F.col(end).alias("locus_pos")), places, "region_id", tie=["m"], chr_=chr_, pos=pos)
        at = at.join(regions.select("region_id", "lo", "hi"), "region_id").where("m is not null")
        out = out.join(at.select("region_id", F.struct(C.interval_distance(pos, "lo", "hi").alias("d"), "m").alias(f"__{end}")), "region_id", "left")
    best = F.least("__in", "__lo", "__hi")
    return out.select("region_id", F.coalesce("n_in_window", F.lit(0).cast("bigint")).alias("n_in_window"), best["d"].alias("closest_distance"), best["m"].alias("closest_marker"), "best_marker")


def chromosome_of(rows: DataFrame, ends: DataFrame, index: str = "global_idx") -> DataFrame:
    """Chromosome of a global row number, from (chr, start, end) with end excluded. Ranges are listed in the bins that they
    touch, so the join has an equality key whatever the number of ranges."""
    filled = ends.where("start < end")
    width = max(1, int(filled.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1))
    listed = filled.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    inside = (F.floor(F.col(index) / width) == F.col("__bin")) & (F.col(index) >= F.col("start")) & (F.col(index) < F.col("end"))
    return rows.join(small_side(listed), inside).drop("__bin")
