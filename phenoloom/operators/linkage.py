"""Linkage disequilibrium near the diagonal: squared correlations of markers at most a window apart, as block products.

Positions are cut into bins at least as wide as the window, bins with many markers into tiles. A pair of markers lies in two tiles of
one bin or of neighbouring bins; the left tile owns it. So a tile of the next bin comes along as a halo, each pair is met
once, and a task holds two tiles, whatever the density of markers. A pair of tiles is one matrix product for each sum that a
correlation over samples called at both needs, not a fold for each pair of markers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import discard, stored
from .joins import small_side
from .testing import quantiles

#: Markers of a tile.
TILE = 256
#: Samples of a group in the long form.
SAMPLES = 4096
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The SUMS over samples at which both are called, for each row of x and each of y; NaN is not called."""
    mx, my = (~np.isnan(a) for a in (x, y))
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return dict(zip(SUMS, (mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T), strict=True))


def _pairs_of_tiles(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """rows (chr, bin, id, pos, g, and the columns of `keys`) as (pair, side, ...): each row in every pair of tiles it is in."""
    counts = rows.select("chr", "bin", "id").distinct() if keys else rows
    counts = counts.groupBy("chr", "bin").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiles = counts.select("chr", "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"))
    right = tiles.select("chr", F.col("bin").alias("bin2"), F.col("tile").alias("tile2"))
    own = tiles.join(right, (tiles["chr"] == right["chr"]) & (F.col("bin") == F.col("bin2")) & (F.col("tile") <= F.col("tile2"))).drop(right["chr"])
    halo = tiles.join(right, (tiles["chr"] == right["chr"]) & (F.col("bin") + 1 == F.col("bin2"))).drop(right["chr"])
    pairs = own.unionByName(halo).withColumn("pair", F.struct("bin", "tile", "bin2", "tile2"))
    placed = rows.join(small_side(counts), ["chr", "bin"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).drop("tiles")
    left = pairs.select("chr", "bin", "tile", "pair", F.lit(0).alias("side"))
    # A tile that meets itself comes once.
    halves = left.unionByName(pairs.where("bin <> bin2 or tile <> tile2").select("chr", F.col("bin2").alias("bin"), F.col("tile2").alias("tile"), "pair", F.lit(1).alias("side")))
    return placed.join(small_side(halves), ["chr", "bin", "tile"]).select("chr", "pair", "side", "id", "pos", "g", *keys)


def _aligned(tables: list[pa.Table]) -> list[np.ndarray]:
    """Calls of both sides as matrices over the same samples: by place, or by id where calls name their samples."""
    kind = tables[0].schema.field("g").type.value_type
    flat = [pc.list_flatten(t["g"]).combine_chunks() if t.num_rows else pa.array([], kind) for t in tables]
    if not pa.types.is_struct(kind):
        n = max(len(f) // t.num_rows for f, t in zip(flat, tables, strict=True) if t.num_rows)
        return [np.asarray(pc.fill_null(f.cast(pa.float64()), np.nan)).reshape(-1, n) for f in flat]
    ids = [pc.struct_field(f, "s") for f in flat]
    known = pc.unique(pa.chunked_array(ids))
    out = []
    for f, i, t in zip(flat, ids, tables, strict=True):
        m = np.full((t.num_rows, len(known)), np.nan)
        row = np.repeat(np.arange(t.num_rows), np.asarray(pc.list_value_length(t["g"]))) if t.num_rows else np.empty(0, int)
        m[row, np.asarray(pc.index_in(i, known))] = np.asarray(pc.fill_null(pc.struct_field(f, "g").cast(pa.float64()), np.nan))
        out.append(m)
    return out


def _sums(rows: DataFrame, window: int, keys: list[str], tile: int) -> DataFrame:
    """(chr, a, b, distance, and the SUMS) of every pair, a < b; with keys, a row for each of their values."""
    grouped = _pairs_of_tiles(rows, keys, tile)
    types = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}

    def work(table: pa.Table) -> pa.Table:
        sides = [table.filter(pc.equal(table["side"], k)) for k in (0, 1)]
        same = not sides[1].num_rows and table["pair"][0].as_py()["bin"] == table["pair"][0].as_py()["bin2"] and table["pair"][0].as_py()["tile"] == table["pair"][0].as_py()["tile2"]
        left, right = sides[0], sides[0] if same else sides[1]
        pos = [np.asarray(t["pos"]) for t in (left, right)]
        near = np.abs(pos[0][:, None] - pos[1][None, :]) <= window
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        found = pair_sums(*_aligned([left, right])) if len(i) else dict.fromkeys(SUMS, np.empty((0, 0)))
        ids = [t["id"].combine_chunks().take(pa.array(k)) for t, k in ((left, i), (right, j))]
        first = pc.less(*ids)
        columns = [pa.repeat(table["chr"][0], len(i)), pc.if_else(first, *ids), pc.if_else(first, *reversed(ids)), pa.array(np.abs(pos[0][i] - pos[1][j]).astype(np.int64))]
        return pa.table([*columns, *[pa.array(found[k][i, j] if len(i) else []).cast(pa.float64()) for k in SUMS]], ["chr", "a", "b", "distance", *SUMS])

    schema = f"chr {types['chr']}, a {types['id']}, b {types['id']}, distance bigint, " + ", ".join(f"{k} double" for k in SUMS)
    return grouped.groupBy("chr", "pair", *keys).applyInArrow(work, schema)


def _correlations(sums: DataFrame) -> DataFrame:
    n, cov = F.col("n"), F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    vx, vy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    return sums.select("chr", "a", "b", "distance", n.cast("bigint").alias("n"), F.when((vx > 1e-9) & (vy > 1e-9), cov * cov / (vx * vy)).alias("r2"))


def _width(markers: DataFrame, window: int, chr_: str, pos: str, tile: int) -> int:
    """Bins are as wide as the window, or so many times that where markers are so few that a tile would be nearly empty."""
    filled = markers.where(F.col(pos).isNotNull()).groupBy(chr_, F.floor(F.col(pos) / max(1, window))).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0]
    return max(1, window) * max(1, int(tile // (4 * (filled or tile))))


def _rows(markers: DataFrame, width: int, marker: str, chr_: str, pos: str, g, *keys: str) -> DataFrame:
    return markers.select(F.col(chr_).alias("chr"), F.floor(F.col(pos) / width).alias("bin"), F.col(marker).alias("id"), F.col(pos).cast("bigint").alias("pos"), g.alias("g"), *keys).where("chr is not null and pos is not null and id is not null")


def ld_pairs_arrays(markers: DataFrame, window: int, marker: str = "marker_id", dosage: str = "dosage", chr_: str = "chr", pos: str = "pos", tile: int = TILE) -> DataFrame:
    """(chr, a, b, distance, n, r2), a < b, for markers of a chromosome at most `window` apart, over samples called at both.

    A marker without variance among these samples has null r2. Rows without a place or an id are in no pair; ids are unique.
    """
    width = _width(markers, window, chr_, pos, tile)
    return _correlations(_sums(_rows(markers, width, marker, chr_, pos, F.col(dosage)), window, [], tile))


def ld_pairs(calls: DataFrame, window: int, marker: str = "marker_id", sample: str = "sample_id", call: str = "call", chr_: str = "chr", pos: str = "pos", tile: int = TILE, samples: int = SAMPLES) -> DataFrame:
    """The same from long calls. Samples are dealt to groups of about `samples`; a pair's sums are added over the groups, so
    no row holds all samples of a marker."""
    groups = -(-calls.agg(F.approx_count_distinct(sample)).first()[0] // samples) or 1
    dealt = calls.withColumn("__group", F.pmod(F.xxhash64(sample), F.lit(groups)))
    packed = dealt.groupBy(marker, chr_, pos, "__group").agg(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(call).cast("double").alias("g"))).alias("__g"))
    width = _width(calls.select(marker, chr_, pos).distinct(), window, chr_, pos, tile)
    sums = _sums(_rows(packed, width, marker, chr_, pos, F.col("__g"), "__group"), window, ["__group"], tile)
    return _correlations(sums.groupBy("chr", "a", "b", "distance").agg(*[F.sum(k).alias(k) for k in SUMS]))


def ld_by_distance(pairs: DataFrame, edges: list[int]) -> DataFrame:
    """(bin, pairs, median_r2) of pairs by distance: bin k is [edges[k], edges[k+1]). Medians are found by counted places."""
    bins = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        bins = F.when((F.col("distance") >= edges[k]) & (F.col("distance") < edges[k + 1]), F.lit(k)).otherwise(bins)
    kept = stored(pairs.select(bins.alias("distance_bin"), "r2").where("distance_bin is not null and r2 is not null"), "linkage")
    medians = quantiles(kept, "r2", [0.5], ["distance_bin"]).select("distance_bin", F.col("quantile").alias("median_r2"))
    counts = kept.groupBy("distance_bin").agg(F.count("*").alias("pairs"))
    found = stored(counts.join(medians, "distance_bin").withColumnRenamed("distance_bin", "bin"), "medians")
    discard(kept)
    return found
