"""Generators of benchmark data with planted signals. Every value is a function of seed and place, so tasks may rerun."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.distributions import normal_cdf_array, normal_ppf_array

SEGMENT, REACH, BURN_IN, SHARED = 1_000, 60_000, 1_000, 0.30


def block_plan(spark: SparkSession, chromosomes: list[tuple[int, int, int, int]]) -> DataFrame:
    """(chr, block, first, last, length, markers) from (chr, length, markers, blocks): equal cuts at floor(k m / b)."""
    rows = [(c, k, k * m // b, (k + 1) * m // b, length, m) for c, length, m, b in chromosomes for k in range(b)]
    return spark.createDataFrame(rows, "chr int, block int, first bigint, last bigint, length bigint, markers bigint")


def _rng(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, hash(place) & (1 << 62) - 1]))


def draw_maf(rng: np.random.Generator, n: int, bins: list[tuple[float, float, float]] | None = None) -> np.ndarray:
    """Uniform on [0.05, 0.5), or a weighted choice of bins (low, high, weight) and uniform inside."""
    if not bins:
        return rng.uniform(0.05, 0.5, n)
    low, high, weight = (np.array(x, float) for x in zip(*bins, strict=True))
    at = np.searchsorted(np.cumsum(weight / weight.sum()), rng.random(n), side="right").clip(max=len(bins) - 1)
    return rng.uniform(low[at], high[at])


def genotypes(plan: DataFrame, samples: int, seed: int, bins: list[tuple[float, float, float]] | None = None, linked: bool = False) -> DataFrame:
    """(marker_id, chr, block, local_row, pos, maf, dosage) haploid 0/1.

    Blind: independent draws below the frequency. Linked: a latent normal value follows an autoregression over 1-kb
    segments (correlation exp(-1000/60000)), shares part of its variance within the segment, and is cut at the
    frequency's quantile. The autoregression runs along a chromosome, so there a task is a chromosome; else a block.
    """
    rho = float(np.exp(-SEGMENT / REACH))
    schema = "marker_id string, chr int, block int, local_row bigint, pos bigint, maf double, dosage array<tinyint>"

    def emit(block: pd.Series, state: dict) -> Iterator[pd.DataFrame]:
        for start in range(int(block["first"]), int(block["last"]), 2_000):
            i = np.arange(start, min(start + 2_000, int(block["last"])))
            pos = np.floor((i + 0.5) * block["length"] / block["markers"]).astype(int) + 1
            rng = _rng(seed, int(block["chr"]), start)
            maf = draw_maf(rng, len(i), bins)
            if not linked:
                g = (rng.random((len(i), samples)) < maf[:, None]).astype(np.int8)
            else:
                cut, g = normal_ppf_array(maf), np.empty((len(i), samples), np.int8)
                walk = _rng(seed + 1, int(block["chr"]), start)
                if "z" not in state:
                    z = walk.normal(size=samples)
                    for _ in range(BURN_IN):
                        z = rho * z + np.sqrt(1 - rho * rho) * walk.normal(size=samples)
                    state |= {"z": z, "segment": pos[0] // SEGMENT}
                for k, p in enumerate(pos):
                    while state["segment"] < p // SEGMENT:
                        state["z"] = rho * state["z"] + np.sqrt(1 - rho * rho) * walk.normal(size=samples)
                        state["segment"] += 1
                    g[k] = np.sqrt(SHARED) * state["z"] + np.sqrt(1 - SHARED) * rng.normal(size=samples) < cut[k]
            ids = [f"Chr{int(block['chr'])}_sim_{n + 1:07d}" for n in i]
            yield pd.DataFrame({"marker_id": ids, "chr": int(block["chr"]), "block": int(block["block"]), "local_row": i - int(block["first"]), "pos": pos, "maf": maf, "dosage": list(g)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, {}
        for pdf in frames:
            for _, b in pdf.iterrows():
                if b["chr"] != at:
                    at, state = b["chr"], {}
                yield from emit(b, state)

    # Blocks of a chromosome come in a row, and what they make is handed on in parts of 2,000 markers.
    dealt = plan.repartition(*(["chr"] if linked else ["chr", "block"])).sortWithinPartitions("chr", "block")
    return dealt.mapInPandas(run, schema)


def pick_causal(markers: DataFrame, n: int, seed: int, least_maf: float = 0.05) -> DataFrame:
    """n markers without replacement among the common ones, in the order of a hash; `weight` is their unit-norm effect."""
    found = markers.where(F.col("maf") >= least_maf).orderBy(F.xxhash64(F.lit(seed), "marker_id"), "marker_id").limit(n)
    return found


def phenotype(dosages: np.ndarray, weights: np.ndarray, seed: int, signal: float = 0.5) -> np.ndarray:
    """Standardised sum of standardised haploid dosages (rows) plus noise, mixed by the share of signal."""
    rng = np.random.default_rng(seed)
    p = dosages.mean(1, keepdims=True)
    z = (dosages - p) / np.sqrt(np.maximum(p * (1 - p), 1e-12))
    w = weights / np.linalg.norm(weights)
    score = _standard(w @ z, 1)
    return _standard(np.sqrt(signal) * score + np.sqrt(1 - signal) * _standard(rng.normal(size=dosages.shape[1]), 1), 1)


def _standard(x: np.ndarray, ddof: int) -> np.ndarray:
    return (x - x.mean()) / x.std(ddof=ddof)


def weighted_score(dosages: np.ndarray, shares: list[float], noise: float, seed: int) -> np.ndarray:
    """Sum of signed roots of variance shares times z-scores (ddof 0), plus noise; a z-score again."""
    rng = np.random.default_rng(seed)
    signs = rng.choice([-1.0, 1.0], len(shares))
    z = np.array([_standard(g, 0) for g in np.asarray(dosages, float)])
    total = (signs * np.sqrt(shares)) @ z + np.sqrt(noise) * rng.normal(size=z.shape[1])
    return _standard(total, 0)


def map_to_reference(latent: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The reference's quantiles at the normal probabilities of the latent values."""
    return np.quantile(reference, np.clip(normal_cdf_array(latent), 1e-6, 1 - 1e-6))


def calibration(values: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row: exact linear quantiles, mean, sd (ddof 1), min, max."""
    return values.agg(F.percentile(column, F.lit(probabilities).cast("array<double>")).alias("quantiles"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("min"), F.max(column).alias("max"))


def windows_of(loci: DataFrame, lengths: DataFrame, flank: int = 150_000, width: int = 500_000, at: float = 0.3) -> DataFrame:
    """(region_id, chr, lo, hi, kind): flanks of loci (region_id, chr, pos), not below 1, and one background window for each
    chromosome of lengths (chr, length)."""
    own = loci.select(F.col("region_id").cast("string").alias("region_id"), "chr", F.greatest(F.lit(1), F.col("pos") - flank).cast("bigint").alias("lo"), (F.col("pos") + flank).cast("bigint").alias("hi"), F.lit("causal").alias("kind"))
    low = F.floor(F.col("length") * at).cast("bigint")
    background = lengths.select(F.concat(F.lit("bg_chr"), F.col("chr").cast("string")).alias("region_id"), "chr", low.alias("lo"), (low + width).alias("hi"), F.lit("background").alias("kind"))
    return own.unionByName(background)


def windows(spark: SparkSession, causal: list[tuple[str, int, int]], lengths: dict[int, int], flank: int = 150_000, width: int = 500_000, at: float = 0.3) -> DataFrame:
    """The same for loci (name, chromosome, position) and lengths that are given as such."""
    loci = spark.createDataFrame(causal, "region_id string, chr int, pos bigint")
    return windows_of(loci, spark.createDataFrame(sorted(lengths.items()), "chr int, length bigint"), flank, width, at)


# Lengths, markers and blocks of the plant genome's chromosomes; lengths of the human autosomes (GRCh38); edges
# and counts of the plant's frequency bins; median r2 and sampled pairs by distance there; the planted human loci (name,
# chromosome, position, share of variance).
PLANT_CHROMOSOMES = {1: (30_427_613, 865_603, 26), 2: (19_697_717, 600_877, 19), 3: (23_459_627, 722_432, 22), 4: (18_585_004, 584_671, 18), 5: (26_975_377, 783_946, 23)}
HUMAN_LENGTHS = {
    1: 248_956_422, 2: 242_193_529, 3: 198_295_559, 4: 190_214_555, 5: 181_538_259, 6: 170_805_979, 7: 159_345_973, 8: 145_138_636,
    9: 138_394_717, 10: 133_797_422, 11: 135_086_622, 12: 133_275_309, 13: 114_364_328, 14: 107_043_718, 15: 101_991_189, 16: 90_338_345,
    17: 83_257_441, 18: 80_373_285, 19: 58_617_616, 20: 64_444_167, 21: 46_709_983, 22: 50_818_468,
}
MAF_EDGES, MAF_COUNTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5), (810_093, 945_522, 590_076, 510_193, 293_428, 218_872, 189_345)
LD_SUMMARY = (("0-1 kb", 0.0119, 68_478), ("1-10 kb", 0.0087, 226_004), ("10-50 kb", 0.0051, 10_893))
PLANTED_LOCI = (("rs12913832", 15, 28_120_472, 0.70), ("rs16891982", 5, 33_951_588, 0.03), ("rs1042602", 11, 89_178_528, 0.03), ("rs12203592", 6, 396_321, 0.03))


def reference_chromosomes(spark: SparkSession, genome: str) -> DataFrame:
    """(chr, length, markers, blocks) of the plant or the human genome; markers and blocks are null where none are fixed."""
    rows = [(c, *x) for c, x in PLANT_CHROMOSOMES.items()] if genome == "plant" else [(c, n, None, None) for c, n in HUMAN_LENGTHS.items()]
    return spark.createDataFrame(rows, "chr int, length bigint, markers bigint, blocks int")


def plant_maf_bins() -> list[tuple[float, float, float]]:
    """(low, high, weight) of the plant's frequency bins."""
    return [(low, high, float(n)) for low, high, n in zip(MAF_EDGES[:-1], MAF_EDGES[1:], MAF_COUNTS, strict=True)]


def human_windows(spark: SparkSession) -> DataFrame:
    """The windows of the human pilot: around the planted loci and one background window for every autosome."""
    return windows(spark, [(name, c, p) for name, c, p, _ in PLANTED_LOCI], HUMAN_LENGTHS)


def planted_dosages(blocks: DataFrame, planted: DataFrame, key: str = "marker_id") -> DataFrame:
    """Planted markers with the dosages that their blocks have for them, taken while the blocks are made; one that is not
    among them is an error."""
    return require_planted(planted, blocks.select(key, "dosage"), key).join(blocks.select(key, "dosage"), key)


def require_planted(planted: DataFrame, markers: DataFrame, key: str = "marker_id") -> DataFrame:
    """Planted markers with their row in the result; one that quality control removed is an error."""
    found = planted.join(markers.select(key, F.lit(True).alias("__there")), key, "left")
    checked = F.when(F.col("__there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("planted marker lost: "), C.col(key).cast("string"))))
    return found.withColumn(key, checked).drop("__there")
