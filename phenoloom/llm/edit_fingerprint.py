"""Operator 4: document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A text is walked through character by character. At step j the walk writes the current character and moves on by one or
stays, by a random bit that depends on j and the code point only; all texts share these bits. After an edit two walks meet
again soon, so texts at edit distance k differ in O(k^2) places of the embedding and usually in O(k): edit distance becomes
Hamming distance. A fingerprint samples fixed places of the embedding: a place j is taken for texts of level L (three
times the length is at most 2^L; a text whose walk takes longer has the next level) if a hash of j is below SAMPLES / 2^L. Places of a higher level are among those of a lower one, so
texts of different length share the places of the longer one's level. Each place holds 4 bits of a hash of what was
written there. The fingerprint is the level, a colon and these as hex digits; its size is about SAMPLES, at most 2 x SAMPLES
on average, however long the text. The likeness of two fingerprints is the share of equal digits among the common places
at which either text still runs, set right for digits that are equal by chance.

Banding and verification: digits are banded (bit sampling), also across neighbouring levels. `near_groups` links documents
whose fingerprints share a band, one pair for each row of a band, and confirms a link by the likeness of whole fingerprints;
what a band's first document does not explain goes on without it until a round finds no link. `near_pairs` compares all
different texts that share a band and confirms them by the edit distance of whole texts.

Defined cases: null is the empty text; two empty texts have likeness 1, an empty and another 0; equal texts have equal
fingerprints; next documents go by ascending doc_id, rows with the same id in the order of a hash of their texts, rows
without id last, in that order too; rows that agree in both follow one another; the last row's next is the first; a single
row is its own next; an empty table gives no row; very long texts are walked whole; columns of any other name than the two
are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, mix64, slices
from .minhash_dedup import components, joined

SAMPLES = 128
#: Members of a band that meet at once.
BLOCK = 256
#: Steps walked between removals of the texts that have ended.
STRIDE = 64


def _steps(block: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of STRIDE steps: the upper bit of factor x code point + summand says whether the walk moves on."""
    j = np.arange(2 * block, 2 * (block + STRIDE), dtype=np.uint64)
    drawn = (mix64(j + np.uint64(seed << 40)) >> np.uint64(32)).astype(np.uint32)
    return drawn[::2] | np.uint32(1), drawn[1::2]


@lru_cache(maxsize=64)
def places(level: int, seed: int = 12) -> np.ndarray:
    """Sampled steps of a level, ascending: those below 2^level whose hash is small enough."""
    j = np.arange(1 << level, dtype=np.uint64)
    return np.flatnonzero(mix64(j + np.uint64(seed << 32)) < np.uint64(min((1 << 64) - 1, (SAMPLES << 64) >> level)))


def level_of(n: int) -> int:
    """Walks take 2n steps on average: the power of two from 3n, so that hardly any is cut."""
    return max(7, (3 * n - 1).bit_length()) if n else 0


def _points(text: str) -> np.ndarray:
    """Code points, one added, and 0 as the end."""
    return np.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32) + np.uint32(1), np.uint32(0))


DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of many texts, walked side by side; equal texts are walked once."""
    unique = list(dict.fromkeys(texts))
    order = sorted(range(len(unique)), key=lambda i: len(unique[i]))
    out: dict[str, str] = {"": "0:"}
    by_level: dict[int, list[int]] = {}
    for i in order:
        if unique[i]:
            by_level.setdefault(level_of(len(unique[i])), []).append(i)
    while by_level:
        level = min(by_level)
        members = by_level.pop(level)
        sampled = places(level)
        taken = np.zeros((len(members), len(sampled)), np.uint32)
        coded = [_points(unique[i]) for i in members]
        flat = np.concatenate(coded)
        last = np.cumsum([len(c) for c in coded]) - 1
        at = np.r_[0, last + 1][:-1]
        live = np.arange(len(members))
        k = 0
        for block in range(0, 1 << level, STRIDE):
            until = np.searchsorted(sampled, block + STRIDE)
            if until == k and not len(live):
                continue
            factors, summands = _steps(block)
            for j in range(block, block + STRIDE):
                c = flat[at]
                if k < until and sampled[k] == j:
                    taken[live, k] = c
                    k += 1
                at = np.minimum(at + ((c * factors[j - block] + summands[j - block]) >> np.uint32(31)), last)
            running = flat[at] > 0
            if not running.all():
                live, at, last = live[running], at[running], last[running]
                if not len(live):
                    break
        digits = (mix64(taken.astype(np.uint64) + (sampled.astype(np.uint64) << np.uint64(24))) >> np.uint64(60)).astype(np.uint8)
        ends = np.where(taken.any(1), taken.shape[1] - (taken[:, ::-1] > 0).argmax(1), 0)
        unended = set(live[flat[at] > 0].tolist())
        if unended:  # walked again on the next level, so that every walk reaches the text's end
            by_level.setdefault(level + 1, []).extend(members[row] for row in sorted(unended))
        for row, i in enumerate(members):
            if row in unended:
                continue
            # Places after the end of the walk are left out.
            out[unique[i]] = f"{level}:" + DIGITS[digits[row, : ends[row]]].tobytes().decode()
    return [out[t] for t in texts]


CHANCE = 1 / 12


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone."""
    (la, da), (lb, db) = ((int(x[: x.index(":")]), np.frombuffer(x[x.index(":") + 1 :].encode(), np.uint8)) for x in (a, b))
    if not la or not lb:
        return float(la == lb)
    if la != lb:
        low, high = min(la, lb), max(la, lb)
        keep = np.isin(places(low), places(high)[places(high) < (1 << low)])
        if la < lb:
            da = da[keep[: len(da)]]
        else:
            db = db[keep[: len(db)]]
    both, either = min(len(da), len(db)), max(len(da), len(db))
    if not either:
        return 0.0
    same = (da[:both] == db[:both]).sum() / either
    return float(max(0.0, (same - CHANCE) / (1 - CHANCE)))


#: Bytes of input, as the plan knows them, for each bin of neighbouring ids.
BIN_BYTES = 64 << 20


def _rank(bounds: list[int], value, strict: bool):
    """How many of the sorted bounds are at most (or below) the value: by a list of every n-th bound, then by the n that follow it."""
    if not bounds:
        return F.lit(0)
    n = math.isqrt(len(bounds)) + 1
    # A literal of its own, however long: parsed once when the plan is made.
    every, coarse = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (bounds, bounds[::n]))
    below = lambda b: (b < value) if strict else (b <= value)
    q = F.size(F.filter(coarse, below))
    return F.when(q > 0, (q - 1) * n + F.size(F.filter(F.slice(every, F.greatest((q - 1) * n, F.lit(0)) + 1, n), below))).otherwise(0)


def in_order(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows dealt into bins of neighbouring ids, each bin followed by a ghost of the next bin's first row.

    Columns bin, ghost, doc_id, __order (a hash of the text), __text. There are as many bins as the input's bytes ask for; an
    id that many rows share, or null, has as many bins as its rows ask for, by ranges of the hash. Only bounds of bins and
    their first rows' ids and hashes go to the driver; texts are shuffled once.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bins = max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BIN_BYTES) if size < 1 << 60 else 0)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    cuts = [k / bins for k in range(1, bins)]
    bounds, rows, without = source.select(F.percentile_approx("doc_id", cuts, max(100_000, 10 * bins)), F.count("*"), F.count("*") - F.count("doc_id")).first()
    # An id that fills more than a bin is more than one bound.
    bounds = sorted(bounds or [])
    source = source.withColumn("__order", F.xxhash64("__text"))
    among = F.pmod("__order", F.lit(1 << 20)) / float(1 << 20)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", among.alias("among"), F.col("__order").alias("order"))
    upto, below = _rank(bounds, F.col("doc_id"), False), _rank(bounds, F.col("doc_id"), True)
    last = -(-without * bins // max(rows, 1))
    place = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.floor(among * last)).when(upto == below, upto).otherwise(below + 1 + F.floor(among * (upto - below)))
    binned = source.withColumn("bin", place.cast("long")).withColumn("__at", order)
    firsts = binned.groupBy("bin").agg(F.min("__at").alias("first")).orderBy("bin").collect()
    used = [r["bin"] for r in firsts]
    # The first bin's first row follows the last bin.
    starts = spark.createDataFrame([(r["bin"], used[k - 1], r["first"]["none"], r["first"]["doc_id"], r["first"]["order"]) for k, r in enumerate(firsts)], "bin long, before long, none boolean, id long, order long")
    dealt = binned.join(F.broadcast(starts), "bin")
    is_first = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__order") == F.col("order"))
    own, ghost = F.struct(F.col("bin").alias("b"), F.lit(False).alias("g")), F.struct(F.col("before").alias("b"), F.lit(True).alias("g"))
    copies = F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))
    return dealt.select(F.explode(copies).alias("x"), "doc_id", "__at", "__text").select(F.col("x.b").alias("bin"), F.col("x.g").alias("ghost"), "doc_id", F.col("__at.among").alias("__among"), F.col("__at.order").alias("__order"), "__text")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (of the text), n_chars, edited (the whole edited text), fingerprint, edited_fingerprint, near_edited, near_next per row."""
    ordered = in_order(df, text, doc_id).repartition("bin").sortWithinPartitions("bin", "ghost", F.asc_nulls_last("doc_id"), "__among", "__order", "__text")
    ordered = ordered.select("bin", "ghost", "doc_id", "__text")
    most_rows, most_chars = 1536, 4 << 20

    def batch_of(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        new = [edited(t, n) for t, n in zip(texts, [*texts[1:], following[1]], strict=True)]
        found = fingerprints([*texts, following[1], *new])
        own, after, changed = found[: len(texts)], found[1 : len(texts) + 1], found[len(texts) + 1 :]
        near_edited = [likeness(a, b) for a, b in zip(own, changed, strict=True)]
        near_next = [likeness(a, b) for a, b in zip(own, after, strict=True)]
        names = ["doc_id", "digest", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        digests = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
        arrays = [pa.array([i for i, _ in rows], pa.int64()), pa.array(digests, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(new, pa.string()), pa.array(own, pa.string()), pa.array(changed, pa.string()), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bin_, ended = [], 0, None, False
        for batch in slices(batches, text="__text"):
            for b, ghost, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bin_:
                    held, size, bin_, ended = [], 0, b, False
                if ended:
                    continue  # a further ghost: rows that share the first id of the next bin
                if held and (ghost or len(held) >= most_rows or size >= most_chars):
                    yield batch_of(held, (i, t))
                    held, size = [], 0
                if ghost:
                    ended = True
                else:
                    held.append((i, t))
                    size += len(t)

    return ordered.mapInArrow(work, "doc_id bigint, digest bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_keys(fingerprint: str, band: int) -> list[int]:
    """Keys of the bands of a fingerprint at its own level and, over the places that both have, at the next."""
    at = fingerprint.index(":")
    level, digits = int(fingerprint[:at]), fingerprint[at + 1 :]
    keys = []
    for target in (level, level + 1):
        if target > level:
            keep = np.isin(places(level), places(target))[: len(digits)]
            digits = "".join(d for d, k in zip(digits, keep.tolist(), strict=True) if k)
        for k in range(max(1, len(digits) // band)):
            keys.append(xxhash.xxh3_64_intdigest(f"{target}:{k}:{digits[k * band : (k + 1) * band]}") - (1 << 63))
    return keys


def near_pairs(df: DataFrame, most_edits: int, text: str = "text", doc_id: str = "doc_id", band: int = 8) -> DataFrame:
    """(a, b, edits): pairs of ids whose texts are within most_edits, found by bands of sampled digits and confirmed whole.

    Equal texts are one class: its smallest id stands for it in the pairs, and the others are paired with that id at 0 edits.
    All classes that share a band are compared; a band is cut into blocks that meet pairwise.
    """
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).where("id is not null")
    classes = materialise(source.groupBy("__text").agg(F.min("id").alias("least")), "classes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1536, 4 << 20, "__text"):
            keys = [band_keys(fp, band) for fp in fingerprints(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    keys = materialise(classes.select("__text", "least").mapInArrow(work, "id bigint, keys array<bigint>").select("id", F.explode("keys").alias("key")).distinct(), "bands")
    sizes = keys.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("lo"), F.greatest(k, own).alias("hi")))
    lists = keys.join(sizes, "key").select("key", "id", F.explode(meets).alias("at")).groupBy("key", "at").agg(F.collect_list("id").alias("ids"))
    pairs = lists.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").distinct()
    # An id may have several texts: classes are told apart by the text too.
    left, right = classes.select(F.col("least").alias("a"), F.col("__text").alias("ta")), classes.select(F.col("least").alias("b"), F.col("__text").alias("tb"))
    edits = F.levenshtein(F.col("ta"), F.col("tb"), most_edits)
    near = pairs.join(left, "a").join(right, "b").select("a", "b", edits.alias("edits")).where("edits >= 0")
    equal = source.join(classes, "__text").where("least < id").select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(0).alias("edits"))
    return near.union(equal).groupBy("a", "b").agg(F.min("edits").alias("edits"))


def _banded(classes: DataFrame, band: int) -> DataFrame:
    """(key, id): the bands of every class's fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = [band_keys(fp, band) for fp in batch.column(1).to_pylist()]
                ids = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "fingerprint").mapInArrow(work, "key bigint, id bigint").distinct()


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints have that likeness."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("fingerprint").alias(f"fp_{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fp_a", "fp_b").mapInArrow(work, "a bigint, b bigint")


def _likenesses(one: str, others: list[str], digits: np.ndarray, lengths: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """likeness() of one fingerprint to many: by rows of digits where levels agree, one by one where they don't."""
    at = one.index(":")
    level, own = int(one[:at]), np.frombuffer(one[at + 1 :].encode(), np.uint8)
    out = np.zeros(len(others))
    same = np.flatnonzero(levels == level)
    if level and len(same):
        both = np.minimum(lengths[same], len(own))
        width = min(len(own), digits.shape[1])
        equal = ((digits[same, :width] == own[:width]) & (np.arange(width) < both[:, None])).sum(1) / np.maximum(np.maximum(lengths[same], len(own)), 1)
        out[same] = np.maximum(0.0, (equal - CHANCE) / (1 - CHANCE))
    elif len(same):
        out[same] = 1.0
    for k in np.flatnonzero(levels != level):
        out[k] = likeness(one, others[k])
    return out


def _met_in_blocks(rest: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members (key, id, component) of one band and different components: every such pair is looked at.

    A band is cut into blocks that meet pairwise, so a task holds two blocks; a pair of blocks gives fewer links than it has
    components, so rows stay few however large the band is.
    """
    sizes = materialise(rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "band-blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("lo"), F.greatest(k, own).alias("hi")))
    rows = rest.join(sizes, "key").join(classes.select("id", "fingerprint"), "id")
    rows = rows.select("key", "id", "component", "fingerprint", own.alias("block"), F.explode(meets).alias("at"))

    def work(table: pa.Table) -> pa.Table:
        at = table["at"][0].as_py()
        ids, parts, blocks = (np.asarray(table[c]) for c in ("id", "component", "block"))
        prints = table["fingerprint"].to_pylist()
        heads = [f.index(":") for f in prints]
        levels = np.array([int(f[:h]) for f, h in zip(prints, heads, strict=True)])
        lengths = np.array([len(f) - h - 1 for f, h in zip(prints, heads, strict=True)])
        digits = np.zeros((len(prints), max(1, int(lengths.max()))), np.uint8)
        for k, (f, h) in enumerate(zip(prints, heads, strict=True)):
            digits[k, : lengths[k]] = np.frombuffer(f[h + 1 :].encode(), np.uint8)
        parts, links = parts.copy(), []
        for k in range(len(prints)):
            others = np.flatnonzero((parts != parts[k]) & ((blocks != blocks[k]) | (at["lo"] == at["hi"])) & (ids > ids[k]))
            if len(others):
                found = _likenesses(prints[k], [prints[j] for j in others], digits[others], lengths[others], levels[others])
                # One link for each component; what is joined here is not compared with each other again.
                joins, first = np.unique(parts[others[found >= least]], return_index=True)
                links += [(int(ids[k]), int(ids[j])) for j in others[found >= least][first]]
                parts[np.isin(parts, joins)] = parts[k]
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return rows.groupBy("key", "at").applyInArrow(work, "a bigint, b bigint").distinct()


#: Rounds in which members of a band meet one other component each, before what is left is looked at pair by pair.
ROUNDS = 2


def near_groups(found: DataFrame, least: float = 0.75, band: int = 16) -> DataFrame:
    """(doc_id, near_id): the smallest id reachable over likenesses of at least `least`, for every doc_id of `found` that has one.

    `found` has doc_id, digest and fingerprint, as fingerprint_edits gives them. Equal texts are one class. Empty texts and
    rows without doc_id are near to nothing. A document whose id stands for several texts is near to all that these are near to.

    Classes that share a band are candidates. In a few rounds each member of a band that spans several components meets the
    smallest member of another one, which joins families at a row for each member; members of bands that still span several
    components are then compared in blocks, so no link between two that share a band is left out.
    """
    rows = found.where("doc_id is not null and n_chars > 0").select("doc_id", "digest", "fingerprint")
    classes = materialise(rows.groupBy("digest", "fingerprint").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")), "near-classes")
    keys = materialise(_banded(classes, band), "bands")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = materialise(keys.join(shared, "key"), "band-members")
    discard(keys)
    labels = materialise(members.select(F.col("id").alias("node"), F.col("id").alias("component")).distinct(), "near-labels")
    tried = None
    for _ in range(ROUNDS):
        rest = _several(members, labels)
        one = rest.groupBy("key").agg(F.min(F.struct("component", "id")).alias("one"))
        two = rest.join(one, "key").where("component <> one.component").groupBy("key").agg(F.min(F.struct("component", "id")).alias("two"))
        met = rest.join(one, "key").join(two, "key").withColumn("other", F.when(F.col("component") != F.col("one.component"), F.col("one.id")).otherwise(F.col("two.id")))
        pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "band-pairs")
        links = materialise(_alike(pairs, classes, least), "near-links")
        discard(rest)
        if not links.limit(1).count():
            break
        labels, before = materialise(joined(labels, links), "near-labels"), labels
        tried = pairs if tried is None else tried.unionByName(pairs)
        discard(before)
    rest = _several(members, labels)
    links = materialise(_met_in_blocks(rest, classes, least), "near-links")
    if links.limit(1).count():
        labels = materialise(joined(labels, links), "near-labels")
    discard(members, rest)
    linked = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    # Documents of one text, and texts of one document, are linked by their ids.
    same = rows.join(classes.where("id < last").select("digest", "fingerprint", "id"), ["digest", "fingerprint"]).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return components(same.unionByName(linked).distinct()).select(F.col("node").alias("doc_id"), F.col("component").alias("near_id"))


def _several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, component) of the bands whose members are not all of one component."""
    known = members.join(labels.withColumnRenamed("node", "id"), "id").select("key", "id", "component")
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return materialise(known.join(mixed, "key"), "band-rest")
