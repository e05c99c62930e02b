"""Operator 5: repeated passages by compact windows.

Tokens are 5-word shingles. For a hash function, the Cartesian tree over the shingles' hashes of a document splits all its
subsequences of at least LEAST words into compact windows: all subsequences of a window have the same min-hash, that of
the window's root. Documents with a passage in common thus meet at the root that the passage has, for each of HASHES
functions; there are about 2n/LEAST windows for each, not n^2.

0. Documents with equal texts are one class; its smallest id stands for it until the end.
1. One Arrow pass writes the windows (root's hash, document, left, right).
2. Windows with the same root are linked to the smallest document among them, one pair for each row, never all pairs; the
   smallest is found by an aggregation, so a passage that everybody holds needs no single task.
3. For each pair of documents, stretches covered by windows of at least NEEDED hash functions are candidates.
4. Candidates are confirmed on the texts: runs of equal shingles at a steady distance are chained over small gaps while
   the shingle sets of both sides keep a similarity of 0.75; passages of LEAST words or more count.
5. Whatever smaller document took their roots, exact repeats are complete: in all windows that share a root, every run of
   LEAST words that is not yet known to stand in a smaller document is linked to its smallest holder. The smallest holder
   of a run is never known to stand in a smaller one, so all holders come together.
6. Windows that no confirmed passage explains look for others: a window that was compared gets new roots, the ROOTS least
   shingles beyond its own that the document it was compared with does not hold, so a line that many documents share brings
   each of them to one comparison only. From the second round on, one shared root is enough to be compared, so every window
   of a round is explained or goes on with greater roots. Rounds end when no two documents have a root in common.

In every passage the smallest document is the first; the others hold a repeat, which `cut_repeats` takes out.

Defined cases: null and empty texts and texts of fewer than LEAST words have no passage; rows without doc_id are left as
they are; rows that repeat a doc_id are one document, which does not repeat itself; a passage twice in one document only
is no repeat across documents. Very long texts are read whole; of equal passages the smallest id's is the first; an empty
table gives no row; further columns, whatever their names, are passed on by cut_repeats and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, discard, materialise, mix64, shingle_hashes, slices, word_hashes, words_of
from .minhash_dedup import components

WIDTH, LEAST, HASHES, NEEDED = 5, 50, 4, 2
#: New roots of a window that was compared in vain: what is left of a passage is a smaller part of its window.
ROOTS = 4
#: Gap in shingles that a chain may bridge: two words that differ near each other.
GAP = 12
PERCENT = 75
BROADCAST_IDS = 400_000
#: Texts are cut down to those that a round asks for when its pairs are so many times fewer than those they were read for.
FEWER = 8
#: Followers of a document that are compared with it in a row.
FOLLOWERS = 256
#: Rows of windows and pairs of texts that are worth a task of their own.
ROWS, TEXTS = 20_000, 500
#: Odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def lesser_before(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the last one before it that has no greater value (a lesser one, if strict), or -1: places that are not
    there yet go on to where the place they stand at has come."""
    before = np.arange(-1, len(values) - 1)
    going = np.arange(1, len(values))
    while len(going):
        at = before[going]
        ahead = values[at] >= values[going] if strict else values[at] > values[going]
        going = going[ahead & (at >= 0)]
        before[going] = before[before[going]]
    return before


def compact_windows(values: np.ndarray, least: int) -> np.ndarray:
    """(left, root, right) of every window of at least `least` places, by the Cartesian tree of minima.

    The root of such a window is the least value of some run of `least` places, and so are the smaller values that bound the
    window. Hence only these, about 2n/least, are looked at.
    """
    if len(values) < least:
        return np.empty((0, 3), np.int64)
    runs = lowest(values, least)
    edge = np.full(least - 1, runs.min(), runs.dtype)
    roots = np.flatnonzero(lowest(np.r_[edge, runs, edge], least, np.maximum) == values)
    held = values[roots]
    before = lesser_before(held, False)
    after = len(roots) - 1 - lesser_before(held[::-1], True)[::-1]
    found = np.column_stack([np.r_[roots, -1][before] + 1, roots, np.r_[roots, len(values)][after] - 1])
    return found[found[:, 2] - found[:, 0] >= least - 1]


def windows_of_texts(shingles: np.ndarray, sizes: np.ndarray, least: int, hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (three low bits: the hash function), texts, lefts and rights of all windows of texts, whose shingles stand one
    after the other, `sizes` of each."""
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    shingles = shingles[np.repeat(sizes >= least, sizes)]
    own = sizes[long]
    number = np.repeat(np.arange(len(long)), own)
    # A place of value 0 follows each text, so that no window goes on into the next one.
    begins = np.cumsum(own + 1) - (own + 1)
    spaced = np.arange(len(shingles)) + number
    # Equal shingles are told apart by place, so that a text that repeats one line still splits evenly.
    place = mix64((spaced - begins[number]).astype(np.uint64)) & np.uint64(0xFFFFF)
    keys, texts, lefts, rights = [], [], [], []
    for k in range(hashes):
        v = function_values(shingles, k, seed)
        values = np.zeros(len(shingles) + len(long), np.uint64)
        values[spaced] = np.maximum((v & ~np.uint64(0xFFFFF)) | place, np.uint64(1))
        found = compact_windows(values, least)
        found = found[values[found[:, 1]] > 0]
        text = np.searchsorted(begins, found[:, 1], side="right") - 1
        keys.append((v[found[:, 1] - text] & ~np.uint64(7)) | np.uint64(k))
        texts.append(long[text])
        lefts.append(found[:, 0] - begins[text])
        rights.append(found[:, 2] - begins[text])
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(lefts), np.concatenate(rights)


def windows_of(shingles: np.ndarray, least: int, hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lefts and rights of all windows of a document."""
    keys, _, lefts, rights = windows_of_texts(shingles, np.array([len(shingles)]), least, hashes, seed)
    return keys, lefts, rights


def covered(lefts: np.ndarray, rights: np.ndarray, functions: np.ndarray, n: int, needed: int) -> np.ndarray:
    """Places that windows of at least `needed` different functions cover."""
    total = np.zeros(n, np.int64)
    ends = np.minimum(rights, n - 1) + 1
    for k in set(functions.tolist()):
        at = functions == k
        edge = np.bincount(lefts[at], minlength=n + 1) - np.bincount(ends[at], minlength=n + 1)
        total += np.cumsum(edge)[:n] > 0
    return total >= needed


class Owner:
    """A first document's shingles, ready to be matched."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.order = np.argsort(shingles, kind="stable")
        self.sorted = shingles[self.order]

    def places(self, other: np.ndarray) -> np.ndarray:
        """First place of each shingle here, or -1."""
        if not len(self.sorted):
            return np.full(len(other), -1)
        at = np.minimum(np.searchsorted(self.sorted, other), len(self.sorted) - 1)
        return np.where(self.sorted[at] == other, self.order[at], -1)


def _runs(a: np.ndarray, first: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> list[list[int]]:
    """[start, end, start there] of runs of equal shingles; a run goes on where it can rather than at a first place."""
    out: list[list[int]] = []
    matched = np.flatnonzero((first >= 0) & allowed)
    if not len(matched):
        return out
    firsts = first[matched].tolist()
    n = len(b)
    start = there = last = -10
    for i, p in zip(matched.tolist(), firsts, strict=True):
        q = there + i - start
        if i == last + 1 and q < n and b[q] == a[i]:
            last = i
            continue
        if last >= 0:
            out.append([start, last + 1, there])
        start, there, last = i, p, i
    out.append([start, last + 1, there])
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    x, y = np.unique(a), np.unique(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _chains(a: np.ndarray, b: np.ndarray, runs: list[list[int]], least: int, percent: int, gap: int) -> set[tuple[int, int, int, int]]:
    """Runs joined over gaps of at most `gap` on both sides while the whole stays similar."""
    joined: list[list[list[int]]] = []
    for s, e, t in runs:
        piece = [s, e, t, t + e - s]
        last = joined[-1][-1] if joined else None
        if last and 0 <= s - last[1] <= gap and 0 <= t - last[3] <= gap:
            joined[-1].append(piece)
        else:
            joined.append([piece])
    found = set()
    for pieces in joined:
        s, e, t, f = pieces[0][0], pieces[-1][1], pieces[0][2], pieces[-1][3]
        if e - s < least:
            continue
        if len(pieces) == 1 or _similar(a[s:e], b[t:f], percent):
            found.add((s, e, t, f))
            continue
        chain = pieces[0][:]
        for s, e, t, f in pieces[1:]:
            if _similar(a[chain[0] : e], b[chain[2] : f], percent):
                chain[1], chain[3] = e, f
                continue
            if chain[1] - chain[0] >= least:
                found.add(tuple(chain))
            chain = [s, e, t, f]
        if chain[1] - chain[0] >= least:
            found.add(tuple(chain))
    return found


def matches(a: np.ndarray, owner: Owner, first: np.ndarray, allowed: np.ndarray, least: int, percent: int = PERCENT, gap: int = GAP) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Confirmed passages of a (start, end, start there, end there), and the (start, end) of its runs that the other text holds word by word; `least` shingles or more."""
    b = owner.shingles
    at = np.flatnonzero((first >= 0) & allowed)
    if len(at) < least * percent // 200:
        return [], []
    apart, jumps = np.diff(at) != 1, np.diff(first[at] - at) != 0
    if not (jumps & ~apart).any():
        # No shingle of these stands in two places there: runs are where neighbours stay neighbours.
        starts = np.r_[0, np.flatnonzero(apart) + 1]
        ends = np.r_[starts[1:], len(at)]
        runs = [[int(at[s]), int(at[e - 1]) + 1, int(first[at[s]])] for s, e in zip(starts, ends, strict=True)]
        back = []
    else:
        runs = _runs(a, first, b, allowed)
        # The same from behind, for runs whose beginning stands more than once in the other text.
        turned = Owner(b[::-1])
        back = [[len(a) - e, len(a) - s, len(b) - t - (e - s)] for s, e, t in _runs(a[::-1], turned.places(a[::-1]), turned.shingles, allowed[::-1])][::-1]
    found = _chains(a, b, runs, least, percent, gap) | _chains(a, b, back, least, percent, gap)
    return sorted(found), sorted({(s, e) for s, e, _ in [*runs, *back] if e - s >= least})


def passages(a: np.ndarray, owner: Owner, allowed: np.ndarray, least: int, percent: int = PERCENT, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(start, end, start there, end there) in shingles of the confirmed passages of a, `least` shingles or more."""
    return matches(a, owner, owner.places(a), allowed, least, percent, gap)[0]


def function_values(shingles: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Values of hash function k."""
    return mix64(shingles ^ np.uint64((seed * 1_000_003 + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def new_roots(shingles: np.ndarray, first: np.ndarray, found: list[tuple[int, int, int, int]], keys: np.ndarray, lefts: np.ndarray, rights: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(key, left, right) of windows that no passage found explains, at the next ROOTS roots that the other document does not hold."""
    out = []
    values: dict[int, np.ndarray] = {}
    for key, left, right in zip(keys.view(np.uint64).tolist(), lefts.tolist(), rights.tolist(), strict=True):
        if right >= len(shingles) or any(min(e, right + 1) - max(s, left) >= least for s, e, _, _ in found):
            continue
        k = key & 7
        if k not in values:
            values[k] = np.where(first < 0, function_values(shingles, k) & ~np.uint64(7), np.uint64(0))
        there = values[k][left : right + 1]
        out += [(x | k, left, right) for x in least_distinct(there[there > np.uint64(key - k)], ROOTS)]
    return out


def least_distinct(values: np.ndarray, most: int) -> list[int]:
    """The least `most` different values, in order."""
    values = np.sort(values)
    some = sorted(set(values[: 4 * most].tolist()))
    return some[:most] if len(some) >= most or len(values) <= 4 * most else np.unique(values)[:most].tolist()


def shingles_of(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts whose words stand one after the other from `begins` on, and how many each text has: none of a text
    with fewer words than a shingle."""
    sizes = np.diff(begins)
    taken = sizes >= WIDTH
    if not taken.any():
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    words, own = words[np.repeat(taken, sizes)], sizes[taken]
    # The last words of a text begin no shingle of it.
    left = np.repeat(np.cumsum(own), own) - np.arange(len(words))
    shingles = shingle_hashes(words, WIDTH)
    return shingles[left[: len(shingles)] >= WIDTH], np.where(taken, sizes - WIDTH + 1, 0)


def window_rows(df: DataFrame, text: str, doc_id: str, least: int, hashes: int) -> DataFrame:
    source = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text")).where("node is not null and __text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 4 << 20, "__text"):
            nodes = batch.column(0).to_numpy()
            hashed, at = word_hashes(batch.column(1))
            keys, texts, lefts, rights = windows_of_texts(*shingles_of(hashed, at), least - WIDTH + 1, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[texts]), pa.array(lefts.astype(np.int32)), pa.array(rights.astype(np.int32))], ["key", "node", "l", "r"])

    return source.mapInArrow(work, "key bigint, node bigint, l int, r int")


def few_tasks(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df, of at most so many rows, in no more tasks than one for `each` of them, or than the cluster has cores: late rounds
    have few rows, and whatever the number of partitions then, a task and a file for each cost more than the work."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def looked_up(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, to be broadcast while these are few."""
    return F.broadcast(few_tasks(df, rows, ROWS)) if rows <= BROADCAST_IDS else df


def sizes_of(pairs: DataFrame) -> tuple[int, int]:
    """Pairs, and the windows that they have."""
    n, windows = pairs.agg(F.count("*"), F.sum(F.size("windows"))).first()
    return n, windows or 0


def texts_of(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """The rows of texts (id, text) that n pairs name: looked up by broadcast while these are few, by a join beyond."""
    ids = pairs.select(F.col("node").alias("id")).union(pairs.select("owner")).distinct()
    return materialise(texts.join(looked_up(ids, 2 * n), "id", "left_semi"), "texts")


FOUND = ["node", "digest", "owner", "owner_digest", "start", "end", "owner_start", "owner_end", "exact"]
CONFIRMED = "node bigint, digest bigint, owner bigint, owner_digest bigint, start int, end int, owner_start int, owner_end int, exact array<struct<start:int,end:int>>, key bigint, l int, r int"


def confirm(pairs: DataFrame, sizes: tuple[int, int], texts: DataFrame, least: int, needed: int, again: bool) -> DataFrame:
    """Passages in words, for pairs (node, owner, windows), `sizes` of them; `exact` are the spans that the owner holds word by
    word. `texts` (id, text) has the pairs' texts among others.

    With `again`, also rows of key, node, l and r: the new roots of windows that the pair's passages do not explain.
    """
    # A document's followers are dealt to blocks, and its text comes once to each, before them.
    n, windows = sizes
    blocks = materialise(few_tasks(pairs.groupBy("owner").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("blocks")), n, ROWS), "blocks")
    several = blocks.where("blocks > 1")
    dealt = pairs.join(looked_up(several, n // FOLLOWERS), "owner", "left") if n > FOLLOWERS else pairs.withColumn("blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    later = texts.select(F.col("id").alias("node"), "text").join(looked_up(dealt, windows), "node").select("owner", "block", "node", "text", "windows", F.xxhash64("text").alias("digest"))
    later = only_windows(later).withColumn("kind", F.lit(1))
    none = F.lit(None).cast(pairs.schema["windows"].dataType)
    first = texts.join(looked_up(blocks, n), texts["id"] == blocks["owner"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = first.select("owner", "block", F.lit(0).alias("kind"), F.col("owner").alias("node"), "text", none.alias("windows"), F.xxhash64("text").alias("digest"), F.lit(0).alias("base"))
    order = ["owner", "block", "kind", "node", "text", "windows", "digest", "base"]
    both = later.select(*order).unionByName(first.select(*order)).repartition("owner", "block")
    both = few_tasks(both, n, TEXTS).sortWithinPartitions("owner", "block", "kind")

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [span, pa.int64(), pa.int32(), pa.int32()]
    names = [*FOUND, "key", "l", "r"]

    def table(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
        have = dict(zip(columns, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(have[c], kind) if c in have else pa.nulls(len(rows), kind) for c, kind in zip(names, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts, size = None, [], least - WIDTH + 1
        for whole in batches:
            for batch in slices(iter([whole]), 256, 4 << 20):
                rows: list[tuple] = []
                left_over: list[tuple] = []
                owners, kinds_, nodes, digests, bases = (batch.column(c).to_pylist() for c in (0, 2, 3, 6, 7))
                shingles, sizes = shingles_of(*word_hashes(batch.column(4)))
                parts = np.split(shingles, np.cumsum(sizes)[:-1])
                for k, (a, (keys, lefts, rights)) in enumerate(zip(parts, windows_by_row(batch.column(5)), strict=True)):
                    if kinds_[k] == 0:
                        if at != owners[k]:
                            at, firsts = owners[k], []
                        if digests[k] not in [d for d, _ in firsts]:
                            firsts.append((digests[k], Owner(a)))
                        continue
                    if len(a) < size:
                        continue
                    base = bases[k]
                    lefts, rights = lefts - base, rights - base
                    inside = lefts < len(a)  # windows of another text with the same id
                    keys, lefts, rights = keys[inside], lefts[inside], rights[inside]
                    allowed = covered(lefts, rights, keys & 7, len(a), needed)
                    for owner_digest, owner in firsts:
                        first = owner.places(a)
                        found, equal = matches(a, owner, first, allowed, size)
                        for s, e, t, f in found:
                            exact = [(base + max(s, x), base + min(e, y) + WIDTH - 1) for x, y in equal if min(e, y) - max(s, x) >= size]
                            rows.append((nodes[k], digests[k], owners[k], owner_digest, base + s, base + e + WIDTH - 1, t, f + WIDTH - 1, [{"start": x, "end": y} for x, y in exact]))
                        if again:
                            for key, x, y in new_roots(a, first, found, keys, lefts, rights, size):
                                left_over.append((key - (1 << 64) if key >> 63 else key, nodes[k], base + x, base + y))
                if rows:
                    yield table(rows, FOUND)
                if left_over:
                    yield table(left_over, ["key", "node", "l", "r"])

    # Written at once, so that the texts can go.
    out = materialise(both.mapInArrow(work, CONFIRMED), "confirmed")
    discard(blocks)
    return out


def windows_by_row(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, lefts, rights) of each row's windows; none where a row has no list."""
    columns = [np.asarray(c) for c in lists.flatten().flatten()]
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0))).tolist()
    for start, end in zip([0, *ends], ends):
        yield tuple(c[start:end] for c in columns)


def only_windows(rows: DataFrame) -> DataFrame:
    """rows, each text cut to the stretch of words from its first window to its last, and `base`, the place where that begins.

    Nothing outside a pair's windows is matched, and a long text that shares one line with many documents is sent as that
    stretch to each of them.
    """
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", base int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans = names.index("text"), names.index("windows")
        for batch in slices(batches, 512, 4 << 20):
            texts, bases = [], []
            for text, (_, lefts, rights) in zip(batch.column(at).cast(pa.binary()).to_pylist(), windows_by_row(batch.column(spans)), strict=True):
                words = text.split()
                inside = lefts < len(words) - (WIDTH - 1)
                base, end = (int(lefts[inside].min()), int(rights[inside].max()) + WIDTH) if inside.any() else (0, 0)
                texts.append(b" ".join(words[base:end]).decode())
                bases.append(base)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bases, pa.int32())], [*names, "base"])

    return rows.mapInArrow(work, schema)


def compared(hits: DataFrame, needed: int, n: int) -> DataFrame:
    """(node, owner, windows): pairs of documents that share roots of at least `needed` functions, among at most n hits."""
    pairs = hits.where("node <> owner").groupBy("node", "owner").agg(F.collect_set(F.struct("key", "l", "r")).alias("windows"))
    return few_tasks(pairs.where(F.size(F.array_distinct(F.transform("windows", lambda w: w["key"].bitwiseAND(7)))) >= needed), n, ROWS)


def with_owner(windows: DataFrame, n: int) -> DataFrame:
    """Those of n windows whose root another document has too, with the smallest such document."""
    shared = windows.groupBy("key").agg(F.min("node").alias("owner"), F.max("node").alias("last")).where("owner < last").select("key", "owner")
    return windows.join(looked_up(shared, n), "key")


def unexplained(rows: DataFrame, least: int) -> DataFrame:
    """Windows (key, node, l, r) among rows, each once, without a passage (key is null; start, end) of their document in rows
    that has `least` words in them."""
    spans = F.collect_set(F.when(F.col("key").isNull(), F.struct("start", "end")))
    left = F.collect_set(F.when(F.col("key").isNotNull(), F.struct("key", "l", "r")))
    held = rows.groupBy("node").agg(spans.alias("spans"), left.alias("left")).where(F.size("left") > 0)
    open_ = lambda w: ~F.exists("spans", lambda s: F.least(s["end"] - (WIDTH - 1), w["r"] + 1) - F.greatest(s["start"], w["l"]) >= least - WIDTH + 1)
    return held.select("node", F.explode(F.filter("left", open_)).alias("w")).select("w.key", "node", "w.l", "w.r")


def copies_of(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, digest, owner): documents whose whole text a smaller one has."""
    rows = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text")).where("node is not null and __text is not null")
    rows = materialise(rows.select("node", F.xxhash64("__text").alias("digest"), F.xxhash64(F.lit(1), "__text").alias("second")), "digests")
    owners = rows.groupBy("digest", "second").agg(F.min("node").alias("owner"), F.max("node").alias("last")).where("owner < last").select("digest", "second", "owner")
    n = rows.count()
    owners = materialise(few_tasks(owners, n, ROWS), "first-copies")  # so that the engine may split a text with very many copies
    held = rows.join(looked_up(owners, n), ["digest", "second"]).where("owner < node").select("node", "digest", "owner")
    copies = materialise(few_tasks(held.distinct(), n, ROWS), "copies")
    discard(rows, owners)
    return copies


def repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, hashes: int = HASHES, needed: int = NEEDED) -> DataFrame:
    """Confirmed passages: node holds at [start, end) words what owner, a smaller id, holds at [owner_start, owner_end)."""
    copies = copies_of(df, text, doc_id)
    few = copies.count()
    same = (F.col(doc_id).cast("long") == F.col("__node")) & (F.xxhash64(text) == F.col("__digest"))
    gone = copies.select(F.col("node").alias("__node"), F.col("digest").alias("__digest"))
    gone = F.broadcast(gone) if few <= BROADCAST_IDS else gone
    own = df.select(text, doc_id).join(gone, same, "left_anti") if few else df

    windows = materialise(window_rows(own, text, doc_id, least, hashes), "windows")
    hits = materialise(with_owner(windows, windows.count()), "hits")
    discard(windows)
    source = own.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    hit = hits.count()
    pairs = materialise(compared(hits, needed, hit), "pairs")
    first = sizes_of(pairs)
    texts = texts_of(pairs, first[0], source)
    met = confirm(pairs, first, texts, least, needed, True)
    discard(texts)
    found = met.where("key is null").select(*FOUND)
    missed = exact_pairs(hits, hit, found, own, text, doc_id, least, hashes)
    sizes = sizes_of(missed)
    texts = texts_of(missed, sizes[0], source)
    exact = confirm(missed, sizes, texts, least, min(needed, NEEDED), False)
    discard(texts, missed)
    found = found.unionByName(exact.select(*FOUND))
    known = pairs.select("node", "owner")
    left = hits.where("node <> owner").join(looked_up(known, first[0]), ["node", "owner"], "left_anti")
    names = ["node", "key", "l", "r", "start", "end"]
    rows = left.select("node", "key", "l", "r").unionByName(met.select(*names), True).unionByName(exact.select(*names))
    windows = materialise(few_tasks(unexplained(rows, least), hit + met.count(), ROWS), "windows")
    discard(hits, pairs)

    # Later rounds compare whatever shares a root: each window of a round is then explained or gets greater roots. Their
    # documents are among the round's before, so texts are read from what is left of these, and what earlier rounds
    # explained has gone then.
    texts, held = source, None
    while True:
        here = windows.count()
        pairs = materialise(compared(with_owner(windows, here), 1, here), "pairs")
        sizes = sizes_of(pairs)
        n = sizes[0]
        if not n:
            break
        if held is None or n <= held // FEWER:
            before, texts, held = texts, texts_of(pairs, n, texts), n
            discard(before)
        met = confirm(pairs, sizes, texts, least, 1, True)
        found = found.unionByName(met.where("key is null").select(*FOUND))
        discard(windows, pairs)
        windows = materialise(few_tasks(unexplained(met, least), met.count(), ROWS), "windows")
    discard(windows, pairs, texts)
    found = found.drop("exact")
    if not few:
        return found
    small = F.broadcast(copies) if few <= BROADCAST_IDS else copies
    keys = small.select(F.col("node").alias("__node"), F.col("digest").alias("__digest"))
    counts = word_counts(df.select(text, doc_id).join(keys, same, "left_semi"), text, doc_id).select(F.col("doc_id").alias("node"), "digest", F.col("n_words").cast("int").alias("n"))
    whole = materialise(counts.where(F.col("n") >= least).distinct().join(small, ["node", "digest"]), "whole-copies")
    first = whole.select("node", "digest", "owner", F.col("digest").alias("owner_digest"), F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(0).alias("owner_start"), F.col("n").alias("owner_end"))
    # What the class's first document repeats, its copies repeat too.
    kept = whole.select(F.col("node").alias("copy"), "digest", F.col("owner").alias("node"))
    more = found.join(kept, ["node", "digest"]).drop("node").withColumnRenamed("copy", "node")
    return materialise(found.unionByName(first).unionByName(more), "passages")


def runs_of_words(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, by differences of a running sum of words times powers of an odd number."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(words) - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))
        sums = np.r_[np.uint64(0), np.cumsum(mix64(words) * powers, dtype=np.uint64)]
        return mix64((sums[width:] - sums[:n]) * inverse[:n])


def lowest(values: np.ndarray, width: int, lesser: np.ufunc = np.minimum) -> np.ndarray:
    """Least value of every run of `width` values; the greatest with np.maximum."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = lesser(values[:-step], values[step:])
        have += step
    return values


def shared_roots(shingles: np.ndarray, keys: np.ndarray, width: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run of `width` shingles: a number made of its roots, and whether all of them are among the keys.

    Windows compare all but the 20 low bits of values, so roots are compared by these.
    """
    label = np.zeros(len(shingles) - width + 1, np.uint64)
    open_ = np.ones(len(label), bool)
    functions = keys & np.uint64(7)
    for k in range(hashes):
        root = lowest(function_values(shingles, k) >> np.uint64(20), width)
        turns = np.concatenate([[0], np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]])
        own = np.sort(keys[functions == k] >> np.uint64(20))
        at, held = np.searchsorted(own, root[turns[:-1]]), root[turns[:-1]]
        known = own[np.minimum(at, len(own) - 1)] == held if len(own) else np.zeros(len(held), bool)
        open_ &= np.repeat(known, np.diff(turns))
        label = mix64(label * np.uint64(BASE) + root)
    return label, open_


def exact_pairs(shared: DataFrame, n: int, found: DataFrame, df: DataFrame, text: str, doc_id: str, least: int, hashes: int) -> DataFrame:
    """Pairs (node, owner, windows) for runs of `least` words and their smallest holder, but for runs in `exact` spans of `found`.

    `shared` has all n windows whose root another document has too. Equal runs have equal roots for every hash function, so
    only runs whose own roots are all shared are looked at. Neighbouring runs with the same roots are one row, and rows whose
    roots no second document has open are left before their runs are compared.
    """
    parts = shared.groupBy("node").agg(F.collect_set("key").alias("keys")).where(F.size(F.array_distinct(F.transform("keys", lambda x: x.bitwiseAND(7)))) >= hashes)
    # What is known comes to the keys first, so that texts are dealt once; digests tell texts with the same id apart.
    spans = found.where(F.size("exact") > 0).groupBy("node").agg(F.collect_set(F.struct("digest", "exact")).alias("known"))
    parts = parts.join(spans, "node", "left")
    texts = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text")).where("node is not null and __text is not null").join(looked_up(parts, n), "node")
    known = F.flatten(F.transform(F.filter("known", lambda x: x["digest"] == F.xxhash64("__text")), lambda x: x["exact"]))
    texts = texts.select("node", "__text", "keys", known.alias("known")).select("node", "__text", "keys", F.col("known.start").alias("starts"), F.col("known.end").alias("ends"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 4 << 20, "__text"):
            roots, nodes, places, lists, sizes = [np.empty(0, np.uint64)], [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
            hashed, begins = word_hashes(batch.column(1))
            shingles, counts = shingles_of(hashed, begins)
            parts = np.split(shingles, np.cumsum(counts)[:-1])
            for k, node in enumerate(batch.column(0).to_pylist()):
                words = hashed[begins[k] : begins[k + 1]]
                if len(words) < least:
                    continue
                keys = np.asarray(batch.column(2)[k].values, np.int64).view(np.uint64)
                label, open_ = shared_roots(parts[k], keys, least - WIDTH + 1, hashes)
                for s, e in zip(batch.column(3)[k].as_py() or (), batch.column(4)[k].as_py() or (), strict=True):
                    open_[s : e - least + 1] = False
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (label[at[1:]] != label[at[:-1]])])
                roots.append(label[at[first]])
                places.append(at[first])
                nodes.append(np.full(len(first), node, np.int64))
                lists.append(runs_of_words(words, least)[at])
                sizes.append(np.diff(np.r_[first, len(at)]))
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(lists).view(np.int64)))
            nodes = np.concatenate([np.empty(0, np.int64), *nodes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(roots).view(np.int64)), pa.array(nodes), pa.array(np.concatenate(places).astype(np.int32)), runs], ["roots", "node", "at", "runs"])

    rows = materialise(texts.mapInArrow(work, "roots bigint, node bigint, at int, runs array<bigint>"), "runs")
    several = rows.groupBy("roots").agg(F.min("node").alias("one"), F.max("node").alias("other")).where("one < other").select("roots")
    n = rows.count()
    open_runs = materialise(rows.join(looked_up(several, n), "roots").drop("roots"), "open-runs")
    discard(rows)
    n = open_runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    rows = open_runs.select("node", "at", F.posexplode("runs").alias("step", "run")).select("run", "node", (F.col("at") + F.col("step")).alias("at"))
    holders = rows.groupBy("run").agg(F.min("node").alias("owner"), F.max("node").alias("last")).where("owner < last").select("run", "owner")
    links = rows.join(looked_up(holders, n), "run").where("node <> owner")
    rest = links.groupBy("node", "owner").agg(F.min("at").alias("l"), (F.max("at") + least - WIDTH).alias("r"))
    window = lambda k: F.struct(F.lit(k).cast("long").alias("key"), "l", "r")
    rest = rest.select("node", "owner", F.array(*[window(k) for k in range(NEEDED)]).alias("windows"))
    rest = materialise(few_tasks(rest, n, ROWS), "missed")
    discard(open_runs)
    return rest


def merged(column: str, overlap: int = 0):
    """Sorted, joined spans of an array of (start, end); with `overlap`, only spans with so much in common (or all of one) are joined."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] + F.least(F.lit(overlap), x["end"] - x["start"], last["end"] - last["start"]) <= last["end"], joined).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(column), F.array().cast(kind), step)


def spans_by_document(found: DataFrame) -> DataFrame:
    """(id, digest, repeats, shared, firsts): a document's spans that repeat an earlier one's, all its shared spans, and the ids of the first documents."""
    span = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    own = found.select(F.col("node").alias("id"), "digest", F.lit(True).alias("later"), span("start", "end").alias("span"), "owner")
    first = found.select(F.col("owner").alias("id"), F.col("owner_digest").alias("digest"), F.lit(False).alias("later"), span("owner_start", "owner_end").alias("span"), "owner")
    rows = own.union(first).distinct()
    lists = rows.groupBy("id", "digest").agg(F.collect_set(F.when(F.col("later"), F.col("span"))).alias("repeats"), F.collect_set("span").alias("shared"), F.collect_set("owner").alias("firsts"))
    return lists.select("id", "digest", merged("repeats").alias("repeats"), merged("shared").alias("shared"), F.array_sort("firsts").alias("firsts"))


def partners(found: DataFrame, n: int, least: int = LEAST) -> DataFrame:
    """(node, n_links): how many other documents hold a passage that the node holds, each counted once; found has n rows.

    Stretches of a first document that have `least` words in common are one passage. Documents with the same passages are
    one class. A class's links are the holders of its passages added up, less what is added twice: classes that share two
    passages or more with it. These meet by prefix: passages ordered from rare to frequent, two classes that share two share
    one that is not the last of either. So a passage that very many classes hold brings them together only if a second one does.
    """
    of_owner = found.groupBy("owner").agg(F.collect_set(F.struct(F.col("owner_start").alias("start"), F.col("owner_end").alias("end"))).alias("spans")).select("owner", merged("spans", least).alias("held"))
    of_owner = materialise(few_tasks(of_owner, n, ROWS), "held")
    around = F.filter("held", lambda p: (p["start"] <= F.col("owner_start")) & (F.col("owner_end") <= p["end"]))
    later = found.join(looked_up(of_owner, n), "owner").select("node", "owner", around[0]["start"].alias("at"))
    first = of_owner.select(F.col("owner").alias("node"), "owner", F.explode("held").alias("p")).select("node", "owner", F.col("p.start").alias("at"))
    members = later.union(first).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("owner", "at"))).alias("passages"))
    # Each row of found adds one document to one passage at most, and each passage has an owner.
    n = 2 * n
    members = materialise(few_tasks(members, n, ROWS), "members")
    classes = materialise(few_tasks(members.groupBy("passages").agg(F.count("*").alias("n"), F.min("node").alias("class")), n, ROWS), "classes")
    parts = classes.select("class", "n", F.explode("passages").alias("p"))
    holders = materialise(few_tasks(parts.groupBy("p").agg(F.sum("n").alias("holders"), F.count_if(F.lit(True)).alias("classes")), n, ROWS), "holders")
    held = materialise(parts.join(looked_up(holders, n), "p"), "held-by-class")
    sums = held.groupBy("class").agg(F.sum("holders").alias("holders"))
    # Only passages of several classes can be shared, and one alone is never added twice.
    several = held.where("classes > 1").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("classes", "p"))).alias("ps")).where(F.size("ps") > 1)
    several = materialise(few_tasks(several.select("class", "n", F.transform("ps", lambda x: x["p"]).alias("ps")), n, ROWS), "several")
    keys = several.select("class", "n", "ps", F.explode(F.slice("ps", 1, F.size("ps") - 1)).alias("p"))
    met = keys.join(keys.select("p", F.col("class").alias("other"), F.col("n").alias("m"), F.col("ps").alias("qs")), "p").where("class <> other")
    common = F.size(F.array_intersect("ps", "qs"))
    twice = met.where(common > 1).groupBy("class", "other").agg(F.max(F.col("m") * (common - 1)).alias("m")).groupBy("class").agg(F.sum("m").alias("twice"))
    # The documents of the class itself were added once for each of its passages.
    own = classes.select("passages", "class", (F.col("n") * (F.size("passages") - 1) + 1).alias("own"))
    links = own.join(sums, "class").join(twice, "class", "left").select("passages", (F.col("holders") - F.col("own") - F.coalesce("twice", F.lit(0))).alias("n_links"))
    return members.join(links, "passages").select("node", "n_links")


def word_counts(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest of the text, n_words) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="__text"):
            n = [len(words_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "digest", "n_words"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("__text")).mapInArrow(work, "doc_id bigint, digest bigint, n_words bigint")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of df: doc_id, component_id (smallest id reachable by shared passages, itself included), n_links
    (other documents that hold one of its passages), n_words, n_shared, n_repeated (words), first_ids, shared and repeated spans in words."""
    found = repeated_passages(df, text, doc_id)
    n = found.count()
    spans = spans_by_document(found)
    links = materialise(few_tasks(found.select(F.col("node").alias("a"), F.col("owner").alias("b")).distinct(), n, ROWS), "passage-links")
    classes = components(links).withColumnRenamed("component", "component_id").join(partners(found, n), "node").withColumnRenamed("node", "doc_id")
    base = materialise(word_counts(df, text, doc_id), "word-counts")
    joined = base.join(spans.withColumnRenamed("id", "doc_id"), ["doc_id", "digest"], "left").join(classes, "doc_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<start:int,end:int>>"))
    total = lambda c: F.aggregate(none(c), F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return joined.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_words", total("shared").alias("n_shared"), total("repeats").alias("n_repeated"), F.coalesce("firsts", F.array().cast("array<bigint>")).alias("first_ids"), none("shared").alias("shared"), none("repeats").alias("repeated"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between these words; the rest as it was."""
    places = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[min(end, len(places)) - 1][1]
    return "".join([*out, text[at:]])


def cut_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df with all their columns, repeats of earlier documents cut from the text; rows with nothing left go."""
    spans = spans_by_document(repeated_passages(df, text, doc_id)).where(F.size("repeats") > 0).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("repeats").alias("__spans"))
    spans = materialise(spans, "spans")
    few = spans.count() <= BROADCAST_IDS
    keys = spans.select("__id", "__digest").distinct()
    keys = F.broadcast(keys) if few else keys
    held = (F.col(doc_id).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__digest"))
    clean = df.join(keys, held, "left_anti")
    hit = df.join(keys, held, "left_semi").join(spans, held).drop("__id", "__digest")
    names = df.columns
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [without(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts, lists, strict=True)]
            left = pa.array([bool(WORDS.search(t)) for t in new])
            columns = [pa.array(new, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(left)

    return clean.unionByName(hit.mapInArrow(work, df.schema))
