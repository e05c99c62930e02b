"""Operator 7: near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of `groups` min-hash groups are computed for each document. A table key pairs one group of the first
collection with one of the second, so groups x groups tables come from 2 x groups x rows min-hashes, about the square root
of what as many tables would take one by one. At a similarity of 0.75 two documents share a table with probability
(1 - (1 - 0.75^rows)^groups)^2, 0.9973 with the default parameters and rising fast above.

1. Documents with equal shingle sets are one class; only the class's smallest doc_id goes on.
2. In each table bucket all members are compared with one hub (its smallest id): as many pairs as rows, never all pairs.
   The hub is found by an aggregation, so a bucket of any size needs no single task.
3. Pairs are confirmed on full sets; confirmed ones are joined into components.
4. Buckets that now lie in one component are settled. Members of the others can have links that no hub shows. These are
   found over those members alone by a prefix filter: shingles ordered from rare to frequent, two sets of that similarity
   share one of their first n - ceil(0.75 n) + 1, early enough in both to leave the overlap that is asked for. In rounds,
   every member is compared with its likeliest candidate of another component and components merge; a round has as many
   rows as the prefixes, whatever the size of a family. When a round finds no link, all candidates that are left between
   different components are compared, so no link is lost. A passage that many documents hold is frequent, so documents
   that share no more than it don't meet.
5. Components are joined again over both kinds of links.

Defined cases: null, empty or wordless texts have no shingles and are linked with nothing; with fewer than five words the
whole sequence is one shingle; rows that repeat a doc_id are one document to links, with a row each in the result; rows
without doc_id take the component of documents with the same shingle set, and null where none of these has an id. Very long
texts are read whole; of documents that are alike the smallest id stays; an empty table gives no row; further columns,
whatever their names, are passed on by drop_near_duplicates and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, list_array, materialise, shingle_hashes, slices, words_of

WIDTH, PERCENT = 5, 75
#: Ids of rows to be looked up are broadcast up to this number; beyond it the texts are shuffled.
BROADCAST_IDS = 400_000


def shingle_set(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(hashes.array(words_of(text)), width))


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signatures(df: DataFrame, text: str, doc_id: str, groups: int, rows: int, seed: int, width: int) -> DataFrame:
    """row_key, doc_id, digest (of the text), n_shingles, klass (digest of the set), the two collections of group hashes."""
    import xxhash

    source = df.select(F.monotonically_increasing_id().alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"), F.xxhash64(text).alias("digest"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import mix64

        hashes = WordHashes()
        mul, add = _constants(2 * groups * rows, seed)
        for batch in slices(batches, 1024, 4 << 20, "__text"):
            sets = [shingle_set(t, hashes, width) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            x = np.concatenate([np.empty(0, np.uint64), *sets])
            starts = np.r_[0, np.cumsum(sizes[full])][:-1]
            bands = np.zeros((len(full), 2 * groups), np.uint64)
            if len(full):
                for g in range(2 * groups):
                    for k in range(g * rows, (g + 1) * rows):
                        bands[:, g] = mix64(bands[:, g] * np.uint64(31) + np.minimum.reduceat(x * mul[k] + add[k], starts) + np.uint64(g))
            digests: list[bytes | None] = [None] * len(sets)
            for i in full:
                digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            offsets = np.r_[0, np.cumsum(np.where(sizes > 0, groups, 0))]
            first, second = (np.ascontiguousarray(b).view(np.int64).ravel() for b in (bands[:, :groups], bands[:, groups:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes), pa.array(digests, pa.binary()), list_array(offsets, pa.array(first)), list_array(offsets, pa.array(second))],
                ["row_key", "doc_id", "digest", "n_shingles", "klass", "first", "second"],
            )

    return source.mapInArrow(work, "row_key bigint, doc_id bigint, digest bigint, n_shingles bigint, klass binary, first array<bigint>, second array<bigint>")


def sets_of(df: DataFrame, nodes: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(node, shingles) of the documents whose id is in nodes."""
    few = nodes.count() <= BROADCAST_IDS
    wanted = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text")).join(F.broadcast(nodes) if few else nodes, "node", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 512, 4 << 20, "__text"):
            sets = [shingle_set(t, hashes, width) for t in batch.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(offsets, pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))], ["node", "shingles"])

    return wanted.mapInArrow(work, "node bigint, shingles array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where((100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round takes the smallest label among neighbours and then the label of the label; rounds end when none changes.
    """
    both = materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        after = materialise(lower.join(jump, "mid").select("node", "before", F.least("mid", "far").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("before <> component").limit(1).count() == 0:
            return labels


def prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, slack, s): the prefix of every node's set in the order from rare to frequent shingles.

    `slack` is the largest set that can still be similar enough if s is the first shingle in common: two rows of a shingle
    are a candidate only if either's n is at most the other's slack. Shingles of one node only come first and give no row.
    """
    one = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = materialise(one.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "often")
    ordered = one.join(often, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("xs"))
    alone = F.col("n") - F.size("xs")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    rows = ordered.where(length > 0).select("node", "n", (F.col("n") - alone).alias("shared"), F.posexplode(F.slice("xs", 1, length)).alias("at", "x"))
    slack = F.floor((F.col("shared") - F.col("at")) * (100 + percent) / percent).cast("int") - F.col("n")
    return rows.select("node", "n", slack.alias("slack"), F.col("x.s").alias("s"))


def _sides(prefix: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(index, probe): rows of prefixes with their component, dealt by shingle and band of sizes.

    The smaller set of a pair is in the index, in all bands that its partners' sizes can have; the larger one probes its own.
    """
    rows = prefix.join(labels, "node")
    band = lambda c: F.floor(F.log(F.col(c).cast("double")) / float(np.log(100 / percent))).cast("int")
    index = rows.where("slack >= n").select("s", F.explode(F.sequence(band("n"), band("slack"))).alias("band"), F.col("node").alias("small"), F.col("n").alias("small_n"), F.col("slack").alias("small_slack"), F.col("component").alias("small_component"))
    return index, rows.select("s", band("n").alias("band"), "node", "n", "slack", "component")


def proposals(prefix: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each row of a prefix at most one candidate of another component, the one with most slack.

    Of every size in a band of a shingle's rows, the index keeps the best row and the best one of another component, so
    there is a candidate wherever there is any, however many rows share the shingle.
    """
    index, probe = _sides(prefix, labels, percent)
    key = ["s", "band", "small_n"]
    best = index.groupBy(*key, "small_component").agg(F.max(F.struct(F.col("small_slack").alias("slack"), F.col("small").alias("node"))).alias("x"))
    best = materialise(best.select(*key, F.struct("x.slack", F.col("small_component").alias("component"), "x.node").alias("x")), "best")
    first = best.groupBy(*key).agg(F.max("x").alias("first"))
    second = best.join(first, key).where("x.component <> first.component").groupBy(*key).agg(F.max("x").alias("second"))
    menu = first.join(second, key, "left").groupBy("s", "band").agg(F.collect_list(F.struct("small_n", "first", "second")).alias("menu"))
    other = F.transform("menu", lambda m: F.struct(m["small_n"].alias("n"), F.when(m["first"]["component"] != F.col("component"), m["first"]).otherwise(m["second"]).alias("x")))
    fits = F.filter(other, lambda m: (m["n"] <= F.least("n", "slack")) & (m["x"]["slack"] >= F.col("n")))
    found = probe.join(menu, ["s", "band"]).select("node", F.array_max(F.transform(fits, lambda m: F.struct(m["x"]["slack"].alias("slack"), m["x"]["node"].alias("other")))).alias("x")).where("x is not null")
    met = materialise(found.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct(), "proposals")
    discard(best)
    return met


def unsettled_pairs(sets: DataFrame, labels: DataFrame, percent: int, prefix: DataFrame | None = None) -> DataFrame:
    """All candidate pairs with different labels among the nodes of `labels` (node, component), by prefix filter.

    A pair is made only where its first common shingle leaves enough of both sets for the similarity asked for.
    """
    index, probe = _sides(prefixes(sets, labels, percent) if prefix is None else prefix, labels, percent)
    fits = (F.col("small_n") <= F.least("n", "slack")) & (F.col("small_slack") >= F.col("n")) & (F.col("small_component") != F.col("component"))
    keys = (probe["s"] == index["s"]) & (probe["band"] == index["band"])
    return probe.join(index, keys & fits).select(F.least("node", "small").alias("a"), F.greatest("node", "small").alias("b")).distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links (a, b) between nodes of `labels`: components of components."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    moved = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).withColumnRenamed("component", "to")
    return labels.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def settle(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels of the nodes of `labels` once no link between two of them is left out.

    Rounds of proposals: every node meets the likeliest candidate of another component, links that hold merge components,
    and rounds end when none holds; rows of a round are as many as the prefixes have. What is then still possible between
    different components is compared pair by pair.
    """
    prefix = materialise(prefixes(sets, labels, percent), "prefix")
    tried = None
    while True:
        pairs = proposals(prefix, labels, percent)
        if tried is not None:
            pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "proposals")
        if not pairs.limit(1).count():
            return labels  # no node has a candidate
        links = materialise(confirm(pairs, sets, percent), "links")
        if not links.limit(1).count():
            break
        labels = materialise(joined(labels, links), "labels")
        tried = pairs if tried is None else tried.union(pairs)
    rest = unsettled_pairs(sets, labels, percent, prefix)
    links = materialise(confirm(rest if tried is None else rest.join(tried.union(pairs), ["a", "b"], "left_anti"), sets, percent), "links")
    labels = materialise(joined(labels, links), "labels") if links.limit(1).count() else labels
    discard(prefix)
    return labels


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, n): rows of the buckets of three or more that don't lie in one component."""
    known = materialise(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("key", "n")
    return materialise(known.join(mixed, "key"), "unsettled")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", groups: int = 8, rows: int = 2, percent: int = PERCENT, width: int = WIDTH, seed: int = 7) -> DataFrame:
    """row_key, doc_id, digest, n_shingles, component_id, kept (doc_id = component_id), first_row (the one row that stays of those with equal sets)."""
    base = materialise(signatures(df, text, doc_id, groups, rows, seed, width), "signatures")
    classes = base.where("klass is not null").groupBy("klass").agg(F.min("doc_id").alias("node"), F.min_by("row_key", F.struct("doc_id", "row_key")).alias("first_key"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("chosen"), F.any_value("first").alias("first"), F.any_value("second").alias("second"))
    classes = materialise(classes.select("klass", "node", F.coalesce("chosen.row_key", "first_key").alias("first_key"), "first", "second"), "classes")

    pair_keys = F.flatten(F.transform("first", lambda x, i: F.transform("second", lambda y, j: F.xxhash64(x, y, i * groups + j))))
    keys = classes.where("node is not null").select("node", F.explode(pair_keys).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    members = materialise(keys.join(hubs, "key"), "buckets")
    nodes = materialise(members.select("node").distinct(), "nodes")
    sets = materialise(sets_of(df, nodes, text, doc_id, width), "sets")
    tried = members.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(confirm(tried, sets, percent), "links")

    labels = components(links)
    rest = unsettled(members, labels)
    discard(members)
    # Two links from different buckets can meet in a component that has no node here: whole components are relabelled.
    moved = settle(sets, materialise(rest.select("node", "component").distinct(), "rest"), percent)
    moved = rest.select("node", "component").distinct().join(moved.withColumnRenamed("component", "to"), "node").where("to <> component")
    if moved.limit(1).count():
        labels = components(links.union(moved.select(F.col("component").alias("a"), F.col("to").alias("b"))))
    discard(sets, rest)

    of_class = classes.select("klass", "node", "first_key").join(labels, "node", "left").select("klass", "first_key", F.coalesce("component", "node").alias("component"))
    out = base.select("row_key", "doc_id", "digest", "n_shingles", "klass").join(of_class, "klass", "left")
    component = F.when(F.col("klass").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("row_key", "doc_id", "digest", "n_shingles", component.alias("component_id"), F.coalesce(F.col("row_key") == F.col("first_key"), F.lit(True)).alias("first_row"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of df, with all their columns, that stay: one document of each component, and one row where a row repeats."""
    found = materialise(near_duplicates(df, text, doc_id, **options).select("doc_id", "digest", "kept", "first_row"), "decisions")
    key = lambda a, b: F.col(doc_id).cast("long").eqNullSafe(F.col(a)) & F.xxhash64(text).eqNullSafe(F.col(b))
    gone = found.where("not kept").select(F.col("doc_id").alias("__a"), F.col("digest").alias("__b")).distinct()
    again = found.where("kept and not first_row").select(F.col("doc_id").alias("__a"), F.col("digest").alias("__b")).distinct()
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    stay = df.join(small(gone), key("__a", "__b"), "left_anti")
    if not again.limit(1).count():
        return stay
    again = small(again)
    alone = stay.join(again, key("__a", "__b"), "left_anti")
    repeated = stay.join(again, key("__a", "__b"), "left_semi")
    order = Window.partitionBy(F.col(doc_id), F.xxhash64(text)).orderBy(F.lit(1))
    return alone.unionByName(repeated.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n"))
