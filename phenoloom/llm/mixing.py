"""Operator 2: mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target is its weight's share of all words, held to `most` times the source's own words; what is over is
shared again by weight. A document of a source gets target/words copies: the whole part always, the fractional part as a
probability. Probabilities are rounded in pairs: words are moved from one document's probability to the other's until one
of them is 0 or 1, in a direction chosen at random so that every expectation stays; a source's sum of words stays too.
Pairs are made inside groups of about `fan_in` documents of like length; each group leaves at most one fractional
document, and these meet in groups again: a reduction tree whose depth is the logarithm of the documents and whose groups
are bounded, so one source with most of the rows is spread over as many groups as its size asks for. What is left at the
root, one document for each source and power of two in length, is rounded long ones first so that the source ends within
about half a short document of its target.
Random numbers are hashes of the seed and the two documents (id, source and text), so reruns agree whatever the
partitioning. Rows that are alike in all three are numbered, each partition's after those of the partitions before it, so
they are dealt to groups like different documents; which of them has which number makes no difference.

Defined cases: null or wordless texts have size 0 and take 0 words; a null source is a source of its own, last in order;
rows with a null or repeated doc_id are rows like any others; a source without words has target 0; rows without words are
taken once by mixed_rows. An empty table gives an empty result; columns of df may have any name but those that begin with
two underscores; a very long text is one item whose words are taken as a whole. Ties in length go by the hash of id, source
and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS = (5, 2, 1)
#: Chosen rows' keys are broadcast up to this number; beyond it they are joined.
BROADCAST_KEYS = 400_000


def word_count(text: str = "text"):
    """Number of runs of anything but ASCII white space, without splitting: ends of runs are counted."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target. The windows run over one row for each source, not over documents."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__total", F.sum("source_size").over(everything).cast("double")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    # In ascending order of cap per weight, the level at which the rest would be shared if all before were held at their cap.
    upto = Window.orderBy("__ratio", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__ratio", F.col("source").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / F.sum("__w").over(after))
    ranked = ranked.withColumn("__share", F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__level"))).over(everything))
    target = F.when(F.col("__ratio") >= F.col("__share.__ratio"), F.col("__w") * F.col("__share.__level")).otherwise(F.col("__cap"))
    return ranked.select("source", "source_size", F.coalesce(target, F.col("__cap")).alias("target"))


ITEM = "struct<id:bigint,key:bigint,words:bigint,p:double>"


def _dice(seed: int, *columns):
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _item(x, p=None):
    return F.struct(x["id"].alias("id"), x["key"].alias("key"), x["words"].alias("words"), (x["p"] if p is None else p).alias("p"))


def _round_groups(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Pair up the documents of each (source_no, size_class, group): decided holds the integral ones, left the one that isn't."""

    def step(acc, b):
        a = acc["left"]
        a_room, a_has, b_room, b_has = a["words"] * (1 - a["p"]), a["words"] * a["p"], b["words"] * (1 - b["p"]), b["words"] * b["p"]
        up, down = F.least(a_room, b_has), F.least(a_has, b_room)
        rise = _dice(seed, F.lit(level), a["id"], b["id"]) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        # The one whose bound was met is integral by construction, not by comparing rounded sums.
        a_full, b_full = F.when(rise, a_room <= b_has).otherwise(a_has <= b_room), F.when(rise, a_room >= b_has).otherwise(a_has >= b_room)
        new_a = _item(a, F.when(a_full, rise.cast("double")).otherwise(a["p"] + moved / a["words"]))
        new_b = _item(b, F.when(b_full, (~rise).cast("double")).otherwise(b["p"] - moved / b["words"]))
        decided = F.when(a_full & b_full, F.array(new_a, new_b)).when(a_full, F.array(new_a)).otherwise(F.array(new_b))
        left = F.when(a_full & b_full, F.lit(None).cast(ITEM)).when(a_full, new_b).otherwise(new_a)
        met = F.struct(left.alias("left"), F.concat(acc["decided"], decided).alias("decided"))
        return F.when(a.isNull(), F.struct(b.cast(ITEM).alias("left"), acc["decided"].alias("decided"))).otherwise(met)

    start = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(f"array<{ITEM}>").alias("decided"))
    gathered = rows.groupBy("source_no", "size_class", "group").agg(F.sort_array(F.collect_list(F.struct("words", "id", "key", "p"))).alias("xs"))
    return gathered.select("source_no", "size_class", F.aggregate(F.transform("xs", lambda x: _item(x)), start, step).alias("y")).select("source_no", "size_class", "y.*")


def _last_draws(left: DataFrame) -> DataFrame:
    """Each source has at most one fractional document in each size class: long ones first, each to the side that brings the source nearest to its target."""

    def step(acc, x):
        over, under = acc["off"] + x["words"] * (1 - x["p"]), acc["off"] - x["words"] * x["p"]
        take = F.abs(over) < F.abs(under)
        return F.struct(F.when(take, over).otherwise(under).alias("off"), F.concat(acc["taken"], F.when(take, F.array(x["key"])).otherwise(F.array().cast("array<bigint>"))).alias("taken"))

    start = F.struct(F.lit(0.0).alias("off"), F.array().cast("array<bigint>").alias("taken"))
    gathered = left.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct("words", "id", "key", "p")), asc=False).alias("xs"))
    return gathered.select(F.explode(F.aggregate("xs", start, step)["taken"]).alias("__chosen"))


def numbered(sized: DataFrame) -> DataFrame:
    """(__key, __number): rows whose __id is another row's too, numbered from 0 within each __id, without bringing an id's rows together.

    Upper bits of a key are the partition it was made in; each partition numbers its own rows and starts after the rows of
    those before it.
    """
    again = sized.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id")
    part = F.shiftright("__key", 33)
    rows = sized.select("__id", "__key", part.alias("part")).join(again, "__id", "left_semi")
    counts = rows.groupBy("__id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__id", "part", before.alias("start"))
    own = rows.withColumn("n", F.row_number().over(Window.partitionBy("__id", "part").orderBy("__key")) - 1)
    return own.join(starts, ["__id", "part"]).select("__key", (F.col("start") + F.col("n")).cast("long").alias("__number"))


def copies_of(df: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 20260101, fan_in: int = 48) -> DataFrame:
    """Columns `keep` and __source, __size, __source_size, __target and __copies (0 to `most`) for every row."""
    sized = materialise(df.select(F.monotonically_increasing_id().alias("__key"), *keep, F.xxhash64(F.lit(seed), doc_id, F.struct(F.col(source), F.xxhash64(text))).alias("__id"), F.col(source).alias("__source"), word_count(text).alias("__size")), "mix-sized")
    alike = materialise(numbered(sized), "mix-alike")
    many = alike.count()
    if many:
        numbers = alike.select(F.col("__key").alias("__k"), "__number")
        sized = sized.join(F.broadcast(numbers) if many <= BROADCAST_KEYS else numbers, F.col("__key") == F.col("__k"), "left").drop("__k")
        sized = sized.withColumn("__id", F.when(F.col("__number") > 0, F.xxhash64("__id", "__number")).otherwise(F.col("__id"))).drop("__number")
    narrow = sized.select(F.col("__source").alias("source"), F.col("__size").alias("size"))
    counted = narrow.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("__docs"))
    targets = source_targets(narrow, weights, most).join(counted, F.col("source").eqNullSafe(F.col("__s"))).drop("source")
    number = F.row_number().over(Window.orderBy(F.col("__s").asc_nulls_last())).cast("long")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    targets = materialise(targets.select("__s", "source_size", "target", "__docs", number.alias("source_no"), rate.alias("__rate")), "mix-targets")
    n_sources, biggest = targets.agg(F.count("*"), F.max("__docs")).first()
    # One row for each source: broadcast if that is known to be small, else a join whose hot keys the engine splits.
    small = F.broadcast if n_sources <= 100_000 else (lambda x: x)
    rated = sized.join(small(targets), F.col("__source").eqNullSafe(F.col("__s")))

    whole = F.floor(F.col("__rate"))
    rows = rated.where((F.col("__size") > 0) & (F.col("__rate") > whole)).select("source_no", F.floor(F.log2(F.col("__size"))).alias("size_class"), F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__size").alias("words"), (F.col("__rate") - whole).alias("p"), "__docs")
    chosen, level = None, 0
    while True:
        group = F.pmod(F.xxhash64(F.lit(level), "id"), F.ceil(F.col("__docs") / float(fan_in ** (level + 1))))
        out = materialise(_round_groups(rows.withColumn("group", group), level, seed), f"mix-{level}")
        decided = out.select(F.explode("decided").alias("d")).where("d.p > 0.5").select(F.col("d.key").alias("__chosen"))
        chosen = decided if chosen is None else chosen.unionByName(decided)
        left = out.where("left is not null").select("source_no", "size_class", "left.*")
        if fan_in ** (level + 1) >= (biggest or 0):
            break
        level += 1
        rows = left.join(small(targets.select(F.col("source_no").alias("__n"), "__docs")), F.col("source_no") == F.col("__n")).drop("__n")
    chosen = chosen.unionByName(_last_draws(left))
    chosen = materialise(chosen, "mix-chosen")
    few = F.broadcast if chosen.count() <= BROADCAST_KEYS else (lambda x: x)
    copies = F.when(F.col("__size") > 0, whole.cast("int") + F.col("__chosen").isNotNull().cast("int")).otherwise(F.lit(1))
    final = rated.join(few(chosen), F.col("__key") == F.col("__chosen"), "left")
    return final.select(*keep, "__source", "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies"))


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size) for every row."""
    found = copies_of(df, [doc_id], text, doc_id, **options)
    named = found.select(doc_id, *[F.col(f"__{c}").alias(c) for c in ("source", "size", "source_size", "target", "copies")])
    return named.withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mixed_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix with all columns of df, each as often as it is taken."""
    found = copies_of(df, df.columns, text, doc_id, **options)
    return found.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*df.columns)
