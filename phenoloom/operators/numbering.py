"""Row numbers by range partitions: no group and no tied value has to fit into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .joins import small_side

#: Bits of monotonically_increasing_id() that count rows inside a partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], column: str = "number", within: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds 1..n in the order, for each value of the `within` columns anew (nulls are a value); `total` adds the group's rows.

    Rows are dealt to ranges of (within, order), sorted there and written with their place, so a later read finds the same
    places whatever is lost. A range's rows of a group begin at one place; what earlier ranges hold of the group is added.
    These heads are a row for each range and group, windowed by group. Ranges are cut at sampled values of the whole key, so
    a hot group or a tied first column is spread as long as the order tells its rows apart; rows that agree in everything
    stay in one range. Order columns that tie leave the numbers among the tied rows open, as row_number() does.

    Sampling reads df once more: store it first if it is dear. Names that begin with __ are this function's own.
    """
    within = within or []
    keys = [F.asc_nulls_first(k) for k in within]
    placed = stored(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    rows = placed.withColumn("__range", F.shiftright("__place", ROW_BITS).cast("int"))
    heads = rows.groupBy("__range", *within).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*within)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("__n").over(group)
    heads = heads.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(within)], "__first", before.alias("__before"), all_.alias("__total"))
    same = reduce(lambda a, b: a & b, [F.col("__range") == F.col("__r"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(within)]])
    joined = rows.join(small_side(heads), same)
    out = [*df.columns, (F.col("__place") - F.col("__first") + F.col("__before") + 1).alias(column)]
    return joined.select(*out, *([F.col("__total").alias(total)] if total else []))
