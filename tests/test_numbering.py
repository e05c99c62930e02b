"""Numbers by range partitions against row_number(), with hot groups, ties, nulls and empty tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from phenoloom.operators import numbering, qc, testing


@pytest.fixture(scope="module")
def skewed(spark):
    """90 % of rows on chromosome 1, a null chromosome among the others, positions in no order."""
    n = F.col("id")
    chr_ = F.when(n % 10 != 0, 1).when(n % 20 == 0, None).otherwise((n / 10 % 4 + 2).cast("int"))
    return spark.range(0, 20_000, 1, 6).select(n.alias("mid"), chr_.cast("int").alias("chr"), (n * 7919 % 20_011).alias("pos"), F.lit("x").alias("number"))


def test_equals_row_number(spark, skewed):
    got = numbering.numbered(skewed, [F.asc("pos")], "k", ["chr"], "n")
    w = Window.partitionBy("chr")
    want = skewed.select("*", F.row_number().over(w.orderBy("pos")).cast("bigint").alias("k"), F.count("*").over(w).alias("n"))
    assert got.columns == ["mid", "chr", "pos", "number", "k", "n"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_whole_table_descending_with_nulls(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, None), (3, 3.0), (4, 9.0), (5, float("nan")), (6, -1.0)], "id int, x double")
    got = numbering.numbered(rows, [F.desc_nulls_last("x"), F.asc("id")], "k").orderBy("k")
    assert [r["id"] for r in got.collect()] == [5, 4, 1, 3, 6, 2]


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "chr int, pos bigint")
    assert numbering.numbered(empty, [F.asc("pos")], "k", ["chr"]).collect() == []
    one = spark.createDataFrame([(None, None)], "chr int, pos bigint")
    assert [r["k"] for r in numbering.numbered(one, [F.asc("pos")], "k", ["chr"]).collect()] == [1]


def test_repeated_rows_get_numbers_apart(spark):
    rows = spark.createDataFrame([(1, 5)] * 7, "chr int, pos int")
    assert sorted(r["k"] for r in numbering.numbered(rows, [F.asc("pos")], "k", ["chr"]).collect()) == list(range(1, 8))


def test_no_task_holds_the_hot_group(spark, skewed):
    """The range exchange spreads the chromosome that has 90 % of the rows: no range has twice the median."""
    placed = skewed.repartitionByRange(8, F.asc_nulls_first("chr"), F.asc("pos"))
    sizes = sorted(r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    for found in (qc.thin_every(skewed, 10, ["chr"], ["pos"]), qc.fixed_blocks(skewed, 100), qc.global_index(skewed.na.fill(0), tie="mid"), testing.sequence_rank(skewed, [F.col("chr"), F.asc("pos")], "r")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "row_number()" not in plan


def test_users_of_numbers(spark, skewed):
    w = Window.partitionBy("chr").orderBy("pos")
    i = F.row_number().over(w) - 1
    want = skewed.withColumn("i", i)
    assert qc.thin_every(skewed, 10, ["chr"], ["pos"]).exceptAll(want.where("i % 10 = 0").drop("i")).isEmpty()
    blocks = qc.fixed_blocks(skewed, 100).select("mid", "local_row", "block")
    assert blocks.exceptAll(want.select("mid", F.col("i").cast("bigint"), F.floor(F.col("i") / 100).cast("bigint"))).isEmpty()
    filled = skewed.na.fill(0)
    whole = filled.select("mid", (F.row_number().over(Window.orderBy("chr", "pos", "mid")) - 1).cast("bigint").alias("g"))
    assert qc.global_index(filled, tie="mid").select("mid", "global_idx").exceptAll(whole).isEmpty()
    ranks = testing.sequence_rank(filled, [F.col("chr"), F.asc("pos")], "r").select("mid", "r")
    assert ranks.exceptAll(filled.select("mid", F.row_number().over(Window.orderBy(F.desc("chr"), "pos")).cast("bigint"))).isEmpty()
