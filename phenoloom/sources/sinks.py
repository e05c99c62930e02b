"""Writers: tables by chromosome and block, delimited text, reports, and appends that go on where a run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_markers(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by chr and block, positions sorted inside for row-group pruning. Refuses a path that has data."""
    rows = df.repartition("chr", "block").sortWithinPartitions("chr", "block", "pos")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chr", "block").parquet(path)


def write_text(df: DataFrame, path: str, sep: str = ",", gzip: bool = False, overwrite: bool = False, na: str = "") -> None:
    """Delimited text with a header in every part."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", sep).option("nullValue", na).option("compression", "gzip" if gzip else "none").csv(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_report(values: dict[str, object], spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """(metric, value) rows as text."""
    rows = spark.createDataFrame([(k, str(v)) for k, v in values.items()], "metric string, value string")
    rows.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def append_run(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows of a finished run; rows whose key is there already are left out, so a repeat changes nothing."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
