"""Results that are used more than once: computed once and written where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where stored tables stand, until discard() removes them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting, as in tests, uses a temporary one; a
    cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phenoloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str = "result") -> DataFrame:
    """df as a table in the shared folder; lineage ends there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def path_of(table: DataFrame) -> str | None:
    return _paths.get(table)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    from .sinks import remove

    for table in tables:
        path = _paths.pop(table, None)
        if path:
            remove(table.sparkSession, path)
