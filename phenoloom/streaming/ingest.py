"""Blocks that arrive as files: scanned as they come; adjusted p values need the whole table and are batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import qc
from ..operators.scan import Basis, scan


def marker_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_stream(markers: DataFrame, basis: Basis, low_maf: float, out: str, checkpoint: str, ploidy: int = 2) -> StreamingQuery:
    """Frequency filter and scan of every new block; results go to Parquet exactly once by the checkpoint."""
    found = scan(qc.maf_filter(markers, ploidy, low_maf), basis)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
