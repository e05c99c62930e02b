"""What both jobs need: configs, logged reads, and a session for the command line alone."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("phenoloom.jobs")


def read_config(name: str) -> dict:
    """The config of a job by its name, or any JSON file by its path; a file of the machine that starts the job."""
    path = name if name.endswith(".json") else os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")
    with open(path) as file:
        return json.load(file)


def read_table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    path = f"{tables}/{name}.parquet"
    LOG.info("reads %s", path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at the path."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def main(run: Callable, name: str, **paths: str) -> None:
    """Command line: the tables' folder, the paths of `paths` with their help, and another config file."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("tables", help="folder that holds the tables as NAME.parquet")
    for path, text in paths.items():
        parser.add_argument(path, help=text)
    parser.add_argument("--config", default=name)
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, given.tables, *[getattr(given, path) for path in paths], read_config(given.config))
    finally:
        spark.stop()
