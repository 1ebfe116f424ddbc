"""What jobs share: settings, logging, and reading and writing of partitioned tables."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(name: str, given: str | None = None) -> dict:
    """Settings of a job: those beside it, and over them those of a JSON file that the caller gives; unknown names are errors."""
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        known = json.load(f)
    if given:
        with open(given, encoding="utf-8") as f:
            more = json.load(f)
        if wrong := sorted(set(more) - set(known)):
            raise ValueError(f"{given}: unknown settings {', '.join(wrong)}; known are {', '.join(sorted(known))}")
        known |= more
    return known


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a job writes; without rows where it has not been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_partitions(df: DataFrame, path: str, by: list[str], log: logging.Logger, rows_a_file: int, unpack: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Replace the partitions that ``df`` has rows of, and no others.

    Rows are dealt out by partition; Spark splits a partition that holds far more than
    others over several tasks, so one with a third of all rows is no bottleneck.
    ``unpack`` makes the rows to be written of those that are dealt out, where they are.
    """
    unpack(df.hint("rebalance", *by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)
    log.info("wrote partitions by %s to %s", ", ".join(by), path)


def main(run: Callable[[SparkSession], object], name: str) -> int:
    """Run a job in a session of its own, which ends with it."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark)
    finally:
        spark.stop()
    return 0


def numbers(df: DataFrame, *columns: F.Column) -> dict:
    """Some aggregates of a table, for a log."""
    return df.agg(*columns).first().asDict()
