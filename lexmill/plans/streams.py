"""Bounded runs of streaming queries, for tables that are read as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..steps import shared_folder


def read_stream(spark: SparkSession, path: str, files_at_a_time: int | None = 4, **options: object) -> DataFrame:
    """A table's files as a stream; the table is a folder or a file.  More options go to the reader, such as ``maxBytesPerTrigger`` in place of a number of files (None)."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads a single file only if it is asked for by a pattern
    most = {} if files_at_a_time is None else {"maxFilesPerTrigger": files_at_a_time}
    return spark.readStream.schema(schema).options(**most, **options).parquet(pattern)


def new_folder(spark: SparkSession) -> str:
    """A folder for a stream's state and output."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run over all that is there, in micro-batches, and read what was written.  With the ``folder`` of an earlier run, go on from there."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: The state store that stateful processors ask for.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_timed(stream: DataFrame) -> DataFrame:
    """As run_available(), with the state store that stateful processors need; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER[0])
    conf.set(*_PROVIDER)
    try:
        return run_available(stream)
    finally:
        conf.set(_PROVIDER[0], before)
