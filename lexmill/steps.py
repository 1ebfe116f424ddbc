"""Steps that are computed once: results that several plans read, kept in a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it names none, one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexmill-steps").rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and read it from there, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
