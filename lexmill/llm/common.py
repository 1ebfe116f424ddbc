"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's settings within a step: the shuffle files of an execution go when it ends, and batches for Python workers have few rows and bytes, so that long texts don't fill memory on either side.
_IN_A_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: Python workers outlive their tasks.  These let them give large arrays back to the system at once, Arrow's too; numpy steps take some more CPU time with them.
_WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def frugal_workers(spark: SparkSession) -> None:
    """Start the Python workers of functions planned from now on with _WORKERS; what is set already holds."""
    for k, v in _WORKERS.items():
        spark.sparkContext.environment.setdefault(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """What is executed in here leaves no shuffle files behind, as nothing reads them again."""
    before = {k: spark.conf.get(k) for k in _IN_A_STEP}
    for k, v in _IN_A_STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it names none, one in the warehouse.

    Both are shared, so what is written there outlives the executors that wrote it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexmill-checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, by a checkpoint in the shared folder."""
    _folder(df.sparkSession)
    with step(df.sparkSession):
        return df.select("*").checkpoint()  # planned in here, so that the setting holds


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    with step(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the folders of tables that store() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if path is not None and path.getName().startswith("table-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(doc_id) -> F.Column:
    """crc32 of an id written as text, the rule by which folds are formed."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def parts_for(n: int, per_part: int, least: int = 1) -> int:
    """How many partitions hold ``n`` units at ``per_part`` each."""
    return max(least, -(-int(n) // per_part))


#: A key with more than this share of all rows, and this many, is heavy.  So heavy keys are at most 1 / HEAVY_SHARE.
HEAVY_SHARE, HEAVY_LEAST = 1 / 1000, 100


def spread_join(rows: DataFrame, facts: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key; ``size`` there tells how many of the ``total`` rows have it.

    The facts of heavy keys, at most a thousand, are broadcast, so their rows stay
    where they are.  Only rows of other keys are shuffled.
    """
    limit = F.lit(int(max(HEAVY_LEAST, total * HEAVY_SHARE)))
    heavy = F.broadcast(facts.filter(F.col(size) > limit))
    light = rows.join(heavy.select(on), on, "left_anti").join(facts.filter(F.col(size) <= limit), on, how)
    return rows.join(heavy, on).unionByName(light)


#: Words of 64 bits in a bitmap of hashes, at most: 2^20 rows to broadcast.
BITMAP_WORDS = 1 << 20


def _bitmap_place(h: F.Column, words: int) -> tuple[F.Column, F.Column]:
    return h.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63))


def bitmap(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bitmap of the column ``h`` (some n 64-bit hashes): rows ``word`` and ``bits``, and how many words it may have.

    It has 16 bits for each hash, until it has BITMAP_WORDS words.  With more
    hashes than those are for, more strangers pass; no member is ever missed.
    """
    words = 1 << 10
    while words < min(n // 4, BITMAP_WORDS):
        words *= 2
    word, bit = _bitmap_place(F.col("h"), words)
    marks = hashes.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit as int))")).alias("_bits"))
    return marks, words


def maybe_in(rows: DataFrame, h: F.Column, marks: tuple[DataFrame, int], keep: bool = True) -> DataFrame:
    """The rows whose hash a bitmap may have, or else (not ``keep``) those that it surely lacks."""
    made, words = marks
    word, bit = _bitmap_place(h, words)
    found = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(made), "_word", "left")
    has = F.expr("_bits is not null and (shiftrightunsigned(_bits, cast(_bit as int)) & 1L) = 1L")
    return found.filter(has if keep else ~has).drop("_word", "_bit", "_bits")
