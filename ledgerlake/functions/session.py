"""The folder that all machines share, and tables written there between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def serial(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with `__key`, text of key that is never null: rows of a key lie in one partition, one behind the other in the given order (nulls last).

    For folds by mapInPandas that carry their state from batch to batch: the sort spills, and no more than a batch is ever in Python.
    """
    named = df.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return named.repartition("__key").sortWithinPartitions("__key", *[F.col(c).asc_nulls_last() for c in order])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver does; on a cluster submit it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="ledgerlake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df computed once, written as a table in the shared folder and read back: loops neither recompute nor grow their plans, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str | Column, rows: int = 250_000) -> DataFrame:
    """df by keys in as many partitions as its rows need, so that what a task holds does not grow with the table; df is counted for that."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
