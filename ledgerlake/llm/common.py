"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import ship, stored  # noqa: F401  (operators take it from here)

# A key is heavy when it holds at least 1/HEAVY_SHARE of all rows, so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 4096
HEAVY_SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_text(key: str = "doc_id") -> Column:
    return F.col(key).cast("string")


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the rows that no label may be learned from; null keys count as the empty text."""
    return (F.crc32(F.coalesce(key_text(key), F.lit("")).cast("binary")) % 5) == 0


def spread_join(rows: DataFrame, entries: DataFrame, keys: list[str], size: str, total: int, spread_by: Column, how: str = "inner") -> DataFrame:
    """rows join entries on keys, where entries has one row a key and its row count in `size`.

    A key with 1/HEAVY_SHARE of the total or more is dealt over HEAVY_SALTS partitions by a hash of
    `spread_by`, its entry repeated for each.  There are at most HEAVY_SHARE such keys, which bounds
    what is broadcast; no other key has more than that share of the rows.
    """
    heavy = entries.filter(F.col(size) * HEAVY_SHARE >= max(total, HEAVY_SHARE * 64)).select(*keys, F.lit(True).alias("__heavy"))
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread_by), F.lit(HEAVY_SALTS))).otherwise(F.lit(0).cast("long"))).drop("__heavy")
    is_heavy = F.col(size) * HEAVY_SHARE >= max(total, HEAVY_SHARE * 64)
    repeated = entries.withColumn("__salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0).cast("long"), F.lit(HEAVY_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
