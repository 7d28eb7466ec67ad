"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash u in (0, 1); the row goes to the shard with the largest
ln(u) / weight.  A new shard only takes the rows for which it wins, so no row moves between old
shards.  Slots number a shard's rows without gaps in the order of the key's hash: rows are numbered
within blocks of that order (leading digits of the hash) and blocks are offset by a running count,
so no task sees a whole shard.

Defined cases: a null key hashes as the empty text; a null text has no bytes and the CRC of none;
rows with equal keys share a shard and still have slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_text, stored

HASH_DIGITS = 13  # hexadecimal digits, 52 bits: exact in a double


def unit_hash(key: Column, shard: int) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**HASH_DIGITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard of each key; ties to the smaller shard."""
    scores = [F.struct((F.log(unit_hash(key, s)) / w if len(set(weights)) > 1 else unit_hash(key, s)).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["shard"]


def shard_rows(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, rows_per_block: int = 100_000) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight 1)."""
    weights = weights or [1.0] * n_shards
    whole = F.coalesce(F.col(text), F.lit(""))
    stable = F.coalesce(key_text(key), F.lit(""))
    light = docs.select(
        F.col(key).alias("id"), stable.alias("k"), F.md5(stable.cast("binary")).alias("place"),
        (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    grown = [*weights, 1.0]
    old_new = light.select("*", rendezvous(F.col("k"), weights).alias("shard"))
    new_wins = rendezvous(F.col("k"), grown) if len(set(grown)) > 1 else None
    if new_wins is None:
        # Equal weights: the new shard wins where its hash beats the old winner's.
        won = F.array_max(F.array(*[unit_hash(F.col("k"), s) for s in range(n_shards)]))
        new_wins = F.when(unit_hash(F.col("k"), n_shards) > won, F.lit(n_shards)).otherwise(F.col("shard"))
    rows = stored(old_new.withColumn("grown_shard", new_wins).drop("k"), "shards")
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / n_shards / rows_per_block + 1, 16)) + 1)
    rows = rows.withColumn("block", F.substring("place", 1, digits))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("place", "id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "block"])
    return numbered.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
