"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

Directory: rows are counted by 64-bit hash, and from the counts the directory starts at depth 0 and
doubles while a bucket holds more hashes than its capacity; only overfull buckets split, so buckets
have local depths.

Insert: every row's hash prefix gives its directory slot and the slot its bucket.  Rows go to owner
tasks by range of hash (the first OWNER_BITS bits), where texts of one hash are compared byte by byte
and chained; keep_id and group_size are the entry's.  Hashes that hold a large share of the rows, of
which there can be HEAVY_SHARE at most, are aggregated in their tasks first, so that one entry of
each task moves.  Entries are written to the folder that driver and executors share.

Probe: a row finds its bucket through the directory, and (bucket, hash, digest) its entry in the
chain; no two entries share a digest, which is checked.  Entries that hold a large share of the rows
are dealt over many tasks.

Defined cases: null and empty texts are equal; of equal texts the largest doc_id stays (nulls only
if there is nothing else); rows that repeat a doc_id and its text are one record and share `kept`;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, spread_join, stored

# The directory has at most 2**MAX_DEPTH slots, which bounds its broadcast (1 MB).
MAX_DEPTH = 16
# An owner's range of keys is 2**-OWNER_BITS of all hashes; AQE merges small ranges into one task.
OWNER_BITS = 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  Texts without other upper-case letters take the built-in's fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    simple = ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).when(simple, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


@dataclass
class ExtendibleIndex:
    """entries: bucket, h, digest, chain_pos, keep_id, group_size; directory: slot, bucket, local_depth."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    total: int
    hash_bits: int

    def slot(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.depth) if self.depth else F.lit(0).cast("long")


def _keyed(docs: DataFrame, key: str, text: str, hash_bits: int) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    h = F.xxhash64("norm")
    if hash_bits < 64:
        h = F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)
    return docs.select(F.col(key).alias("id"), norm.alias("norm")).withColumn("h", h)


def double_directory(cells: DataFrame, capacity: int) -> DataFrame:
    """Buckets from loads of the deepest prefixes (cell, n): prefixes that fit while their parent does not."""
    prefixes = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH)))).select("d", F.expr(f"shiftright(cell, {MAX_DEPTH} - d)").alias("p"), "n")
    loads = prefixes.groupBy("d", "p").agg(F.sum("n").alias("n"))
    overfull = loads.filter((F.col("n") > capacity) & (F.col("d") < MAX_DEPTH)).select((F.col("d") + 1).alias("d"), F.col("p").alias("parent"))
    children = overfull.select("d", F.explode(F.array(F.col("parent") * 2, F.col("parent") * 2 + 1)).alias("p"))
    root = cells.sparkSession.range(1).select(F.lit(0).alias("d"), F.lit(0).cast("long").alias("p"))
    split = overfull.select((F.col("d") - 1).alias("d"), F.col("parent").alias("p"))
    both = root.unionByName(children).withColumn("split", F.lit(False)).unionByName(split.withColumn("split", F.lit(True)))
    return both.groupBy("d", "p").agg(F.bool_or("split").alias("split")).filter(~F.col("split")).select("d", "p")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 4096, hash_bits: int = 64) -> ExtendibleIndex:
    keyed = _keyed(docs, key, text, hash_bits)
    hashes = stored(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "dedup-hashes")
    n, total = hashes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # Texts beyond 2**13 bucketfuls make the buckets larger, so that the directory stays within its bound.
    capacity = max(capacity, -(-n // 2 ** (MAX_DEPTH - 3)))
    cells = hashes.groupBy(F.shiftrightunsigned("h", 64 - MAX_DEPTH).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    buckets = stored(double_directory(cells, capacity), "dedup-buckets")
    depth = buckets.agg(F.max("d")).first()[0]
    span = F.expr(f"shiftleft(cast(1 as bigint), {depth} - d)")
    directory = buckets.select(F.explode(F.sequence(F.col("p") * span, (F.col("p") + 1) * span - 1)).alias("slot"), (F.col("p") * span).alias("bucket"), F.col("d").alias("local_depth"))
    index = ExtendibleIndex(hashes, directory, depth, total, hash_bits)

    heavy = F.broadcast(hashes.filter(F.col("rows") * HEAVY_SHARE >= max(total, HEAVY_SHARE * 64)).select("h"))
    entry = F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    single = keyed.select("h", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    moved = single.join(heavy, "h", "left_anti").unionByName(single.join(heavy, "h", "left_semi").groupBy("h", "norm").agg(*entry))
    placed = moved.withColumn("slot", index.slot(F.col("h"))).join(F.broadcast(directory.select("slot", "bucket")), "slot").drop("slot")
    # one shuffle: comparing and chaining keep the owner's partitioning
    owned = placed.withColumn("owner", F.shiftrightunsigned("h", 64 - OWNER_BITS)).repartition("owner")
    compared = owned.groupBy("owner", "bucket", "h", "norm").agg(*entry).withColumn("digest", F.sha2("norm", 256)).drop("norm")
    chained = compared.selectExpr("*", "row_number() over (partition by owner, bucket, h order by digest) - 1 as chain_pos", "count(*) over (partition by owner, bucket, h, digest) as twins")
    index.entries = stored(chained.drop("owner"), "dedup-index")
    if index.entries.filter("twins > 1").limit(1).count():
        raise ValueError("one digest names texts of different bytes")
    return index


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256, bucket, chain_pos."""
    index = build_index(docs, key, text, **options)
    rows = _keyed(docs, key, text, index.hash_bits).select("id", "h", F.sha2("norm", 256).alias("digest"))
    rows = rows.withColumn("slot", index.slot(F.col("h"))).join(F.broadcast(index.directory.select("slot", "bucket")), "slot").drop("slot")
    entries = index.entries.select("bucket", "h", "digest", "chain_pos", "keep_id", "group_size")
    joined = spread_join(rows, entries, ["bucket", "h", "digest"], "group_size", index.total, F.col("id"))
    return joined.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "bucket", "chain_pos")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, columns as they were."""
    index = build_index(docs, key, text, **options)
    stays = index.entries.select("keep_id", "digest")
    digest = F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))), 256)
    return docs.join(stays, docs[key].eqNullSafe(stays["keep_id"]) & (digest == stays["digest"]), "left_semi")
