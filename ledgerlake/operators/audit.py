"""Hash-chained audit logs: append, parallel verification, export, retention."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import big_endian
from ..functions.session import serial

GENESIS = bytes(32)
BODY = ["occurred_at", "event_type", "actor_id", "resource_type", "resource_id", "payload"]


def entry_body(nanos: Column) -> Column:
    """The bytes of an entry behind its number and the hash before it."""
    text = [F.coalesce(F.col(c), F.lit("")).cast("binary") for c in BODY[1:]]
    return F.concat(big_endian(nanos), *text)


def _nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def self_hash(seq: Column, prev: Column, body: Column) -> Column:
    """Binary SHA-256 of number, previous hash and body."""
    return F.unhex(F.sha2(F.concat(big_endian(seq), prev, body), 256))


def append_audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    """log with the entries chained behind each chain_key's last row, in the order of occurred_at and entry_id.

    A chain is serial, so it is folded in one task, batch by batch with the last hash carried on, in memory that does not grow
    with it; spread events over many keys.  Entries without a key are one chain, which has no earlier rows.
    """
    heads = log.groupBy("chain_key").agg(F.max_by(F.struct("seq", "self_hash"), "seq").alias("head"))
    bodies = entries.withColumn("__body", entry_body(_nanos(F.col("occurred_at")))).join(heads, "chain_key", "left")
    ready = bodies.select("chain_key", "entry_id", *BODY, "__body", F.coalesce(F.col("head.seq"), F.lit(0)).alias("__seq"), F.coalesce(F.col("head.self_hash"), F.lit(GENESIS)).alias("__prev"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, seq, prev = None, 0, GENESIS
        for pdf in batches:
            seqs, prevs, selves = [], [], []
            for key, body, head_seq, head_hash in zip(pdf["__key"], pdf["__body"], pdf["__seq"], pdf["__prev"], strict=True):
                if key != chain:
                    chain, seq, prev = key, int(head_seq), bytes(head_hash)
                seq += 1
                own = hashlib.sha256(seq.to_bytes(8, "big") + prev + bytes(body)).digest()
                seqs.append(seq), prevs.append(prev), selves.append(own)
                prev = own
            yield pdf.assign(seq=seqs, prev_hash=prevs, self_hash=selves)[["chain_key", "seq", "prev_hash", "self_hash", *BODY]]

    kinds = dict(entries.dtypes)
    schema = f"chain_key {kinds['chain_key']}, seq long, prev_hash binary, self_hash binary, " + ", ".join(f"{c} {kinds[c]}" for c in BODY)
    new = serial(ready, "chain_key", "occurred_at", "entry_id").mapInPandas(fold, schema)
    return log.select(*new.columns).unionByName(new)


def verify_audit(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """chain_key, scanned, first_bad, gap of each chain in parallel: every hash is made anew from the stored one before it, found by an equi-join on (chain, seq - 1)."""
    ranged = log
    if low is not None:
        ranged = ranged.filter(F.col("seq") >= low)
    if high is not None:
        ranged = ranged.filter(F.col("seq") <= high)
    before = log.select("chain_key", (F.col("seq") + 1).alias("seq"), F.col("self_hash").alias("before"))
    both = ranged.join(before, ["chain_key", "seq"], "left")
    first = F.col("seq") == 1
    prev = F.when(first, F.lit(GENESIS)).otherwise(F.col("before"))
    gap = ~first & F.col("before").isNull()
    bad = gap | (F.col("self_hash") != self_hash(F.col("seq"), prev, entry_body(_nanos(F.col("occurred_at")))))
    return both.groupBy("chain_key").agg(F.count(F.lit(1)).alias("scanned"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"), F.bool_or(gap).alias("gap"))


def export_audit(log: DataFrame, start: Column, end: Column, path: str, fmt: str = "json") -> DataFrame:
    """Writes the rows of the closed range in order of seq, hashes in hexadecimal, as JSON lines or CSV; returns what was exported."""
    rows = log.filter(F.col("occurred_at").between(start, end)).withColumns({"prev_hash": F.lower(F.hex("prev_hash")), "self_hash": F.lower(F.hex("self_hash"))}).orderBy("chain_key", "seq")
    writer = rows.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))
    return rows.agg(F.lit("audit.exported").alias("event_type"), F.count(F.lit(1)).alias("rows"))


def with_expiry(log: DataFrame, default_days: int | None, per_type: dict[str, int | None]) -> DataFrame:
    """log with expires_at: occurred_at plus the type's days, else the default; 0 or none never expires."""
    days = F.lit(default_days).cast("int")
    for kind, n in per_type.items():
        days = F.when(F.col("event_type") == kind, F.lit(n).cast("int")).otherwise(days)
    return log.withColumn("expires_at", F.when(days > 0, F.timestamp_add("DAY", days, F.col("occurred_at"))))


def purge(log: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, purged)"""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return log.filter(~gone), log.filter(gone)
