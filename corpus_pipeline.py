"""Corpus pipeline: five training-data operators one after the other, each on all that the one before kept.

quality classifier -> exact dedup -> near dedup -> PII surrogates -> packing.  Every stage is written
as Parquet and read again, so a lost executor costs a stage at most its running tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.session import ship
from ledgerlake.llm import exact_dedup, near_dedup, packing, pii, quality
from ledgerlake.llm.common import stored, table
from ledgerlake.llm.registry import SURROGATE_KEY, tokenizer_path

# Stages share an executor's Python workers, and a worker keeps the tokenizer's cache while it serves the next ones.
CACHED_CHUNKS = 400_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(quality.described(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the smallest doc_id."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars, where there is such a column, follows the new text."""
    count = "_".join(["entities", *docs.columns])  # no column has this name
    replaced = pii.replace_entities(docs, SURROGATE_KEY, count=count)
    follows = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return replaced.withColumns(follows).select(*docs.columns) if follows else replaced.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, as in op10, with its tokens' checksum."""
    ship(spark)
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cached=CACHED_CHUNKS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("pii", replace_pii), ("packing", pack_sequences)]

# The classifier, the sketches and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
