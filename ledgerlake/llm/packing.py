"""Packing by power-of-two decomposition.

A document of n tokens (its closing id included) becomes n // max_len pieces of max_len and one
piece for each binary digit of the rest, longest first.  Each piece is a sequence of its own, in the
bucket of its length, so no sequence crosses documents and none is padded.

Defined cases: a null or empty text has the closing id alone; rows that repeat a document are packed
each for itself; an empty table gives no rows; extra columns are left out.  Sequence ids are unique
and follow the input's partitions; offset is always 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CACHE_CHUNKS, encoder

MAX_LENGTH = 2048
CLOSING_ID = 1
ROWS_IN = 256


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, closing_id: int = CLOSING_ID, cached: int = CACHE_CHUNKS) -> DataFrame:
    """One row a piece: key, start, length, bucket (log2 of length), doc_tokens, ids binary, sequence_id, offset.  Fewer cached chunks take less of a worker's memory and more time, with the same result."""
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(whole.dtypes)["id"]
    closing = np.asarray([closing_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_IN):
                some = batch.slice(i, ROWS_IN)
                all_ids = [x + closing for x in encoder(path, cached).encode(some.column("text").to_pylist())]
                lengths = [piece_lengths(len(x) // 4, max_length) for x in all_ids]
                starts = [np.cumsum([0, *p[:-1]]).tolist() for p in lengths]
                rows = np.repeat(np.arange(some.num_rows), [len(p) for p in lengths])
                flat = [n for p in lengths for n in p]
                pieces = [x[4 * a : 4 * (a + n)] for x, s, p in zip(all_ids, starts, lengths, strict=True) for a, n in zip(s, p, strict=True)]
                totals = np.asarray([len(x) // 4 for x in all_ids])[rows]
                columns = [
                    some.column("id").take(pa.array(rows)), pa.array([a for s in starts for a in s], pa.int64()), pa.array(flat, pa.int64()),
                    pa.array([n.bit_length() - 1 for n in flat], pa.int32()), pa.array(totals, pa.int64()), pa.array(pieces, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "bucket", "doc_tokens", "ids"])

    pieces = whole.mapInArrow(cut, f"id {kind}, start long, length long, bucket int, doc_tokens long, ids binary")
    return pieces.select(F.col("id").alias(key), "start", "length", "bucket", "doc_tokens", "ids", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
