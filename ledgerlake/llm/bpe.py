"""BPE encoding and decoding by tree concatenation.

Texts up to `long_chars` are encoded where they lie.  A longer text is cut into segments, which are
dealt to tasks of their own and encoded in parallel; neighbours are then joined pairwise, level by
level.  A segment ends before a space that a non-space follows where there is one (the splitter
always starts a match there, so ids just concatenate).  Text without such a place is cut anywhere,
and that join re-encodes a window of tokens around the cut.  The window grows until its encoding
agrees with both sides over AGREE bytes at either end.  This is exact: a BPE sequence is right if
every two neighbouring tokens are what their joined text encodes to, and each such pair lies inside
the left part, the window or the right part; the splitter looks no further than AGREE bytes.

Defined cases: a null text is the empty text and has no tokens; a text that names a special token
is encoded whole by the library; rows with equal ids are kept apart; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPACE_START, encoder

LONG_CHARS = 65_536
SEGMENT_CHARS = 16_384
AGREE = 32
ROWS_OUT = 256


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, special tokens included."""
    from tokenizers import Tokenizer

    shown = {**{i: chr(i) for i in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    hidden = [i for i in range(256) if i not in shown]
    shown |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    back = {c: b for b, c in shown.items()}
    library = Tokenizer.from_file(path)
    table = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, i in library.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(back[c] for c in token)
    return table


_tables: dict[str, list[bytes]] = {}


def decode(ids: bytes, path: str) -> str:
    if path not in _tables:
        _tables[path] = token_bytes(path)
    return b"".join(map(_tables[path].__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def segments(text: str, size: int) -> list[tuple[str, bool]]:
    """(segment, whether it ends in the midst of unsplit text)."""
    out, at = [], 0
    while len(text) - at > size:
        places = [m.start() for m in SPACE_START.finditer(text, at + size // 2, at + size)]
        end = places[-1] if places and places[-1] > at else at + size
        out.append((text[at:end], not places))
        at = end
    return [*out, (text[at:], False)]


def join(left: list[int], right: list[int], path: str) -> list[int]:
    """The ids of the joined text, for a cut in unsplit text."""
    if path not in _tables:
        _tables[path] = token_bytes(path)
    table, library = _tables[path], encoder(path).library
    reach = 8
    while True:
        a, b = left[-reach:], right[:reach]
        all_left, all_right = len(a) == len(left), len(b) == len(right)
        try:
            window = b"".join(table[i] for i in (*a, *b)).decode("utf-8")
        except UnicodeDecodeError:  # an end lies inside a character
            if all_left and all_right:
                raise
            reach += 1
            continue
        new = library.encode(window, add_special_tokens=False).ids
        same = next((i for i, (x, y) in enumerate(zip(a, new)) if x != y), min(len(a), len(new)))
        tail = next((i for i, (x, y) in enumerate(zip(reversed(b), reversed(new))) if x != y), min(len(b), len(new)))
        left_agrees = all_left or sum(len(table[i]) for i in a[:same]) >= AGREE
        right_agrees = all_right or sum(len(table[i]) for i in b[len(b) - tail :]) >= AGREE
        if left_agrees and right_agrees and (all_left or all_right or same + tail <= len(new)):
            return [*left[: len(left) - len(a)], *new, *right[len(b) :]]
        reach *= 2


def join_tree(parts: list[list[int]], hard: list[bool], path: str) -> list[int]:
    """hard[i]: the cut after part i lies in unsplit text."""
    while len(parts) > 1:
        joined = [join(parts[i], parts[i + 1], path) if hard[i] else parts[i] + parts[i + 1] for i in range(0, len(parts) - 1, 2)]
        odd = len(parts) % 2
        parts, hard = joined + parts[-1:] * odd, hard[1::2] + hard[-1:] * odd
    return parts[0] if parts else []


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """key, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string."""
    kind = dict(docs.dtypes)[key]
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    result = "n_tokens long, ids binary, decoded string"

    def finished(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decode(x, path) for x in ids], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                some = batch.slice(i, ROWS_OUT)
                yield finished(some.column("id"), encoder(path).encode(some.column("text").to_pylist()))

    def cut_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, row, text in zip(pdf["id"], pdf["row"], pdf["text"], strict=True):
                enc = encoder(path)
                parts = [(text, False)] if any(s in text for s in enc.special) else segments(text, segment_chars)
                yield pd.DataFrame({"id": [i] * len(parts), "row": row, "n": range(len(parts)), "hard": [h for _, h in parts], "text": [t for t, _ in parts]})

    def encode_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ids=encoder(path).encode(pdf["text"].tolist())).drop(columns="text")

    def join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        ids = join_tree([np.frombuffer(x, dtype="<u4").tolist() for x in pdf["ids"]], pdf["hard"].tolist(), path)
        packed = np.asarray(ids, dtype="<u4").tobytes()
        return pd.DataFrame({"id": pdf["id"].iloc[:1].tolist(), "n_tokens": [len(ids)], "ids": [packed], "decoded": [decode(packed, path)]})

    short = whole.filter(F.char_length("text") <= long_chars).mapInArrow(encode_short, f"id {kind}, {result}")
    # ids travel as text where pandas would turn a null into a float
    long = whole.filter(F.char_length("text") > long_chars).withColumns({"id": F.col("id").cast("string"), "row": F.monotonically_increasing_id()})
    parts = long.mapInPandas(cut_long, "id string, row long, n int, hard boolean, text string").repartition("row", "n")
    ids = parts.mapInPandas(encode_part, "id string, row long, n int, hard boolean, ids binary")
    joined = ids.groupBy("row").applyInPandas(join_parts, f"id string, {result}").withColumn("id", F.col("id").cast(kind))
    return short.unionByName(joined).withColumnRenamed("id", key)
