"""Quality rules by the frequency of lines across documents, next to a text's own figures.

One pass over the texts takes each document's figures and a 64-bit hash of each of its lines that holds a
word, normalised: A-Z in lower case, words joined by single spaces.  Spark counts in how many distinct documents of a host a line is
found; texts that are equal byte for byte count as one document, since copies say nothing about a line.  A line of more than
`most_docs` documents and of more than `most_share` of its host's is taken out of every document of that
host.  A document that keeps less than `least_left` of its words is depleted and rejected, as is one
whose own figures fail: too few words, or too many in repeated windows.

Counting pre-aggregates in the tasks, so a line that most documents hold is one row a task; common lines
meet the documents by a broadcast up to FEW_LINES of them, and by a join that deals hot lines over many tasks beyond.

Defined cases: null texts are empty and fail; null hosts are one host of their own; lines without words are
neither counted nor removed; a document that loses nothing isn't depleted; rows that repeat an id are told
apart; an empty table gives no rows; other columns stay in `without_frequent_lines` and are left out of `line_verdicts`.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

MOST_DOCS, MOST_SHARE, LEAST_LEFT = 10, 0.05, 0.5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words, and percent of words in repeated windows
WINDOW = 5
FEW_LINES = 200_000

CONTINUES, SPACE, SYMBOL, OTHER = range(4)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = CONTINUES
_CLASS[list(b" \t\n\v\f\r")] = SPACE
_CLASS[list(b"#*$%&|<>")] = SYMBOL


# ---- one text ------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that are found twice or more.  Hashes find the windows that may be equal, and the words decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h, each = np.zeros(n, dtype=np.uint64), np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    maybe = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    found = defaultdict(list)
    for at in maybe.tolist():
        found[tuple(words[at : at + window])].append(at)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for places in found.values():
        if len(places) > 1:
            np.add.at(steps, places, 1)
            np.add.at(steps, np.asarray(places) + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def figures(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of the lines with words: numbers, hashes, words."""
    import xxhash

    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=4)
    numbers, hashes, sizes, seen = [], [], [], set()
    for i, line in enumerate(text.split(b"\n")):
        words = line.lower().split()  # bytes: A-Z alone change, and only the six ASCII spaces part words
        if words:
            numbers.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
            sizes.append(len(words))
            seen.add(line)
    return sum(sizes), int(kinds[SYMBOL] + kinds[OTHER]), int(kinds[SYMBOL]), len(numbers) - len(seen), repeated_words(text.split()), numbers, np.asarray(hashes, dtype=np.uint64).view(np.int64), sizes


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, numbers array<int>, lines array<long>, sizes array<int>"


def _figures(texts: pa.Array) -> pa.Array:
    rows = [figures(t) for t in texts.to_pylist()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.StructArray.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds, strict=True)], names=re.findall(r"(\w+) \w+(?:<\w+>)?", FIGURES))


# ---- all texts -----------------------------------------------------------------------------------------


def described(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The columns of docs but the text, as `doc`, with host, text_hash and figures of each row."""
    measure = F.arrow_udf(_figures, FIGURES)
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("doc"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), F.xxhash64(whole).alias("text_hash"), whole.alias("bytes"))
    return rows.withColumn("f", measure("bytes")).select("doc", "host", "no_host", "text_hash", "f.*")


HOST = ["host", "no_host"]


def common_lines(rows: DataFrame, most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE) -> DataFrame:
    """host, no_host, line, n_docs, rows (of documents) of the lines above the limits; rows: host, no_host, text_hash, lines."""
    found = rows.select(*HOST, "text_hash", F.explode(F.array_distinct("lines")).alias("line"))
    by_line = found.groupBy(*HOST, "line").agg(F.count_distinct("text_hash").alias("n_docs"), F.count(F.lit(1)).alias("rows")).filter(F.col("n_docs") > most_docs)
    by_host = rows.groupBy(*HOST).agg(F.count_distinct("text_hash").alias("host_docs"), F.count(F.lit(1)).alias("host_rows"))
    frequent = stored(by_line, "frequent-lines")
    both = spread_join(frequent, by_host, HOST, "host_rows", frequent.count(), F.col("line"))
    return both.filter(F.col("n_docs") > F.lit(most_share) * F.col("host_docs")).select(*HOST, "line", "n_docs", "rows")


def line_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT, few_lines: int = FEW_LINES) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed (numbers of the lines that go, from 0), words_left, kept."""
    rows = _judged(docs.select(F.col(key).alias("id"), F.col(host).alias("source"), F.col(text).alias("text")), most_docs, most_share, least_left, few_lines)
    return rows.select(F.col("doc.id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "words_left", "kept")


def without_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT, few_lines: int = FEW_LINES) -> DataFrame:
    """The documents that are kept, columns as they were, without the lines above the limits."""
    named = docs.select(F.struct(*docs.columns).alias("whole"))
    inner = named.select(F.col("whole").alias("id"), F.col(f"whole.{host}").alias("source"), F.col(f"whole.{text}").alias("text"))
    rows = _judged(inner, most_docs, most_share, least_left, few_lines).filter("kept")
    left = F.array_join(F.filter(F.split(F.col(f"doc.id.{text}"), "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return rows.select(*((F.when(F.size("removed") > 0, left).otherwise(F.col(f"doc.id.{text}")) if c == text else F.col(f"doc.id.{c}")).alias(c) for c in docs.columns))


def _judged(docs: DataFrame, most_docs: int, most_share: float, least_left: float, few_lines: int) -> DataFrame:
    rows = stored(described(docs).withColumn("row", F.monotonically_increasing_id()), "lines-of-documents")
    common = stored(common_lines(rows, most_docs, most_share), "common-lines")
    lines = rows.select("row", *HOST, F.explode(F.arrays_zip("numbers", "lines", "sizes")).alias("l")).select("row", *HOST, "l.numbers", F.col("l.lines").alias("line"), "l.sizes")
    if common.count() <= few_lines:
        hits = lines.join(F.broadcast(common.select(*HOST, "line")), [*HOST, "line"])
    else:
        hits = spread_join(lines, common.select(*HOST, "line", "rows"), [*HOST, "line"], "rows", lines.count(), F.col("row"))
    gone = hits.groupBy("row").agg(F.array_sort(F.collect_list("numbers")).alias("removed"), F.sum("sizes").alias("words_gone"))
    judged = rows.drop("numbers", "lines", "sizes").join(gone, "row", "left")
    judged = judged.withColumns({"removed": F.coalesce("removed", F.array().cast("array<int>")), "words_left": F.col("n_words") - F.coalesce("words_gone", F.lit(0).cast("long")), "base_failed": base_failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.lit(least_left) * F.col("n_words")))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
