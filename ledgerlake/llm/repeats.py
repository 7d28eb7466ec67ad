"""Repeated passages by run-length indexes: every byte that a string of `length` bytes covers which also starts anywhere else.

Equal strings of `length` bytes share the smallest hash of the `anchor`-byte windows inside them.  So
the corpus is cut by these minima: each run of string starts with one minimum is a cut, and each
start lies in one cut alone.  A run of more than CUT_STARTS starts (periodic text) is several cuts, so no
cut has more than CUT_STARTS + length bytes.  Passages shorter than `length` are found along with it: minima are then
those of strings of `passage` bytes, and cuts still reach `length` bytes from their last start, so longer
strings stand in them as well.  Strings can only repeat between cuts of one minimum:

* equal cuts are counted (by digest, pre-aggregated where they lie): two of them mean that all of
  their strings repeat;
* cuts of one minimum that differ meet in a group of bounded size, over which a run-length index is
  built (overlapping cuts of one text are put together first, so no place stands in it twice): the Burrows-Wheeler transform kept as its runs, with the text positions at both ends of
  each run as samples.  Matches with the neighbouring suffix are measured at run ends alone; inside
  a run a match follows from the step before, one byte shorter.  So matching statistics stream over
  the text in order, and a start repeats if its longest match has `length` (or `passage`) bytes or more;
* a minimum with more than `most_cuts` different cuts would outgrow a group; its strings are counted
  by their digests, one row for each start.

Digests are 128 bits of BLAKE2.  Results go back to all copies of a cut by a join that deals frequent
cuts over many tasks.

Defined cases: null texts are empty; texts shorter than `length` stay (n_repeated counts from `passage` bytes on); a document that occurs twice
is removed from both; rows that repeat an id are told apart by their text and are each other's
copies; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

LENGTH = 400
PASSAGE = 256  # bytes that 98 % of the runs of 51 words in sf0.1 reach
ANCHOR = 128
PASSAGE_ANCHOR = 48
SEED = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = 1 << 18
MOST_CUTS = 1_000
CUT_STARTS = 4_096


# ---- rolling hashes and minimisers ---------------------------------------------------------------


def window_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every window of `width` bytes."""
    n = len(text) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers = _powers(len(text) + 1)
    with np.errstate(over="ignore"):
        # sum of text[i] * base**i up to each place; a window's hash is its part times base**-start
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[0][: len(text)], dtype=np.uint64)])
        h = (sums[width:] - sums[:-width]) * powers[1][:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


_power_tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_power_tables[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = int(SEED) | 1
        with np.errstate(over="ignore"):
            for j, b in enumerate((base, pow(base, -1, 1 << 64))):
                table = np.ones(size, dtype=np.uint64)
                table[1:] = np.uint64(b)
                _power_tables[j] = np.cumprod(table, dtype=np.uint64)
    return _power_tables


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbouring hashes, in linear time from minima within blocks."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    blocks = np.pad(h, (0, -len(h) % span), constant_values=np.uint64(2**64 - 1)).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


def cut_text(text: bytes, length: int, anchor: int, reach: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(minimum, first start, end, whether the minimum stands there twice) of each cut; its strings are those in text[first:end].

    With a `reach` above `length` the end is that of a string of so many bytes from the last start, or the text's."""
    hashes = window_hashes(np.frombuffer(text, dtype=np.uint8), anchor)
    minima = window_minima(hashes, length - anchor + 1)
    if not len(minima):
        return minima, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []
    first = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
    stop = np.append(first[1:], len(minima))
    parts = -(-(stop - first) // CUT_STARTS)
    if parts.max() > 1:
        run = np.repeat(np.arange(len(first)), parts)
        first, stop = first[run] + (np.arange(len(run)) - (np.cumsum(parts) - parts)[run]) * CUT_STARTS, stop[run]
        stop = np.minimum(stop, first + CUT_STARTS)
    minima, end = minima[first], stop + length - 1
    twice = [np.count_nonzero(hashes[a : b - anchor + 1] == x) > 1 for x, a, b in zip(minima, first.tolist(), end.tolist(), strict=True)]
    return minima, first, np.minimum(stop + max(length, reach) - 1, len(text)), twice


# ---- the run-length index --------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By tripling of ranks (doubling, where three don't fit a key); values are at least 0."""
    n, bits = len(text), int(text.max()).bit_length() + 1
    width = max(1, 62 // bits)
    padded = np.append(text + 1, [0] * width)
    key = padded[:n]
    for i in range(1, width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    rank = np.zeros(n + 1, dtype=np.int64)  # where the suffix's group starts, from 1; behind the text 0
    rank[order] = _group_starts(key[order], np.arange(n)) + 1
    bits = n.bit_length()
    parts = 3 if 3 * bits <= 63 else 2
    while True:
        # only suffixes that are still tied are sorted again, within the places of their group
        places = rank[order]
        tied = np.zeros(n, dtype=bool)
        tied[1:] = places[1:] == places[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        some = order[slots]
        key = places[slots]
        for i in range(1, parts):
            key = (key << bits) | rank[np.minimum(some + i * width, n)]
        sort = np.argsort(key)
        order[slots] = some = some[sort]
        rank[some] = _group_starts(key[sort], slots) + 1
        width *= parts


def _group_starts(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Of sorted keys that lie in these slots, the slot at which each one's run of equals begins."""
    return np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), slots, 0))


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform with the suffix positions at their first and last rows."""

    def __init__(self, text: np.ndarray, ends: int = 0) -> None:
        """Values below `ends` stand once each; for the order they are one letter, as a match stops at any of them."""
        used = np.bincount(text) > 0
        used[:ends] = False
        order = suffix_array(np.cumsum(used)[text] if ends else text)
        transform = text[order - 1]  # row 0's predecessor wraps around
        starts = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        self.text = text
        self.symbols = transform[starts]
        self.first = order[starts]  # samples at run starts
        self.last = order[np.append(starts[1:], len(text)) - 1]  # and at run ends

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (different places; ends are unique, so it ends)."""
        size, padded = np.zeros(len(a), dtype=np.int64), np.append(self.text, [-1] * 64)
        open_, step = np.arange(len(a)), 4
        while len(open_):
            go_on = []
            for i in range(0, len(open_), 1 << 15):
                some = open_[i : i + (1 << 15)]
                steps = np.arange(step)
                same = padded[(a[some] + size[some])[:, None] + steps] == padded[(b[some] + size[some])[:, None] + steps]
                run = np.where(same.all(axis=1), step, same.argmin(axis=1))
                size[some] += run
                go_on.append(some[run == step])
            open_, step = np.concatenate(go_on), min(64, step * 2)
        return size

    def matching_statistics(self) -> np.ndarray:
        """Of every text position, its longest match with any other position."""
        found, places = np.zeros(len(self.text), dtype=np.int64), np.arange(len(self.text))
        # of each run's first suffix with the row above it, of each run's last with the row below
        for own, other in ((self.first, self.last[:-1]), (np.roll(self.last, 1), self.first[1:])):
            measured = np.append(0, self.common(own[1:], other))  # the first and the last row have one neighbour
            order = np.argsort(own)
            own, measured = own[order], measured[order]
            before = np.searchsorted(own, places, side="right") - 1
            at = np.maximum(before, 0)
            found = np.maximum(found, np.where(before >= 0, measured[at] - (places - own[at]), 0))
        return found


def longest_matches(cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each place of each cut, the length of its longest match with any other place in any of them."""
    bounds = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    text = np.empty(bounds[-1], dtype=np.int64)
    for i, c in enumerate(cuts):
        text[bounds[i] : bounds[i + 1] - 1] = c.astype(np.int64) + len(cuts)
        text[bounds[i + 1] - 1] = i  # an end of its own, so that no match crosses it
    statistics = RunLengthIndex(text, len(cuts)).matching_statistics()
    return [statistics[bounds[i] : bounds[i + 1] - 1] for i in range(len(cuts))]


def repeated_starts(cuts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Of each cut, the places where a string of `length` bytes starts that also starts elsewhere in any of them."""
    return [np.flatnonzero(x >= length) for x in longest_matches(cuts)]


def put_together(places: list[int], starts: list[int], cuts: list[bytes]) -> tuple[list[bytearray], list[tuple[int, int]]]:
    """Texts in which overlapping cuts of one place are joined, and each cut's text and offset there; cuts come by place and start."""
    texts, found, last, begin, end = [], [], None, 0, 0
    for place, start, data in zip(places, starts, cuts, strict=True):
        if place != last or start >= end:
            texts.append(bytearray())
            last, begin, end = place, start, start
        if start + len(data) > end:
            texts[-1] += data[end - start :]
            end = start + len(data)
        found.append((len(texts) - 1, start - begin))
    return texts, found


# ---- over the corpus ---------------------------------------------------------------------------------


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _ranges(starts: np.ndarray, length: int) -> bytes:
    """Covered ranges (from, to) of string starts, as int32 pairs."""
    if not len(starts):
        return b""
    gaps = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, gaps + 1)], starts[np.append(gaps, len(starts) - 1)] + length], axis=1).astype("<i4").tobytes()


CUT = "anchor long, d1 long, d2 long"


def cuts(docs: DataFrame, length: int, anchor: int, reach: int = 0) -> DataFrame:
    """id, h, lo, hi, anchor, d1, d2, twice: every cut of every text (columns id, h, data)."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                rows, parts, digests = [], [], []
                for i, data in enumerate(some.column("data").to_pylist()):
                    minima, lo, hi, twice = cut_text(data, length, anchor, reach)
                    rows.append(np.full(len(lo), i))
                    parts.append((minima.view(np.int64), lo, hi, np.asarray(twice, dtype=bool)))
                    digests += [_digest(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                row = pa.array(np.concatenate(rows).astype(np.int64))
                minima, lo, hi, twice = (np.concatenate([p[i] for p in parts]) for i in range(4))
                d = np.asarray(digests, dtype=np.int64).reshape(-1, 2)
                columns = [some.column("id").take(row), some.column("h").take(row), lo.astype(np.int32), hi.astype(np.int32), minima.astype(np.int64), d[:, 0], d[:, 1], twice]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "h", "lo", "hi", "anchor", "d1", "d2", "twice"])

    return docs.mapInArrow(run, f"id {kind}, h long, lo int, hi int, {CUT}, twice boolean")


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """anchor, d1, d2, place, lo, data of the chosen cuts (id, h, lo, hi, anchor, d1, d2); the texts shuffle once, by row."""
    listed = chosen.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi", "anchor", "d1", "d2")).alias("cuts"))
    same = docs["id"].eqNullSafe(listed["id"]) & (docs["h"] == listed["h"])
    return docs.join(listed, same).select("data", F.xxhash64(listed["id"], listed["h"]).alias("place"), F.explode("cuts").alias("c")).select("c.anchor", "c.d1", "c.d2", "place", "c.lo", F.expr("substring(data, c.lo + 1, c.hi - c.lo)").alias("data")).dropDuplicates(["anchor", "d1", "d2"])


def indexed_starts(texts: DataFrame, groups: int, length: int, passage: int) -> DataFrame:
    """anchor, d1, d2, ranges, shorter (ranges of passages) of cuts whose strings repeat, by a run-length index for each group of minima."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "lo"])
        whole, found = put_together(pdf["place"].tolist(), pdf["lo"].tolist(), pdf["data"].tolist())
        matches = longest_matches([np.frombuffer(x, dtype=np.uint8) for x in whole])

        def ranges(size: int) -> list[bytes]:
            return [_ranges(np.flatnonzero(matches[i][at : at + max(0, len(data) - size + 1)] >= size), size) for (i, at), data in zip(found, pdf["data"], strict=True)]

        out = pdf[["anchor", "d1", "d2"]].assign(ranges=ranges(length), shorter=ranges(passage))
        return out[out["shorter"].map(len) > 0]

    return texts.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).groupBy("group").applyInPandas(run, f"{CUT}, ranges binary, shorter binary")


def counted_starts(texts: DataFrame, length: int, passage: int, anchor: int) -> DataFrame:
    """The same for minima with too many cuts for a group: every string is counted by its digest."""

    def ranges_of(size: int) -> DataFrame:
        def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    # only starts that are the cut's own: those behind them are another cut's, at the same place
                    n = min(_own_starts(row.data, row.anchor, passage, anchor), len(row.data) - size + 1)
                    if n > 0:
                        d = np.asarray([_digest(row.data[i : i + size]) for i in range(n)], dtype=np.int64)
                        yield pd.DataFrame({"anchor": row.anchor, "d1": row.d1, "d2": row.d2, "start": np.arange(n, dtype=np.int32), "s1": d[:, 0], "s2": d[:, 1]})

        strings = stored(texts.mapInPandas(explode, f"{CUT}, start int, s1 long, s2 long"), "repeat-strings")
        often = strings.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        hits = spread_join(strings, often, ["s1", "s2"], "n", strings.count(), F.xxhash64("d1", "start"))

        def gather(starts: pd.Series) -> pd.Series:
            return starts.map(lambda x: _ranges(np.sort(np.asarray(x)), size))

        listed = hits.groupBy("anchor", "d1", "d2").agg(F.collect_list("start").alias("starts"))
        return listed.select("anchor", "d1", "d2", F.pandas_udf(gather, "binary")("starts").alias("ranges"))

    shorter = ranges_of(passage).withColumnRenamed("ranges", "shorter")
    if passage == length:
        return shorter.select("anchor", "d1", "d2", F.col("shorter").alias("ranges"), "shorter")
    return shorter.join(ranges_of(length), ["anchor", "d1", "d2"], "left").select("anchor", "d1", "d2", F.coalesce("ranges", F.lit(b"")).alias("ranges"), "shorter")


def _own_starts(data: bytes, minimum: int, length: int, anchor: int) -> int:
    """How many of a cut's first strings have its minimum."""
    minima = window_minima(window_hashes(np.frombuffer(data, dtype=np.uint8), anchor), length - anchor + 1)
    other = np.flatnonzero(minima.view(np.int64) != minimum)
    return min(int(other[0]) if len(other) else len(minima), CUT_STARTS)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, most_cuts: int = MOST_CUTS, passage: int = 0) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept (binary), n_repeated.

    n_repeated counts the bytes covered by a string of `passage` bytes (at most `length`; 0: `length`) that also starts elsewhere."""
    passage = passage or length
    if not anchor <= passage <= length:
        raise ValueError(f"passage has to lie between anchor and length: {anchor}, {passage}, {length}")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), data.alias("data"))
    kind = dict(rows.dtypes)["id"]
    long = rows.filter(F.octet_length("data") >= passage)
    occurrences = stored(cuts(long, passage, anchor, length), "repeat-cuts")
    # A minimum that stands in one place has nothing to repeat.  Of equal cuts one stands for all.
    distinct = stored(occurrences.groupBy("anchor", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct("id", "h", "lo", "hi")).alias("one")), "repeat-distinct")
    minima = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("any")).filter("m > 1 or any")
    differ = stored(distinct.join(minima, "anchor").select("anchor", "d1", "d2", "one.*", "n", "m"), "repeat-differ")
    size, heavy = differ.agg(F.coalesce(F.sum(F.when(F.col("m") <= most_cuts, F.col("hi") - F.col("lo"))), F.lit(0)), F.count_if(F.col("m") > most_cuts)).first()
    parts = []
    texts = _texts_of(long, differ) if size or heavy else None
    if heavy:
        texts = stored(texts.join(differ.select("anchor", "d1", "d2", "m"), ["anchor", "d1", "d2"]), "repeat-texts")
        parts.append(counted_starts(texts.filter(F.col("m") > most_cuts).drop("m"), length, passage, anchor))
        texts = texts.filter(F.col("m") <= most_cuts).drop("m")
    if size:
        parts.append(indexed_starts(texts, max(1, -(-size // group_bytes)), length, passage))
    part = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    copies = distinct.filter("n > 1").select("anchor", "d1", "d2", "n", F.lit(None).cast("binary").alias("ranges"), F.lit(None).cast("binary").alias("shorter"))
    if part is not None:
        alone = distinct.filter("n = 1").select("anchor", "d1", "d2", "n")
        copies = copies.unionByName(alone.join(part, ["anchor", "d1", "d2"]).select("anchor", "d1", "d2", "n", "ranges", "shorter"))
    marks = stored(copies, "repeat-marks")
    hits = spread_join(occurrences, marks, ["anchor", "d1", "d2"], "n", occurrences.count(), F.xxhash64("id", "lo"))
    listed = hits.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi", "ranges", "shorter")).alias("marks"))

    def covered(size: int, marks: list[dict], kind: str, least: int) -> np.ndarray:
        spans = []
        for mark in marks:
            n = mark["hi"] - mark["lo"]
            if mark[kind] is None:
                spans += [mark["lo"], mark["hi"]] if n >= least else []
            else:
                spans += (np.frombuffer(mark[kind], dtype="<i4") + mark["lo"]).tolist()
        edges = np.bincount(spans[::2], minlength=size + 1) - np.bincount(spans[1::2], minlength=size + 1) if spans else np.zeros(size + 1, dtype=np.int64)
        return np.cumsum(edges)[:-1] > 0

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept, repeated = [], [], [], [], []
            for whole, found in zip(batch.column("data").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                row = (len(whole), 0, 0, whole, 0)
                if found:
                    gone = covered(len(whole), found, "ranges", length)
                    n = int(gone.sum())
                    runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
                    more = n if passage == length else int(covered(len(whole), found, "shorter", passage).sum())
                    row = (len(whole), n, runs, np.frombuffer(whole, dtype=np.uint8)[~gone].tobytes(), more)
                for column, value in zip((sizes, removed, spans, kept, repeated), row, strict=True):
                    column.append(value)
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated"])

    same = rows["id"].eqNullSafe(listed["id"]) & (rows["h"] == listed["h"])
    joined = rows.join(listed, same, "left").select(rows["id"], "data", "marks")
    return joined.mapInArrow(strip, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated long").withColumnRenamed("id", key)
