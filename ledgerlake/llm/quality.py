"""Quality by weak labels: EM over heuristic labellers, then a hashed linear scorer on the posteriors.

One pass over the texts (`described`) takes every document's votes and its hashed features: nine
labellers look at it and vote keep, reject or nothing.  Spark counts the vote
patterns of the whole corpus (at most 3**9 of them), and EM estimates from these counts how often
each labeller votes what on good and on bad documents, without any true label.  The posterior of a
document's pattern is its label.  A logistic scorer on the hashed features (shapes of chunks, binned
figures of the document) is fitted to the posteriors of a bounded sample (`max_rows`, the smallest
hashes of id and text) and scores every document.  Labellers and features read whole texts, at every
length alike: a word is new or repeated within its window of WINDOW words, so the share of new ones
does not fall with a text's length.

Defined cases: null and empty texts get no votes and are kept (score of an empty feature vector
under the rule below); equal texts score alike; an empty table gives no rows; extra columns stay in
`keep_good` and are left out of `score`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import LINE_END, Chunks, slices, sums

NONE, KEEP, REJECT = 0, 1, 2
LABELLERS = ("pipes", "symbols", "exclaims", "capitals", "same_lines", "few_words", "stammer", "stop_words", "word_length")
DIMENSIONS = 1 << 14
MAX_ROWS = 8_000
CACHED_CHUNKS = 150_000  # a worker keeps what its caches took, and an executor has a worker a core
WINDOW = 500
SYMBOLS = re.compile(r"[#$%&*~^=<>\\{}\[\]_@]{2,}")
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be this from or by an a at "
    "le la les de des du et en un une que qui pas sur au pour par dans est "
    "der die das und ist in den von zu mit sich auf für nicht ein eine des im "
    "el los las y una con por se su al no es como".split()
)


_SIGNS = {**dict.fromkeys(range(0xC0, 0xDF), "A"), **dict.fromkeys(range(0xDF, 0x250), "a"), **dict.fromkeys(range(65, 91), "A"), **dict.fromkeys(range(97, 123), "a"), **dict.fromkeys(range(48, 58), "0")}
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def shape(chunk: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; of other characters as one of them."""
    return _RUNS.sub(r"\1", chunk.translate(_SIGNS))


_PLAIN = zlib.crc32(b"a") % DIMENSIONS


def describe(chunk: str) -> tuple:
    """Of a chunk: line end, pipe, symbols, exclamation, all capitals, stop word, length, hashed shape."""
    if chunk.isascii() and chunk.isalpha() and chunk.islower():
        return 0, 0, 0, 0, 0, chunk in STOP_WORDS, len(chunk), _PLAIN
    if chunk == LINE_END:
        return 1, 0, 0, 0, 0, 0, 0, 0
    word = chunk.strip(".,;:!?\"'()").lower()
    capitals = len(chunk) > 1 and chunk.isupper()
    return 0, "|" in chunk, bool(SYMBOLS.search(chunk)), "!!" in chunk, capitals, word in STOP_WORDS, len(chunk), zlib.crc32(shape(chunk).encode()) % DIMENSIONS


def _vote(value: np.ndarray, keep, reject, heard=True) -> np.ndarray:
    return np.where(heard & reject(value), REJECT, np.where(heard & keep(value), KEEP, NONE))


def new_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many chunks of each document are the first of their kind in their window of WINDOW chunks."""
    lengths = np.diff(bounds)
    document = np.repeat(np.arange(len(lengths)), lengths)
    windows = -(-lengths // WINDOW)
    window = (np.cumsum(windows) - windows)[document] + (np.arange(len(codes)) - bounds[:-1][document]) // WINDOW
    first = np.unique(window << 32 | codes) >> 32
    return np.bincount(np.searchsorted(np.cumsum(windows), first, side="right"), minlength=len(lengths))


def figures(texts: list[str], cache: Chunks) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Votes (documents x labellers), shares behind them, and the chunks' hashed shapes with the bounds of each document."""
    codes, bounds = cache.rows(texts)
    f = cache.figures[codes]
    n = sums(1 - f[:, 0], bounds)
    each = np.maximum(n, 1)
    share = {k: sums(f[:, i], bounds) / each for i, k in ((1, "pipes"), (2, "symbols"), (3, "exclaims"), (4, "capitals"), (5, "stop_words"), (6, "word_length"))}
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    share["same_lines"] = np.asarray([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    share["few_words"] = new_words(codes, bounds) / np.maximum(np.diff(bounds), 1)
    again = np.append(codes[1:] == codes[:-1], False)
    again[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False  # what follows is another document
    share["stammer"] = sums(again, bounds) / np.maximum(np.diff(bounds), 1)
    many, any_words = n >= 20, n > 0
    votes = np.stack(
        [
            *(_vote(share[k], lambda x: x <= 0.01, lambda x: x >= 0.1, any_words) for k in ("pipes", "symbols", "exclaims")),
            _vote(share["capitals"], lambda x: x <= 0.1, lambda x: x >= 0.3, any_words),
            _vote(share["same_lines"], lambda x: x <= 0.1, lambda x: x >= 0.4, any_words),
            _vote(share["few_words"], lambda x: x >= 0.5, lambda x: x < 0.25, many),
            _vote(share["stammer"], lambda x: x <= 0.05, lambda x: x >= 0.2, any_words),
            _vote(share["stop_words"], lambda x: x >= 0.12, lambda x: x < 0.05, many),
            _vote(share["word_length"], lambda x: (x >= 3.5) & (x <= 7), lambda x: x > 9, many),
        ],
        axis=1,
    )
    return votes.astype(np.int64), share, codes, bounds


def patterns(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def unpack(pattern: np.ndarray, n: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(n) % 3


@dataclass
class WeakModel:
    """prior: share of bad documents; rates[c, j, v]: how often labeller j votes v (of keep, reject) on class c (good, bad)."""

    prior: float
    rates: np.ndarray

    def bad(self, pattern: np.ndarray) -> np.ndarray:
        votes = unpack(np.asarray(pattern), self.rates.shape[1])
        logs = np.log(self.rates)
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            for v in (KEEP, REJECT):
                odds += (votes[:, j] == v) * (logs[1, j, v - 1] - logs[0, j, v - 1])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def expectation_maximisation(pattern: np.ndarray, n: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200) -> WeakModel:
    """Starts from the opinion that any vote to reject is right; a labeller that says nothing is no evidence."""
    votes = unpack(pattern, labellers)
    q = np.where((votes == REJECT).any(axis=1), 0.9, 0.02)
    for _ in range(rounds):
        rates = np.empty((2, labellers, 2))
        for c, weight in ((0, n * (1 - q)), (1, n * q)):
            for j in range(labellers):
                counts = np.asarray([(weight * (votes[:, j] == v)).sum() + 0.5 for v in (KEEP, REJECT)])
                rates[c, j] = counts / counts.sum()
        model = WeakModel(float(np.clip((n * q).sum() / n.sum(), 1e-4, 1 - 1e-4)), rates)
        new = model.bad(pattern)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


_BINS = np.asarray([[zlib.crc32(f"{k}:{i}".encode()) % DIMENSIONS for i in range(11)] for k in LABELLERS])
_SCALES = np.asarray([0.05 if k == "word_length" else 1.0 for k in LABELLERS])


def _vectors(texts: list[str], cache: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pattern of each document, its number of words, and its features as (document, bucket, value): shares of shapes, and a bucket for each figure by tenths."""
    votes, share, codes, bounds = figures(texts, cache)
    hashed = cache.figures[codes, 7].astype(np.int64)
    n, lengths = len(texts), np.diff(bounds)
    document = np.repeat(np.arange(n), lengths)
    each, at = np.unique(document * DIMENSIONS + hashed, return_inverse=True)
    value = np.bincount(at, minlength=len(each)) / np.maximum(lengths, 1)[each // DIMENSIONS]
    tenths = np.minimum(10, 10 * np.stack([share[k] for k in LABELLERS], axis=1) * _SCALES).astype(np.int64)
    bins = _BINS[np.arange(len(LABELLERS)), tenths]
    words = sums(cache.figures[codes, 0] == 0, bounds).astype(np.int64)
    document = np.concatenate([each // DIMENSIONS, np.repeat(np.arange(n), bins.shape[1])])
    return patterns(votes), words, document, np.concatenate([each % DIMENSIONS, bins.ravel()]), np.concatenate([value, np.full(bins.size, 0.5)])


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, place (hash of id and text), pattern of votes, words, features (uint32 buckets) and values (float32) of every document; written once."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks(describe, 8, CACHED_CHUNKS)
        for batch in batches:
            for some in slices(batch):
                p, words, document, feature, value = _vectors(some.column("text").to_pylist(), cache)
                order = np.argsort(document, kind="stable")
                cuts = np.cumsum(np.bincount(document, minlength=some.num_rows))[:-1]
                features = [x.tobytes() for x in np.split(feature[order].astype("<u4"), cuts)]
                values = [x.tobytes() for x in np.split(value[order].astype("<f4"), cuts)]
                columns = [some.column("id"), some.column("place"), pa.array(p), pa.array(words), pa.array(features, pa.binary()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "place", "pattern", "words", "features", "values"])

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("place"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, f"id {kind}, place long, pattern long, words long, features binary, values binary"), "quality")


@dataclass
class Scorer:
    weak: WeakModel
    weights: np.ndarray
    bias: float

    def good(self, document: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(document, self.weights[feature] * value, minlength=n)
        return 1 / (1 + np.exp(np.clip(z, -500, 500)))


def _flat(features: list[bytes], values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    document = np.repeat(np.arange(len(features)), [len(x) // 4 for x in features])
    return document, np.frombuffer(b"".join(features), dtype="<u4").astype(np.int64), np.frombuffer(b"".join(values), dtype="<f4").astype(float)


def train(found: DataFrame, max_rows: int = MAX_ROWS, steps: int = 200) -> Scorer:
    """From `described` documents: EM over the vote patterns of all, and the scorer from the posteriors of at most max_rows of them."""
    counts = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if counts.empty:
        return Scorer(WeakModel(0.5, np.full((2, len(LABELLERS), 2), 0.5)), np.zeros(DIMENSIONS), 0.0)
    weak = expectation_maximisation(counts["pattern"].to_numpy(), counts["n"].to_numpy(dtype=float))
    # the smallest hashes; ids alone are sorted, of at most 1.2 times as many rows as are asked for
    bound = min(2**63 - 1, int(2**64 * min(1.0, 1.2 * max_rows / int(counts["n"].sum()))) - 2**63)
    last = found.filter(F.col("place") <= bound).select("place").orderBy("place").limit(max_rows).agg(F.max("place")).first()[0]
    rows = found.filter(F.col("place") <= (bound if last is None else last)).select("pattern", "features", "values").limit(max_rows).toPandas()
    target = weak.bad(rows["pattern"].to_numpy())
    document, order, value = _flat(rows["features"].tolist(), rows["values"].tolist())
    w, bias = np.zeros(DIMENSIONS), 0.0
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(document, w[order] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(-z)) - target) / len(rows)
        g = np.concatenate([np.bincount(order, error[document] * value, minlength=DIMENSIONS) + 1e-5 * w, [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
    return Scorer(weak, w, float(bias))


def score(found: DataFrame, scorer: Scorer, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Of `described` documents: key, score (probability that the text is good), keep, posterior (of its votes alone)."""
    shared = found.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            document, feature, value = _flat(batch.column("features").to_pylist(), batch.column("values").to_pylist())
            good = model.good(document, feature, value, batch.num_rows)
            keep = (good >= threshold) | (batch.column("words").to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(good), pa.array(keep), pa.array(1 - model.weak.bad(batch.column("pattern").to_numpy()))], ["id", "score", "keep", "posterior"])

    kind = dict(found.dtypes)["id"]
    return found.mapInArrow(run, f"id {kind}, score double, keep boolean, posterior double").withColumnRenamed("id", key)


def keep_good(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are not rejected, columns as they were; texts are read again, so no second copy of them is written."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, Chunks(describe, 8, CACHED_CHUNKS)
        for batch in batches:
            for some in slices(batch):
                texts = [t or "" for t in some.column(names.index(text)).to_pylist()]
                _, words, document, feature, value = _vectors(texts, cache)
                yield some.filter(pa.array((model.good(document, feature, value.astype("<f4"), len(texts)) >= threshold) | (words == 0)))

    return docs.mapInArrow(run, docs.schema)
