"""Toxicity by multiple-instance learning: sentence scores under noisy-or, trained from document labels.

A sentence's probability is the logistic of a bias and the weights of its distinct words and word
beginnings, hashed; a document is toxic unless all of its sentences are harmless:
p = 1 - prod(1 - p_s).  Features that the document labels clearly favour (likelihood-ratio test) get
weights that maximise the likelihood of the labels under a Gaussian prior.  The same sentence scores
then tell where a toxic document offends.

Features are counted by label over all labelled documents that are not held out, in tasks, and tested on
these counts; the driver gets at most DIMENSIONS counts.  The fit of the weights takes a bounded sample: at most `max_rows` labelled documents of each label, those of the
smallest id hashes, never a held-out one; a label of which more are known weighs as much as all of
them.  Of the sample only the features that passed the test leave the tasks.  Everything else runs over all rows in tasks.

Defined cases: null and empty texts have no sentence and score 0; null labels teach nothing;
documents that repeat are scored alike; without a label of each kind all scores are 0; extra columns
are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .words import LINE_END, Chunks, slices

DIMENSIONS = 1 << 18
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
MAX_ROWS = 4_000
BROADCAST_LABELS = 1_000_000
BEGINNINGS = range(4, 8)
LEAST_RATIO = 14.0
PRIOR = 0.05
STEPS = 150


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % DIMENSIONS


def unit(chunk: str) -> str:
    """The words of a white-space chunk; equal units of a sentence count once."""
    return " ".join(WORD.findall(chunk.lower()))


def unit_features(units: str) -> list[int]:
    return [b for w in units.split() for b in (bucket(w), *(bucket("^" + w[:n]) for n in BEGINNINGS if len(w) > n))]


def sentence_end(chunk: str) -> bool:
    return chunk == LINE_END or chunk[-1] in ".!?"


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, sentence: str) -> float:
        units = {unit(c) for c in sentence.split()} - {""}
        return self.bias + float(sum(self.weights[b] for u in units for b in unit_features(u)))


def sentence_features(text: str | None) -> list[list[int]]:
    """Buckets of each sentence that has words."""
    units = [{unit(c) for c in s.split()} - {""} for s in SENTENCE.findall(text or "")]
    return [[b for u in us for b in unit_features(u)] for us in units if us]


def feature_counts(labelled: DataFrame, text: str) -> DataFrame:
    """bucket, clean, toxic: how many documents of each label hold a feature; bucket -1 counts the documents themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, DIMENSIONS + 1), dtype=np.int64)
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tally[y, [-1, *{b for s in sentence_features(t) for b in s}]] += 1
        held = np.flatnonzero(tally.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(held == DIMENSIONS, -1, held)), *(pa.array(tally[v, held]) for v in (0, 1))], ["bucket", "clean", "toxic"])

    each = labelled.select("y", F.col(text).alias("text")).mapInArrow(count, "bucket long, clean long, toxic long")
    return each.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def features(docs: DataFrame, text: str, keep: list[str], kept: np.ndarray) -> DataFrame:
    """keep columns, features binary (uint32 places in `kept`, a sorted array of buckets), lengths binary (uint32 features of each sentence)."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {int(b): i for i, b in enumerate(shared.value)}
        for pdf in batches:
            found, lengths = [], []
            for t in pdf.pop(text):
                rows = [[place[b] for b in s if b in place] for s in sentence_features(t)]
                found.append(np.asarray([b for s in rows for b in s], dtype="<u4").tobytes())
                lengths.append(np.asarray([len(s) for s in rows], dtype="<u4").tobytes())
            yield pdf.assign(features=found, lengths=lengths)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, text).mapInPandas(extract, f"{schema}, features binary, lengths binary")


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Twice the log likelihood ratio of a feature in a of na and b of nb documents against equal shares."""
    n, t = na + nb, a + b
    parts = ((a, t * na / n), (b, t * nb / n), (na - a, (n - t) * na / n), (nb - b, (n - t) * nb / n))
    return 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0) for x, e in parts)


def favoured(buckets: np.ndarray, a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a of na toxic and b of nb clean documents hold and that clearly favour toxic ones, and their first weights."""
    kept = (_ratio(a, b, na, nb) >= LEAST_RATIO) & (a / na > b / nb)
    return buckets[kept], np.clip(np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1)), 0, 4)[kept]


def fit(kept: np.ndarray, w: np.ndarray, index: np.ndarray, sentences: np.ndarray, documents: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """kept, w: buckets and first weights; index: place of each feature in them; sentences: features of each; documents: sentences of each; weight: of each document."""
    index = index.astype(np.int64)
    document = np.repeat(np.arange(len(documents)), documents)
    sentence = np.repeat(np.arange(len(sentences)), sentences)
    bias, m, v = -6.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, w[index], minlength=len(sentences))
        total = np.maximum(np.bincount(document, np.logaddexp(0, z), minlength=len(documents)), 1e-9)
        # d loss / d total is 1 for label 0 and -exp(-total) / (1 - exp(-total)) for label 1
        slope = weight * np.where(y == 1, -np.exp(-total) / -np.expm1(-total), 1.0)
        dz = slope[document] * np.exp(-np.logaddexp(0, -z))
        g = np.append(np.bincount(index, dz[sentence], minlength=len(w)) + PRIOR * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.2 / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(DIMENSIONS)
    weights[kept] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Tests features on all labelled documents and fits weights on at most max_rows of each label, none of them held out."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    there = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ordered = [known.filter(F.col("y") == v).orderBy(F.xxhash64(key), key).limit(max_rows) for v in (0, 1)]
    chosen = docs.select(key, text).join(F.broadcast(ordered[0].unionByName(ordered[1])), key)
    # ids and labels of up to BROADCAST_LABELS documents (about 16 MB) are broadcast, so that no text moves; more are joined by a shuffle
    marks = F.broadcast(known) if sum(there.values()) <= BROADCAST_LABELS else known.hint("merge")
    counts = feature_counts(docs.select(key, text).join(marks, key), text).toPandas().sort_values("bucket")
    whole = counts["bucket"] == -1
    nb, na = (int(counts.loc[whole, c].sum()) for c in ("clean", "toxic"))
    if not na or not nb:
        return Model(np.zeros(DIMENSIONS), -np.inf)
    kept, first = favoured(*(counts.loc[~whole, c].to_numpy() for c in ("bucket", "toxic", "clean")), na, nb)
    rows = features(chosen, text, [key, "y"], kept).toPandas().sort_values(key)
    y = rows["y"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(DIMENSIONS), -np.inf)
    lengths = [np.frombuffer(x, dtype="<u4") for x in rows["lengths"]]
    weight = np.asarray([max(1.0, there[v] / max_rows) for v in y])
    return fit(kept, first, np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["features"]]), np.concatenate(lengths), np.asarray([len(x) for x in lengths]), y, weight)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, score, predicted, sentences, offending (sentences with a probability of at least the threshold)."""
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value

        def describe(chunk: str) -> tuple:
            words = unit(chunk) if chunk != LINE_END else ""
            return float(sum(weights[b] for b in unit_features(words))), zlib.crc32(words.encode()) if words else -1, sentence_end(chunk)

        cache = Chunks(describe, 3)
        for batch in batches:
            for some in slices(batch):
                codes, bounds = cache.rows(some.column("text").to_pylist())
                figures = cache.figures[codes]
                # a sentence ends at its last chunk or with its document
                ends = figures[:, 2] > 0
                ends[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
                last = np.flatnonzero(ends)
                sentence = np.cumsum(ends) - ends
                # each word counts once a sentence
                _, first = np.unique(sentence.astype(np.int64) * (1 << 33) + figures[:, 1].astype(np.int64), return_index=True)
                first = first[figures[first, 1] >= 0]
                words = np.bincount(sentence[first], minlength=len(last))
                z = np.where(words > 0, bias + np.bincount(sentence[first], figures[first, 0], minlength=len(last)), -np.inf)
                document = np.searchsorted(bounds[1:], last, side="right")
                n = some.num_rows
                soft = np.bincount(document, np.logaddexp(0, z), minlength=n)
                worst = np.bincount(document, z >= np.log(threshold / (1 - threshold)), minlength=n)
                p = -np.expm1(-soft)
                whole = [p, (p >= threshold).astype("int32"), np.bincount(document, words > 0, minlength=n).astype("int64"), worst.astype("int64")]
                yield pa.RecordBatch.from_arrays([some.column("id"), *map(pa.array, whole)], ["id", "score", "predicted", "sentences", "offending"])

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, sentences long, offending long").withColumnRenamed("id", key)


def offending_sentences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, start, length, sentence, probability of each sentence that reaches the threshold; offsets in characters."""
    kind = dict(docs.dtypes)[key]  # ids travel as text where pandas would turn a null into a float
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                for s in SENTENCE.finditer(t or ""):
                    p = 1 / (1 + np.exp(-shared.value.logit(s[0]))) if WORD.search(s[0]) else 0.0
                    if p >= threshold:
                        out.append((i, s.start(), len(s[0]), s[0], float(p)))
            yield pd.DataFrame(out, columns=["id", "start", "length", "sentence", "probability"])

    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "id string, start int, length int, sentence string, probability double").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
