"""Operator 2: quality scores from hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its words, punctuation runs and their neighbouring pairs, hashed to
``2**BITS`` places; values are counts over the square root of their number.  Training is online
(FTRL-proximal with L1 and L2) in one task that streams a bounded sample of labelled rows in
hash order: ``sample_rows`` at most.  Scoring is a sparse dot product over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import held_out

BITS = 18
_KIND = np.full(256, 2, np.uint8)
_KIND[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 0
_KIND[0x80:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _KIND[_lo:_hi] = 1
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all rows end to end, row offsets): words, then pairs, row by row."""
    start, end, first = X.word_spans(body, offsets, _KIND)
    word = X.span_hash(X.prefix_hash(body), start, end)
    pair = X.mix64(word[:-1] * _PAIR + word[1:]) if len(word) > 1 else word[:0]
    n = np.diff(first)
    size = np.where(n > 0, 2 * n - 1, 0)
    at = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(n)), size)
    k = np.arange(at[-1]) - at[row]
    single = k < n[row]
    out = np.empty(at[-1], np.uint64)
    out[single] = word[first[row[single]] + k[single]]
    out[~single] = pair[first[row[~single]] + k[~single] - n[row[~single]]]
    return (out >> np.uint64(64 - BITS)).astype(np.int64), at


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last place is the intercept."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        at, count = np.unique(places, return_counts=True)
        at = np.append(at, 1 << BITS)
        value = np.append(count / np.sqrt(max(1, len(places))), 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen = Ftrl(), 0
    for batch in batches:
        label = batch.column("label").to_pylist()
        body, off = X.flat(batch.column("text"))
        for lo, hi in X.slices(off, 1 << 20):
            places, at = features(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for k in range(hi - lo):
                model.learn(places[at[k] : at[k + 1]], label[lo + k])
                seen += 1
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), pa.array([seen])], names=["weights", "seen"])


def fit(rows: DataFrame, sample_rows: int = 20_000) -> np.ndarray:
    """Weights learnt from (text, label) rows: the ``sample_rows`` first by ``order`` if there are more."""
    some = rows.where("label in (0, 1)").orderBy("order").limit(sample_rows).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    got = some.coalesce(1).mapInArrow(_fit, "weights binary, seen long").collect()
    return np.frombuffer(got[0][0], np.float32).astype(np.float64) if got else np.zeros((1 << BITS) + 1)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            scores = []
            for lo, hi in X.slices(off, 1 << 20):
                places, at = features(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                total = np.concatenate(([0.0], np.cumsum(w[places])))
                n = np.diff(at)
                scores.append((total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + w[-1])
            s = np.concatenate(scores) if scores else np.zeros(0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=[*keep, "score"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, label, order) of a bounded sample of the training fold, first by a hash of the id.

    The sample's ids are chosen before the texts are touched, so ``sample_rows`` ids are broadcast at
    most and no text is shuffled.  A label that is null or not 0 or 1 is left out; of several
    labels for one document the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.where(~held_out("doc_id")).withColumn("order", F.xxhash64("doc_id")).orderBy("order").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(known), "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted.  Null text scores as empty.

    Without any labelled rows every score is 0.5.  A null id is not held out.  Rows that repeat id and text
    score alike, and count as often as they come in when they are labelled; very long texts are read whole.
    An empty table gives an empty one; columns besides doc_id and text are never read.
    """
    w = fit(labelled_rows(docs, labels, "quality", sample_rows), sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
