"""Operator 5: toxicity by the nearest labelled examples under exact weighted TF-IDF cosine.

1. A bounded sample of labelled rows (``sample_rows``) gives the examples.  Every term of an example is
   indexed.  A term weighs its idf, times one plus the log-likelihood ratio of its document counts by
   label; equal examples count once.  A term that no example holds has the idf of count 0.  Norms are
   over all terms of a text.
2. A query's cosine with every example is summed in single precision: the ``DENSE`` commonest terms by
   matrix product, the others by inverted lists.  Whatever comes within the rounding error of the k-th
   best is summed again in double precision, so the k nearest are exact; ties go to the smaller id.
3. The neighbours vote by cosine, shrunk towards the share of toxic examples, which is also the score of
   a text that shares no term with any.  Neighbours are the evidence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millwright.llm import textops as X
from millwright.llm.common import held_out, narrow_batches, staged
from millwright.llm.quality import labelled_rows

DENSE, QUERIES = 256, 32  # terms, and queries, of one matrix product
STEP = 1024  # examples that are added to the lists at a time
SLICE = 1 << 18  # bytes of text that are looked at together
KNOWN = 10_000  # texts whose scores a task keeps, and those of one slice more
SLACK = (DENSE + 8) * 2.0**-22  # twice the error of a cosine in single precision, and some more
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:] = 1
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _KIND[_lo:_hi] = 1


def terms(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = X.lower_ascii(body)
    start, end, first = X.word_spans(low, offsets, _KIND)
    return X.span_hash(X.prefix_hash(low), start, end), first


def bags(body: np.ndarray, offsets: np.ndarray):
    """Sparse counts of all terms: (row, term hash, count), sorted."""
    word, first = terms(body, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    at = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])))) if len(word) else np.zeros(0, np.int64)
    return row[at], word[at], np.diff(np.append(at, len(word)))


def _unit(row, value):
    """Values of unit length by row."""
    norm = np.sqrt(np.bincount(row, value * value, int(row.max()) + 1 if len(row) else 0))
    return value / norm[row] if len(row) else value


def _weights(row, term, count, idf):
    """TF-IDF values of unit length by row."""
    return _unit(row, (1 + np.log(count)) * idf[term])


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of all ranges end to end."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Examples:
    """The examples as sparse rows; a worker builds lists and matrix when it first needs them."""

    def __init__(self, space, idf, prior, doc, label, row, term, count, unseen: float = 1.0):
        self.space, self.idf, self.prior, self.unseen = space, idf, prior, unseen
        self.doc, self.label = doc, label
        self.at = np.searchsorted(row, np.arange(len(doc) + 1).astype(row.dtype))
        self.term, self.count = term.astype(np.int32, copy=False), count.astype(np.min_scalar_type(int(count.max()) if len(count) else 0))
        self.ready = False

    def clear(self) -> None:
        """Leaves nothing: for the driver's copy, once the workers' is written."""
        self.__dict__.clear()

    def _build(self) -> None:
        """Lists and matrix, in few arrays at a time, as every worker of an executor has its own."""
        n = len(self.doc)
        self.norm, held = np.ones(n), np.zeros(len(self.space), np.int64)
        for lo in range(0, n, STEP):  # rows end to end, so their values too
            hi = min(n, lo + STEP)
            row = np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))
            value = self.values(slice(self.at[lo], self.at[hi]), row + lo)
            norm = np.sqrt(np.bincount(row, value * value, hi - lo))
            self.norm[lo:hi] = np.where(norm > 0, norm, 1)
            held += np.bincount(self.term[self.at[lo] : self.at[hi]], minlength=len(self.space))
        most = np.argsort(-held, kind="stable")[:DENSE]
        self.column = np.full(len(self.space), -1, np.int32)
        self.column[most] = np.arange(len(most))
        self.matrix = np.zeros((len(most), n), np.float32)
        held[most] = 0
        self.lists = np.concatenate(([0], np.cumsum(held)))
        self.p, self.v = np.empty(self.lists[-1], np.min_scalar_type(n)), np.empty(self.lists[-1], np.float32)
        fill = self.lists[:-1].copy()
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            part = slice(self.at[lo], self.at[hi])
            row, term = np.repeat(np.arange(lo, hi), np.diff(self.at[lo : hi + 1])), self.term[part]
            value, column = self.values(part, row), self.column[term]
            dense = column >= 0
            self.matrix[column[dense], row[dense]] = value[dense]
            row, term, value = row[~dense], term[~dense], value[~dense]
            order = np.argsort(term, kind="stable")
            row, term, value = row[order], term[order], value[order]
            # the k-th of a term in these rows goes k places behind what its list has so far
            place = fill[term] + np.arange(len(term)) - np.searchsorted(term, term)
            self.p[place], self.v[place] = row, value
            np.add.at(fill, term, 1)
        self.query = np.zeros(len(self.space))
        self.ready = True

    def values(self, at, row) -> np.ndarray:
        """TF-IDF values at places of the rows, of unit length by row."""
        return (1 + np.log(self.count[at].astype(np.int64))) * self.idf[self.term[at]] / self.norm[row]

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the k nearest examples, cosines), best first; places with cosine 0 never."""
        return next(self.nearest_all(np.array([0, len(term)]), term, value, k))

    def nearest_all(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of many queries, whose terms lie end to end."""
        if not self.ready:
            self._build()
        for q in range(0, len(first) - 1, QUERIES):
            ends = first[q : q + QUERIES + 1]
            t, v = term[ends[0] : ends[-1]], value[ends[0] : ends[-1]]
            row, column = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), self.column[t]
            lead = np.zeros((len(ends) - 1, len(self.matrix)), np.float32)
            lead[row[column >= 0], column[column >= 0]] = v[column >= 0]
            sums = lead @ self.matrix
            for i in range(len(ends) - 1):
                part = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
                yield self._best(t[part], v[part], sums[i], k)

    def _best(self, term, value, total, k):
        size = self.lists[term + 1] - self.lists[term]
        at = _ranges(self.lists[term], size)
        if len(at):
            total = total + np.bincount(self.p[at], np.repeat(value, size) * self.v[at], len(total))
        least = np.partition(total, len(total) - k)[len(total) - k] - SLACK if len(total) > k else 0.0
        place = np.flatnonzero((total > 0) & (total >= least))
        size = self.at[place + 1] - self.at[place]
        at = _ranges(self.at[place], size)
        self.query[term] = value
        score = np.bincount(np.repeat(np.arange(len(place)), size), self.values(at, np.repeat(place, size)) * self.query[self.term[at]], len(place))
        self.query[term] = 0
        best = np.lexsort((self.doc[place], -np.round(score, 12)))[:k]
        return place[best], score[best]

    def vote(self, place: np.ndarray, score: np.ndarray, shrink: float) -> float:
        return float((score @ self.label[place] + shrink * self.prior) / (score.sum() + shrink))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, off = X.flat(batch.column("text"))
        for lo, hi in X.slices(off, SLICE):
            row, term, count = bags(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            at = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (term.view(np.int64), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "label")] + lists, names=["doc_id", "label", "terms", "counts"])


def _ratio(n, t, total: float, toxic: float) -> np.ndarray:
    """Log-likelihood ratio of terms in n examples, t of them toxic."""

    def xlogx(o, e):
        some = o > 0
        return np.where(some, o * np.log(np.where(some, o, 1) / np.where(some, e, 1)), 0.0)

    clean, rest = total - toxic, total - n
    both = xlogx(t, n * toxic / total) + xlogx(n - t, n * clean / total)
    return np.maximum(0, both + xlogx(toxic - t, rest * toxic / total) + xlogx(clean - n + t, rest * clean / total))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Examples:
    """The index over at most ``sample_rows`` examples; its size is that of their distinct terms."""
    rows = labelled_rows(docs, labels, "toxic", sample_rows).select("doc_id", "label", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = staged(rows.mapInArrow(_examples, "doc_id long, label int, terms array<long>, counts array<int>"), "examples").toArrow()
    doc, label = (found.column(c).to_numpy().astype(t) for c, t in (("doc_id", np.int64), ("label", float)))
    # part by part: the hashes of all terms of all examples are several times what the index takes
    terms, counts = found.column("terms").chunks, found.column("counts").chunks
    del found
    of = lambda part, kind: part.flatten().to_numpy(zero_copy_only=False).view(kind)
    none = [np.zeros(0, np.int64)]
    size = np.concatenate([*none, *(x.value_lengths().to_numpy(zero_copy_only=False) for x in terms)])
    space = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(of(x, np.uint64)) for x in terms)]))
    term = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(space, of(x, np.uint64)).astype(np.int32) for x in terms)])
    count = np.concatenate([np.zeros(0, np.int32), *(of(x, np.int32) for x in counts)])
    del terms, counts
    order = np.lexsort((size, label, doc))
    places = [slice(b - n, b) for b, n in zip(np.cumsum(size)[order].tolist(), size[order].tolist())]
    term, count = (np.concatenate([x[:0], *(x[p] for p in places)]) for x in (term, count))
    doc, label, size = doc[order], label[order], size[order]
    prior = float(label.mean()) if len(label) else 0.5
    at = np.append(0, np.cumsum(size))
    # equal examples count once
    known: dict[bytes, int] = {}
    lead = np.array([known.setdefault(_key(term[a:b], count[a:b]), r) == r for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))], bool)
    del known
    n, t = np.zeros(len(space)), np.zeros(len(space))
    for lo in range(0, len(doc), STEP):
        hi = min(len(doc), lo + STEP)
        row = np.repeat(np.arange(lo, hi), size[lo:hi])
        once = lead[row]
        of_once = term[at[lo] : at[hi]][once]
        n += np.bincount(of_once, minlength=len(space))
        t += np.bincount(of_once, label[row[once]], len(space))
    row = np.repeat(np.arange(len(doc), dtype=np.int32), size)
    total, toxic = float(lead.sum()), float(label[lead].sum())
    weight = (np.log((1 + total) / (1 + n)) + 1) * (1 + _ratio(n, t, total, toxic)) if len(space) else np.zeros(0)
    return Examples(space, weight, prior, doc, label, row, term, count, np.log(1 + total) + 1)


def _key(word: np.ndarray, count: np.ndarray) -> bytes:
    return hashlib.blake2b(word.tobytes() + count.astype(np.int64).tobytes(), digest_size=16).digest()


def _evidence(index: Examples, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Neighbours of each row as one list array."""
    ends = np.cumsum([0] + [len(place) for place, _ in found]).astype(np.int32)
    place = np.concatenate([place for place, _ in found] + [np.zeros(0, np.int32)]).astype(np.int64)
    cosine = np.concatenate([score for _, score in found] + [np.zeros(0)])
    of = [pa.array(index.doc[place]), pa.array(index.label[place].astype(np.int32)), pa.array(cosine)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(of, names=["doc_id", "toxic", "cosine"]))


_NONE = (np.zeros(0, np.int32), np.zeros(0))


def _score(shared, k: int, shrink: float, evidence: bool = False, text: bool = False):
    """Adds score to a batch, and evidence; ``text`` itself comes out only where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Examples = shared.value
        known: dict[bytes, tuple] = {}  # equal texts are looked up once, as long as few are known
        for batch in batches:
            scores, found = np.full(batch.num_rows, index.prior), [_NONE] * batch.num_rows if evidence else []
            body, off = X.flat(batch.column("text"))
            for lo, hi in X.slices(off, SLICE) if len(index.space) else ():
                if len(known) > KNOWN:
                    known.clear()
                row, word, count = bags(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                p = np.minimum(np.searchsorted(index.space, word), len(index.space) - 1)
                hit = index.space[p] == word
                value = _unit(row, (1 + np.log(count)) * np.where(hit, index.idf[p], index.unseen))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                keys = [_key(word[a:b], count[a:b]) if a < b else b"" for a, b in zip(cut[:-1], cut[1:])]
                ask = {key: r for r, key in enumerate(keys) if key and key not in known}
                use = hit & np.isin(row, np.fromiter(ask.values(), np.int64, len(ask)))
                at = np.concatenate(([0], np.cumsum(use)))
                asked = np.array([*sorted(ask.values())], np.int64)
                first = np.append(at[cut[asked]], at[-1])
                for r, (place, score) in zip(asked.tolist(), index.nearest_all(first, p[use], value[use], k)):
                    known[keys[r]] = (index.vote(place, score, shrink), (place, score) if evidence else None)
                for r, key in enumerate(keys):
                    if key:
                        scores[lo + r] = known[key][0]
                        if evidence:
                            found[lo + r] = known[key][1]
            keep = [c for c in batch.schema.names if text or c != "text"]
            more = {"score": pa.array(scores)} | ({"evidence": _evidence(index, found)} if evidence else {})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], names=[*keep, *more])

    return run


def _shared(docs: DataFrame, labels: DataFrame, sample_rows: int):
    """The index for the workers; the driver keeps none of it."""
    narrow_batches(docs.sparkSession)
    index = fit(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    index.clear()
    return shared


_EVIDENCE = "evidence array<struct<doc_id:long,toxic:int,cosine:double>>"


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, k: int = 10, shrink: float = 0.5, cut: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted, evidence (the neighbours).

    Null text scores as empty.  Without labelled rows every score is 0.5.  Repeated rows score alike.  An
    empty table gives an empty one, very long texts count with all their words, and columns besides
    doc_id and text are never read.
    """
    shared = _shared(docs, labels, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(shared, k, shrink, evidence=True), f"doc_id long, score double, {_EVIDENCE}")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, k: int = 10, shrink: float = 0.5, cut: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``; columns stay as they are."""
    shared = _shared(docs, labels, sample_rows)
    # the text goes to the workers once; one of another type stays in the row as well
    apart = dict(docs.dtypes).get("text") == "string" and len(docs.columns) > 1
    others = [c for c in docs.columns if not (apart and c == "text")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text"))
    out = row.schema.fields[: 2 if apart else 1] + [StructField("score", DoubleType())]
    scored = row.mapInArrow(_score(shared, k, shrink, text=apart), StructType(out))
    return scored.where(F.col("score") < cut).select(*[F.col("row").getField(c).alias(c) if c in others else F.col("text") for c in docs.columns])
