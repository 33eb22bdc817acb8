"""Operator 8: benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is a shard.  Its words are numbered by their place in the sorted
benchmark vocabulary (0: not in it), and the shard's suffix array holds, in sorted order, the
suffixes that can begin a match: those whose first words are all in the vocabulary for as long as
the shortest window.  Every benchmark suffix is then binary-searched in it; the equal range
gives all places, and places on one diagonal join into the longest verbatim matches.

The benchmark goes to the shards in blocks of at most ``block_bytes`` of text, so what is broadcast is
bounded however many items there are; a document's hits from several blocks are merged by key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import textops as X

_WORD = X.class_table(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
_HIT = "array<struct<lo:int,hi:int>>"
_MATCH = "array<struct<item_id:long,item_start:int,start:int,words:int>>"


def words(body: np.ndarray, offsets: np.ndarray):
    """(hash of every word, row offsets into them); A-Z lowered."""
    low = X.lower_ascii(body)
    start, end, first = X.word_spans(low, offsets, _WORD)
    return X.span_hash(X.prefix_hash(low), start, end), first


class Index:
    """Windows of one block of items, as fixed-width big-endian keys over vocabulary numbers."""

    def __init__(self, item_ids: list[int], texts: list[str], window: int):
        body, off = X.flat(pa.array(texts, pa.string()))
        hashes, first = words(body, off)
        self.window = window
        self.vocabulary = np.unique(hashes)
        number = np.searchsorted(self.vocabulary, hashes) + 1
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, lo, hi in zip(item_ids, first[:-1].tolist(), first[1:].tolist()):
            size = min(window, hi - lo)
            for p in range(lo, hi - size + 1) if size else ():
                places[tuple(number[p : p + size].tolist())].append((item, p - lo))
        order = sorted(places)
        self.places = [places[k] for k in order]
        self.sizes = np.array([len(k) for k in order], np.int64)
        wide = np.zeros((len(order), window), np.uint32)
        for k, w in enumerate(order):
            wide[k, : len(w)] = w
        self.low = self.keys(wide)
        for k, w in enumerate(order):
            wide[k, len(w) :] = 0xFFFFFFFF
        self.high = self.keys(wide)
        self.least = int(self.sizes.min()) if len(order) else window
        self.starts = np.zeros(len(self.vocabulary) + 1, bool)
        self.starts[[k[0] for k in order]] = True

    def keys(self, wide: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(wide.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        p = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[p] == hashes, p + 1, 0).astype(np.uint32)

    def search(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(number) or not len(self.places):
            return none
        stop = np.flatnonzero(np.concatenate((number == 0, [True])))
        limit = stop[np.searchsorted(stop, np.arange(len(number)))]  # next word not in the vocabulary
        limit = np.minimum(limit, np.repeat(first[1:], np.diff(first)))
        at = np.flatnonzero(self.starts[number] & (limit - np.arange(len(number)) >= self.least))
        if not len(at):
            return none
        step = np.arange(self.window)
        spot = at[:, None] + step
        wide = np.where(spot < limit[at][:, None], number[np.minimum(spot, len(number) - 1)], 0)
        key = self.keys(wide)
        order = np.argsort(key, kind="stable")
        suffixes, at = key[order], at[order]
        lo = np.searchsorted(suffixes, self.low, side="left")
        hi = np.searchsorted(suffixes, self.high, side="right")
        many = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), many)
        total = np.concatenate(([0], np.cumsum(many)))
        return which, at[np.repeat(lo - total[:-1], many) + np.arange(total[-1])]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            hits: list[list] = []
            found: list[list] = []
            counts: list[np.ndarray] = []
            for lo, hi in X.slices(off, 1 << 22):
                hashes, first = words(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                counts.append(np.diff(first))
                which, at = index.search(index.number(hashes), first)
                spans, runs = [[] for _ in range(hi - lo)], [{} for _ in range(hi - lo)]
                row = np.searchsorted(first, at, side="right") - 1
                for k, p, r in sorted(zip(which.tolist(), (at - first[row]).tolist(), row.tolist()), key=lambda x: x[1]):
                    size = int(index.sizes[k])
                    spans[r].append((p, p + size))
                    for item, q in index.places[k]:
                        last = runs[r].setdefault((item, p - q), [])
                        if last and last[-1][1] >= p:  # one diagonal: overlapping or adjacent windows are one match
                            last[-1][1] = max(last[-1][1], p + size)
                        else:
                            last.append([p, p + size])
                for s, d in zip(spans, runs):
                    hits.append([{"lo": a, "hi": b} for a, b in _merge(s)])
                    found.append([{"item_id": i, "item_start": a - g, "start": a, "words": b - a} for (i, g), x in sorted(d.items()) for a, b in x])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            match = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())]))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n), pa.array(hits, span), pa.array(found, match)], names=[*keep, "n_words", "hits", "matches"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_merge([(s["lo"], s["hi"]) for part in row for s in part]) for row in batch.column("hits").to_pylist()]
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        cols = [pa.array([[{"lo": a, "hi": b} for a, b in h] for h in hits], span) if c == "hits" else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Broadcast indexes of the benchmark's items, each of about ``block_bytes`` of text at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = int(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        yield items.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, tag (hash of the text), n_words, hits (word spans covered by any
    window), matches (item, its first word, the document's first word, words: longest verbatim).

    An item of fewer than ``window`` words, but not none, is one window.  Null text has no words.
    Items with a null id are left out; rows that repeat an item count once.  An empty benchmark
    leaves all documents clean.  Rows that repeat both id and text come out alike, as often as they
    came in.  An empty ``docs`` gives an empty table; very long texts are searched whole; columns besides
    the ids and texts are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, tag long, n_words long, hits {_HIT}, matches {_MATCH}"
    parts = [docs.mapInArrow(_scan(shared), schema) for shared in _blocks(benchmark, window, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("doc_id", "tag").agg(F.max("n_words").alias("n_words"), F.collect_set("hits").alias("hits"), F.flatten(F.collect_set("matches")).alias("matches"), (F.count(F.lit(1)) / len(parts)).cast("long").alias("copies"))
    merged = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return merged.select("doc_id", "tag", "n_words", F.flatten("hits").alias("hits"), "matches").withColumn("hits", F.array("hits")).mapInArrow(_joined, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination`` rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    ids = F.array_sort(F.transform(F.array_distinct(F.transform("matches", lambda m: m["item_id"])), lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all rows' other columns stay as they
    are, whatever their names.  One pass over the rows for each block, no join."""
    for shared in _blocks(benchmark, window, block_bytes):
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
        schema = f"row {row.schema['row'].dataType.simpleString()}, n_words long, hits {_HIT}, matches {_MATCH}"
        docs = row.mapInArrow(_scan(shared), schema).where(F.size("hits") == 0).select("row.*")
    return docs
