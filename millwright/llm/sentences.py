"""Operator 6: removal of sentence spans that repeat across the corpus.

A sentence ends at a blank after ``. ! ?``, after ``。！？`` or at a line end, and a clause of it is taken
for a sentence of its own: ``, ; :`` count like the other marks.  A passage that begins and ends inside
sentences still holds most of its clauses whole, so that runs of them can ask for more words than a passage's
few whole sentences have, and leave common short sentences alone.  From every sentence the span of ``run`` consecutive sentences that starts there is hashed (128 bits, over the
trimmed sentences); a span short of ``least_words`` words grows by further sentences until it has
them, so that runs of one-word sentences do not count.  Fewer sentences are a span
if they have ``few_words`` words.  Spans up to a sentence are added where needed, so that a repeated run of
whole sentences with ``long_words`` words (over 50) is covered whole, whatever its sentence lengths.  The spans join
globally on their hash; the one with the smallest (document, position) is the first, and every sentence covered by a span that is
not the first of its hash is removed.  Spans may start anywhere, so overlapping repeats are found.

A batch sends its first span of each hash to the hash's task (its own later copies are repeats by
themselves), so a line that is in every document costs one row for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import staged

_BLANK = np.zeros(256, bool)
_BLANK[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?,;:", np.uint8)] = True
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "。！？，；："], np.int32)
_SALT = np.uint64(0xA24BAED4963EE407)


def sentences(body: np.ndarray, offsets: np.ndarray):
    """(start, end of each sentence with outer blanks trimmed, words in it, row offsets)."""
    n = len(body)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(offsets), np.int64)
    blank = _BLANK[body]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    line = body == 0x0A
    cut[1:] |= line
    # a blank right after a stop mark ends the sentence, and a full-width stop mark does by itself
    cut[1:-1] |= _STOP[body[:-1]] & blank[1:]
    if n > 2:
        mark = (body[:-2].astype(np.int32) << 16) | (body[1:-1].astype(np.int32) << 8) | body[2:]
        cut[3:] |= np.isin(mark, _WIDE)
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    dense = np.concatenate(([0], np.cumsum(~blank)))
    full = dense[end] > dense[start]
    start, end = start[full], end[full]
    solid = np.flatnonzero(~blank)
    start = solid[dense[start]]
    end = solid[dense[end] - 1] + 1
    head = ~blank
    head[1:] &= blank[:-1]
    row_start = offsets[:-1][offsets[:-1] < n]
    head[row_start] = ~blank[row_start]
    head |= (body >= 0xE3) & (body <= 0xE9)  # kana and ideographs stand without blanks: each counts
    heads = np.concatenate(([0], np.cumsum(head)))
    return start, end, heads[end] - heads[start], np.searchsorted(start, offsets)


def spans(words: np.ndarray, first: np.ndarray, run: int, least_words: int):
    """For each sentence the end (exclusive) of its span, or -1 where the row ends before."""
    n = len(words)
    stop = np.repeat(first[1:], np.diff(first))
    total = np.concatenate(([0], np.cumsum(words)))
    need = np.searchsorted(total, total[:-1] + least_words, side="left")
    end = np.maximum(np.arange(n) + run, need)
    return np.where(end <= stop, end, -1)


def all_spans(words: np.ndarray, first: np.ndarray, run: int, least_words: int, few_words: int, long_words: int):
    """(starts, ends): ``spans``, the runs of fewer sentences with ``few_words`` words, and runs up to a
    sentence where they are needed so that the spans inside any run of ``long_words`` words cover it whole."""
    n = len(words)
    low, stop = (np.repeat(x, np.diff(first)) for x in (first[:-1], first[1:]))
    end = spans(words, first, run, least_words)
    total = np.concatenate(([0], np.cumsum(words)))
    ahead = np.searchsorted(total, total[:-1] + few_words, side="left")
    a, b = np.flatnonzero(end >= 0), np.flatnonzero((ahead <= stop) & ((end < 0) | (ahead < end)))
    # the last start of a span that ends at a sentence: no span up to there is needed besides
    last = np.full(n + 1, -1)
    np.maximum.at(last, end[a], a)
    np.maximum.at(last, ahead[b], b)
    back = np.searchsorted(total, total[1:] - long_words, side="right") - 1
    c = np.flatnonzero((back >= low) & (last[1:] < back))
    return np.concatenate((a, b, back[c])), np.concatenate((end[a], ahead[b], c + 1))


def _span_rows(run_length: int, *least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            parts = []
            for lo, hi in X.slices(off, 1 << 20):
                b, o = body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                start, end, words, first = sentences(b, o)
                at, to = all_spans(words, first, run_length, *least)
                if not len(at):
                    continue
                one = X.span_hash(X.prefix_hash(b), start, end)
                hashes = []
                for h in (one, X.mix64(one ^ _SALT)):
                    p = np.zeros(len(h) + 1, np.uint64)
                    pw, inv = X.powers(len(h) + 1)
                    np.cumsum(h * pw[: len(h)], out=p[1:])
                    hashes.append(X.mix64((p[to] - p[at]) * inv[at]))
                row = np.searchsorted(first, at, side="right") - 1
                parts.append((row + lo, at - first[row], to - at, *hashes))
            if not parts:
                continue
            row, at, size, h1, h2 = (np.concatenate(x) for x in zip(*parts))
            doc = batch.column("doc_id").take(pa.array(row))
            ids = doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((at, tags, ids, h2, h1))
            a, b = order[:-1], order[1:]
            new = np.ones(len(row), bool)
            new[1:] = (h1[a] != h1[b]) | (h2[a] != h2[b])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
            # a repeated row's same place is no repeat, and says nothing new
            other = (ids[order] != ids[lead]) | (tags[order] != tags[lead]) | (at[order] != at[lead])
            order, again = order[new | other], other[new | other]
            row, at, size, h1, h2, doc = row[order], at[order], size[order], h1[order], h2[order], doc.take(pa.array(order))
            h1 = np.where(again, X.mix64(h1 + np.arange(len(row), dtype=np.uint64)), h1)
            yield pa.RecordBatch.from_arrays(
                [doc, batch.column("tag").take(pa.array(row)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array((at << 24 | size << 1 | again))], names=["doc_id", "tag", "h1", "h2", "span"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        whole, offsets = X.flat(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        for r0, r1 in X.slices(offsets, 1 << 20):
            body, off = whole[offsets[r0] : offsets[r1]], offsets[r0 : r1 + 1] - offsets[r0]
            start, _, _, first = sentences(body, off)
            data = body.tobytes()
            out: list[list] = [[], [], [], [], []]
            for k, found in enumerate(spans[r0:r1]):
                n = int(first[k + 1] - first[k])
                gone = np.zeros(n, bool)
                for s in found or ():
                    gone[s >> 24 : (s >> 24) + ((s >> 1) & 0x7FFFFF)] = True
                lo, hi = int(off[k]), int(off[k + 1])
                # a removed sentence goes with the blanks behind it
                begins = np.append(start[first[k] : first[k + 1]], hi)
                kept = [data[lo : begins[0]]] + [data[begins[i] : begins[i + 1]] for i in range(n) if not gone[i]]
                text = b"".join(kept)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                for col, v in zip(out, (n, int(gone.sum()), hi - lo - len(text), [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])], text.decode())):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), kind, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r0, r1 - r0), *(pa.array(c, t) for c, t in zip(out, types))], names=["doc_id", "n_sentences", "n_removed", "n_bytes_removed", "removed", "kept"])


def remove_repeated_spans(docs: DataFrame, run: int = 3, least_words: int = 16, few_words: int = 30, long_words: int = 51) -> DataFrame:
    """Per row: doc_id, n_sentences, n_removed, n_bytes_removed, removed (sentence spans), kept (text).

    Null text counts as empty.  The order of documents is (doc_id, a hash of the text), a null id
    first.  Rows that repeat both are one document and come out alike, as often as they came in.  An
    empty table gives an empty one, very long texts are split into sentences whole, and columns besides
    doc_id and text are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.mapInArrow(_span_rows(run, least_words, few_words, long_words), "doc_id long, tag long, h1 long, h2 long, span long")
    found = found.withColumn("least", F.min(F.struct("doc_id", "tag", F.shiftright("span", 24))).over(W.partitionBy("h1", "h2")))
    first = F.struct("doc_id", "tag", F.shiftright("span", 24)).eqNullSafe(F.col("least"))
    found = found.where((F.col("span").bitwiseAND(1) == 1) | ~first)
    found = staged(found.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans")), "repeated-spans")
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.tag") == F.col("b.tag")]
    joined = docs.alias("a").join(found.alias("b"), same, "left").select("a.doc_id", "a.text", "b.spans")
    return joined.mapInArrow(_apply, "doc_id long, n_sentences long, n_removed long, n_bytes_removed long, removed array<struct<lo:int,hi:int>>, kept string")

