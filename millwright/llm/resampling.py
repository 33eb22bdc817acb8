"""Operator 12: importance resampling of documents towards a target's n-gram distribution.

Features are runs of one to three consecutive words; a feature's bucket is the CRC of its bytes modulo
``BUCKETS``.  CRCs are joined by state: that of "a b" follows from those of "a" and "b" and the length of
"b", so a batch's features cost a few table look-ups each.  Words split into head and tail: for the head,
all words that make up at least ``share`` of the words of some batch, the CRC states are computed once and
broadcast under their exact bytes, and so are the buckets of the head's frequent pairs; every other word,
and every other run, takes its CRC directly.  Which words are in the head changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import staged

BUCKETS = 10_000
#: Separators are the ASCII characters that are neither digits nor letters; upper case is lowered before.
WORD = X.class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_CRC = np.array([zlib.crc32(bytes([k]), 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(256)], np.uint32)  # table of one byte's step
SHORT = 48  # bytes of a word up to which whole batches are stepped byte by byte
HEAD_BYTES = 16  # bytes of a head word: two numbers hold it exactly


def _steps() -> np.ndarray:
    """[n, place, byte]: the CRC state with that byte at that place alone, after n zero bytes, up to SHORT + 1."""
    out = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, SHORT + 2):
        before = out[n - 1]
        out[n] = _CRC[before & np.uint32(0xFF)] ^ (before >> np.uint32(8))
    return out


SHIFT = _steps().reshape(-1)
_BLANK = zlib.crc32(b" ")


def shift(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states as they are n bytes on; n of SHORT + 1 at most."""
    at = n * 1024
    low, byte = state.view(np.uint8).reshape(-1, 4).T, lambda x: x.astype(np.int64)  # little-endian
    return SHIFT[at + byte(low[0])] ^ SHIFT[at + 256 + byte(low[1])] ^ SHIFT[at + 512 + byte(low[2])] ^ SHIFT[at + 768 + byte(low[3])]


def direct_crc(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC of every word, byte by byte for all words at once; long words one by one."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    todo = np.argsort(-size, kind="stable")
    n_long = int((size > SHORT).sum())
    for k in todo[:n_long]:
        out[k] = zlib.crc32(body[start[k] : end[k]].tobytes()) ^ 0xFFFFFFFF
    todo = todo[n_long:]
    left = np.searchsorted(-size[todo], -np.arange(SHORT + 1), side="left")  # words longer than k bytes
    at, state = start[todo], out[todo]
    for k in range(SHORT):
        m = left[k]
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ body[at[:m] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[todo] = state
    return out ^ np.uint32(0xFFFFFFFF)


def packed(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of words of HEAD_BYTES at most, as numbers; no word holds a 0 byte."""
    wide = np.append(body, np.zeros(HEAD_BYTES, np.uint8))
    eight = np.lib.stride_tricks.as_strided(wide, (len(wide) - 7, 8), (1, 1))
    mask = (np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1)
    mask = np.append(mask, np.uint64(0xFFFFFFFFFFFFFFFF))
    lo = np.ascontiguousarray(eight[start]).view(np.uint64).ravel() & mask[np.minimum(size, 8)]
    hi = np.ascontiguousarray(eight[np.minimum(start + 8, len(wide) - 8)]).view(np.uint64).ravel() & mask[np.clip(size - 8, 0, 8)]
    return lo, hi


class Table:
    """Exact look-up of pairs of numbers in numpy: a slot for each key, the next one where it is taken."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.bits = np.uint64((1 << max(4, (4 * len(a)).bit_length())) - 1)
        self.place = np.full(int(self.bits) + 1, -1, np.int32)
        self.a, self.b = a.astype(np.uint64), b.astype(np.uint64)
        at, todo, self.probes = self._slot(self.a, self.b), np.arange(len(a)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.place[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.place[at[won]] = won
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & int(self.bits)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (X.mix64(a * X.BASE + b) & self.bits).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        at = self._slot(a, b)
        for _ in range(self.probes):
            k = self.place[at]
            hit = (k >= 0) & (self.a[k] == a[todo]) & (self.b[k] == b[todo]) if len(self.a) else k >= 0
            out[todo[hit]] = k[hit]
            more = ~hit & (k >= 0)
            todo, at = todo[more], (at[more] + 1) & int(self.bits)
            if not len(todo):
                break
        return out


class Head:
    """Frequent words with their CRC states and frequent pairs of them with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[int, int]] = ()):
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        body = np.frombuffer(b"".join(words), np.uint8)
        self.state = direct_crc(body, start, start + size) if words else np.zeros(0, np.uint32)
        self.words = Table(*packed(body, start, size)) if words else Table(np.zeros(0), np.zeros(0))
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        self.pairs = Table(a, b)
        crc = join(self.state[a], self.state[b], size[b]) if len(a) else np.zeros(0, np.uint32)
        self.pair_bucket = (crc % np.uint32(BUCKETS)).astype(np.int64)


def join(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of "a b" from those of "a" and "b" and the bytes of "b"; SHORT bytes at most."""
    return shift(a, size + 1) ^ shift(np.full(len(b), _BLANK, np.uint32), size) ^ b


def _words(body: np.ndarray, offsets: np.ndarray):
    body = X.lower_ascii(body)
    return body, *X.word_spans(body, offsets, WORD)


def places(body: np.ndarray, start: np.ndarray, end: np.ndarray, head: Head) -> np.ndarray:
    """Place of each word in the head, or -1."""
    size, out = end - start, np.full(len(start), -1, np.int64)
    some = np.flatnonzero(size <= HEAD_BYTES)
    if len(some) and len(head.state):
        out[some] = head.words.find(*packed(body, start[some], size[some]))
    return out


def buckets(body: np.ndarray, offsets: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each): of all runs of one, two and three words of each text."""
    body, start, end, first = _words(body, offsets)
    n = len(start)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place, size = places(body, start, end, head), end - start
    crc = np.empty(n, np.uint32)
    known = place >= 0
    crc[known] = head.state[place[known]]
    crc[~known] = direct_crc(body, start[~known], end[~known])
    out, rows = [crc % np.uint32(BUCKETS)], [row]
    run, of, last = crc, row, np.arange(n)  # CRC of each run, its text, its last word
    for length in (2, 3):
        keep = np.flatnonzero(last + 1 < n)
        keep = keep[row[last[keep] + 1] == of[keep]]
        b = last[keep] + 1
        short = size[b] <= SHORT
        new = np.empty(len(keep), np.uint32)
        new[short] = join(run[keep][short], crc[b[short]], size[b[short]])
        for k in np.flatnonzero(~short):
            new[k] = zlib.crc32(b" " + body[start[b[k]] : end[b[k]]].tobytes(), int(run[keep[k]]))
        found = new % np.uint32(BUCKETS)
        if length == 2 and len(head.pair_bucket):
            both = np.flatnonzero(known[last[keep]] & known[b])
            pair = head.pairs.find(place[last[keep[both]]].astype(np.uint64), place[b[both]].astype(np.uint64))
            found[both[pair >= 0]] = head.pair_bucket[pair[pair >= 0]]
        run, of, last = new, of[keep], b
        out.append(found)
        rows.append(of)
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


SLICE = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE):
    for batch in batches:
        body, off = X.flat(batch.column("text"))
        for lo, hi in X.slices(off, size):
            yield batch.slice(lo, hi - lo), body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _frequent_words(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, off in _slices(batches, 8 * SLICE):
            body, start, end, _ = _words(body, off)
            size = end - start
            least = max(2, share * len(start))
            some = np.flatnonzero(size <= HEAD_BYTES)
            key = np.stack(packed(body, start[some], size[some]), 1) if len(some) else np.zeros((0, 2), np.uint64)
            order = np.argsort(X.mix64(key[:, 0] * X.BASE + key[:, 1]), kind="stable")  # equal words stand together, but for chance
            key = key[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)) if len(key) else [])
            count = np.diff(np.append(new, len(key)))
            often = np.flatnonzero(count >= least)
            at = some[order[new[often]]]
            words = [body[start[k] : end[k]].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*count[often].tolist(), len(start)], pa.int64())], names=["word", "n"])

    return run


def _frequent_pairs(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for _, body, off in _slices(batches, 8 * SLICE):
            body, start, end, first = _words(body, off)
            place = places(body, start, end, head)
            inside = np.ones(len(start), bool)
            inside[first[1:][first[1:] > 0] - 1] = False
            at = np.flatnonzero(inside & (place >= 0))
            at = at[place[at + 1] >= 0]
            key, count = np.unique(place[at] << 32 | place[at + 1], return_counts=True)
            often = count >= max(2, share * len(start))
            yield pa.RecordBatch.from_arrays([pa.array([*key[often].tolist(), None], pa.int64()), pa.array([*count[often].tolist(), len(start)], pa.int64())], names=["pair", "n"])

    return run


def _most(found: DataFrame, key: str, bound: int, name: str) -> list:
    """Keys with half of 1 / ``bound`` of all words at least, so 2 * ``bound`` at most; a null key holds the number of words."""
    counts = staged(found.groupBy(key).agg(F.sum("n").alias("n")), name)
    total = counts.where(F.col(key).isNull()).agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("n") * (2 * bound) >= total)).select(key).orderBy(key).collect()]


def head(texts: DataFrame, words: int = 40_000, pairs: int = 100_000) -> Head:
    """Words that make up 1 / ``words`` of all words, and pairs of them that make up 1 / ``pairs``; twice as many
    of each are broadcast at most.

    Such a word makes up that share of some slice of 8 MB too, so each slice sends on those only and their
    counts are added up; what slices without it hold is missing, so half the share is asked for."""
    top = [bytes(w) for w in _most(texts.mapInArrow(_frequent_words(1 / words), "word binary, n long"), "word", words, "head-words")]
    shared = texts.sparkSession.sparkContext.broadcast(Head(top))
    both = _most(texts.mapInArrow(_frequent_pairs(shared, 1 / pairs), "pair long, n long"), "pair", pairs, "head-pairs")
    return Head(top, [(p >> 32, p & 0xFFFFFFFF) for p in both])


def _totals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, body, off in _slices(batches):
            total += np.bincount(buckets(body, off, shared.value)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, shared) -> DataFrame:
    """(bucket, n): features of all texts in each bucket, those of each partition added up first."""
    return texts.mapInArrow(_totals(shared), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _weights(shared, gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, body, off in _slices(batches):
            found, row = buckets(body, off, shared.value)
            n = np.bincount(row, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            order = np.argsort(row, kind="stable")
            total = np.append(0, np.cumsum(gains.value[found[order]]))
            weight = np.diff(total[np.append(0, np.cumsum(n))])
            _, _, _, first = _words(body, off)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.diff(first)), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket from the two tables of bucket totals; both have BUCKETS rows at most."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for out, rows in ((s, documents), (t, target)):
        for bucket, n in rows.collect():
            out[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank (null where it isn't drawn).

    ``percent`` of the rows with ``least_words`` words, rounded down, are drawn without putting back: those with
    the highest weight plus Gumbel noise from a hash of the seed and the id; ties go to the smaller id, a null
    id (hashed as empty) first.  Null and empty texts have no words, weight 0 and are never drawn; very long
    texts are read whole.  Rows that repeat count each and are drawn each; rows that agree in score and id
    stand next to each other in either order.  Without a target text every gain comes from the documents
    alone; an empty table gives an empty one.  Columns besides doc_id and text are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = target.select(F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(head(texts.select("text")))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(texts.select("text"), shared), bucket_totals(wanted, shared)))
    rows = staged(texts.mapInArrow(_weights(shared, gain), "doc_id long, n_features long, n_words long, weight long"), "weights")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    # ranges of falling score; the place within a range is the low part of the increasing id
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = staged(ranged.select("doc_id", "n_features", "weight", "score", "fit", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "ranged")
    sizes = ranged.groupBy("part").agg(F.count_if("fit").alias("n")).orderBy("part").collect()  # a row for each partition
    before, so_far = [], 0
    for part, n in sizes:
        before.append((part, so_far))
        so_far += n
    drawn = percent * so_far // 100
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))  # a row for each partition
    rank = F.col("before") + F.col("place") + 1
    return ranged.join(offsets, "part", "left").select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
