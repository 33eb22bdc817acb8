"""Operator 7: best-fit packing of tokenised documents into fixed-length sequences.

1. ``pieces``: token ids of every document plus the end id; only documents longer than the
   capacity are cut.  Tokenising works on distinct words: a word's ids do not depend on its
   neighbours, so they are kept per worker; texts outside the plain alphabet go to the library whole.
2. Documents are ordered by (length, rank).  A length that holds a third of all rows is ranked in
   parts, each counted first and numbered on its own.
3. Best fit on the counts of each length, longest first: all documents of a length take the gaps from
   their own size upwards, ranks decide who takes which, filled sequences return to the gaps with
   what is left, and what found no gap opens sequences.  This deals in runs of equal gaps and reads
   ``capacity`` numbers at most, whatever the number of documents, so it is a loop on the driver.
4. Every document finds its run by (length, rank) in the dealt table.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import staged

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 0
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_KIND[0x80:] = 1
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 2
_ODD = np.zeros(256, bool)  # bytes outside ASCII text and the letters U+00C0..U+00FF
_ODD[:0x20] = True
_ODD[9:14] = False
_ODD[0x7F] = _ODD[0xC2] = True
_ODD[0xC4:] = True
_CUT = np.zeros(256, bool)  # what may follow an apostrophe in a contraction
_CUT[np.frombuffer(b"strvmldSTRVMLD", np.uint8)] = True


#: What the split by byte classes stands for.  A tokenizer file with other rules gets every text whole.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Words:
    """Ids of words seen by this worker, found by 64-bit hash; emptied at ``LIMIT`` words between slices."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        #: whether a text's words can be told apart by bytes, and their ids do not depend on their neighbours
        self.by_word = all(rules.get(k) == v for k, v in RULES.items()) and all(x["content"].startswith("<|") for x in rules["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = self.encode(words)
        have = len(self.at) - 1
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        merged = np.concatenate((self.keys, keys))
        slot = np.concatenate((self.slot, np.arange(have, have + len(keys))))
        order = np.argsort(merged, kind="stable")
        self.keys, self.slot = merged[order], slot[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        p = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[p] == keys, self.slot[p], -1)


_LOADED: dict[str, Words] = {}


def plain_rows(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows for which words can be found by byte classes alone."""
    odd = _ODD[body]
    if len(body) > 1:
        odd[:-1] |= (body[:-1] == 0x27) & _CUT[body[1:]]
        odd[:-1] |= (body[:-1] == 0x3C) & (body[1:] == 0x7C)
        odd[1:] |= (body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7))
    total = np.concatenate(([0], np.cumsum(odd)))
    return total[offsets[1:]] == total[offsets[:-1]]


def token_ids(words: Words, body: np.ndarray, offsets: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows end to end, row offsets)."""
    plain = plain_rows(body, offsets) if words.by_word else np.zeros(len(offsets) - 1, bool)
    if len(words.keys) > words.LIMIT:
        words.clear()
    low = X.lower_ascii(body)
    if len(low) > 1:
        up = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low[1:][up] += 32
    kind = _KIND[low]
    change = np.ones(len(low) + 1, bool)
    if len(low):
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    change[offsets] = True
    edge = np.flatnonzero(change)
    keep = kind[edge[:-1]] != 0 if len(edge) > 1 else np.zeros(0, bool)
    start, end = edge[:-1][keep], edge[1:][keep]
    row = np.searchsorted(offsets, start, side="right") - 1
    use = plain[row]
    start, end, row = start[use], end[use], row[use]
    code, unique = pd.factorize(X.span_hash(X.prefix_hash(low), start, end))
    unique = np.asarray(unique, np.uint64)
    slot = words.find(unique)
    if (miss := np.flatnonzero(slot < 0)).size:
        seen = np.zeros(len(unique), np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]
        data = low.tobytes()
        words.learn(unique[miss], [data[start[i] : end[i]].decode() for i in seen[miss]])
        slot = words.find(unique)
    tok = slot[code]
    size = words.at[tok + 1] - words.at[tok]
    total = np.concatenate(([0], np.cumsum(size)))
    flat = words.ids[np.repeat(words.at[tok] - total[:-1], size) + np.arange(total[-1])]
    count = np.bincount(row, size, len(offsets) - 1).astype(np.int64)
    whole = np.flatnonzero(~plain)
    if not len(whole):
        return flat, np.concatenate(([0], np.cumsum(count)))
    other = dict(zip(whole.tolist(), words.encode([texts[int(r)].as_py() for r in whole])))
    at = np.concatenate(([0], np.cumsum(count)))
    parts = [np.array(other[r], np.uint32) if r in other else flat[at[r] : at[r + 1]] for r in range(len(count))]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _LOADED.get(path) or _LOADED.setdefault(path, Words(path))
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            for lo, hi in X.slices(off, 1 << 20):
                ids, at = token_ids(words, body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], batch.column("text").slice(lo, hi - lo))
                out: list[list] = [[], [], [], [], [], []]
                for k in range(hi - lo):
                    doc = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, p in enumerate(range(0, len(doc), capacity)):
                        part = doc[p : p + capacity]
                        for col, v in zip(out, (lo + k, piece, p, len(part), zlib.crc32(part.tobytes()), part if keep_ids else None)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()),
                     pa.array(out[5], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless ``keep_ids``).

    Null text counts as empty and gives the end id alone.  Rows that repeat id and text give the same
    pieces as often as they come in; a very long text is tokenised whole and cut afterwards.  An empty
    table gives an empty one; columns besides doc_id and text are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>")


def deal(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over lengths: (length, first rank, how many, first sequence, offset) of every run."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes that have runs
    free: dict[int, list[tuple[int, int]]] = {}  # size -> runs of (first sequence, how many)
    opened = 0

    def give(size: int, first: int, many: int) -> None:
        if size and many:
            if size not in free:
                bisect.insort(gaps, size)
                free[size] = []
            free[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                many = -(-left // (capacity // length))
                give(capacity, opened, many)
                opened += many
                continue
            size = gaps[at]
            first, many = free[size].pop()
            if not free[size]:
                del free[size], gaps[at]
            take = min(many, left)
            give(size, first + take, many - take)
            runs.append((length, rank, take, first, capacity - size))
            give(size - length, first, take)
            rank, left = rank + take, left - take
    return runs


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, offset = table.value
        key = (length << 44) | rank
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank")}
            p = np.searchsorted(key, (cols["length"] << 44) | cols["rank"], side="right") - 1
            seq = first[p] + cols["rank"] - rank[p] if batch.num_rows else np.zeros(0, np.int64)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq), pa.array(offset[p] if batch.num_rows else seq)], names=[*names, "sequence_id", "offset"])

    return run


def pack(found: DataFrame, capacity: int = 4096, salt_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` rows; every row gets a place of its own, repeated or not.

    Pieces of one length are numbered in parts of about ``salt_rows`` rows of all lengths, dealt by a hash.
    """
    found = staged(found, "pieces")
    spark = found.sparkSession
    salt = max(1, -(-found.count() // salt_rows))
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)).cast("int"))
    counts = staged(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = found.withColumn("k", number).join(before, ["length", "part"]).withColumn("rank", (F.col("k") + F.col("before")).cast("long"))
    totals = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    runs = sorted(deal(totals, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5).T if runs else np.zeros((5, 0), np.int64)
    shared = spark.sparkContext.broadcast((table[0], table[1], table[3], table[4]))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank").mapInArrow(_place(shared), out)
