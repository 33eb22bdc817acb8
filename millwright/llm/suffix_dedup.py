"""Operator 1: removal of repeated byte strings with suffix arrays.

A byte is removed when a ``length``-byte string covering it also starts earlier (in a document
with a smaller id, or earlier in the same one), judged on the input.

1. Whole-text copies collapse to the copy with the smallest id.  An equal string in a copy also
   occurs in that first copy, so nothing is lost; later copies are removed whole.
2. *Anchors* deal suffixes out to shards.  Each ``length``-byte window is owned by the smallest
   hashed 32-byte gram in it (leftmost of equal hashes), a function of the window's bytes alone, so equal
   windows have equal anchors at equal offsets and meet in one shard.  A gram hash that occurs
   once in the corpus owns no repeated window.  Hot grams are counted per Arrow batch first: a
   batch sends one witness per gram and knows by itself that its other copies repeat.
3. For repeated anchors the context of the owned windows is sent to the anchor's shard, equal
   contexts aggregated to their first place on the way.  A shard of too many contexts is split by the
   bytes next to the anchor, again and again if need be, so that no gram is one task's alone.
4. In a shard the strings enter one suffix array, built by linear grouping (see ``suffix_array``);
   runs with a common prefix of ``length`` or more are the classes of equal windows, and the
   earliest place in each class is kept.
5. Shards report only *first* windows; every other window of a repeated anchor is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import Scratch, staged

GRAM = 32
SLICE = 1 << 19


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of an integer string by linear grouping.

    Suffixes start in groups of equal first symbol.  Groups are taken in descending order; each
    suffix of the group looks for its previous smaller suffix (pointers to already passed suffixes
    are jumped over), and the suffixes found extend their Lyndon prefix by the group's, so they move
    to a new group just above their own.  The final groups hold suffixes of one Lyndon prefix
    each.  A left-to-right pass over the array then emits the order inside every group
    along the same pointers.  No string is renamed and nothing recurses.
    """
    n = len(text) + 1
    low = min(text, default=0)
    s = [c - low + 1 for c in text]
    s.append(0)
    sigma = max(s) + 1
    count = [0] * (sigma + 1)
    for c in s:
        count[c + 1] += 1
    for c in range(sigma):
        count[c + 1] += count[c]
    # order: suffixes by group; where: their place; head/size: of the group, by its first place
    order, where, head = [0] * n, [0] * n, [0] * n
    fill = count[:]
    for i, c in enumerate(s):
        p = fill[c]
        fill[c] = p + 1
        order[p] = i
        where[i] = p
        head[i] = count[c]
    size = [0] * n
    for c in range(sigma):
        if count[c + 1] > count[c]:
            size[count[c]] = count[c + 1] - count[c]
    prev = [-1] * n
    end = n
    while end > 0:
        start = head[order[end - 1]]
        group = order[start:end]
        found: dict[int, int] = {}
        for i in group:
            # groups below `start` are still open, so a smaller head means a smaller suffix; suffixes
            # above are jumped over by their own pointers; one of this group stops the walk
            j = i - 1
            while j >= 0 and head[j] > start:
                j = prev[j]
            prev[i] = j
        for i in group:
            # chains inside the group end where their first suffix does
            chain, j = [i], prev[i]
            while j >= 0 and head[j] == start:
                chain.append(j)
                j = prev[j]
            for k in chain:
                prev[k] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if found:
            # suffixes reached more often extend by more copies of this Lyndon prefix: larger first
            most = max(found.values())
            rounds: list[list[int]] = [[] for _ in range(most + 1)]
            for j, k in found.items():
                rounds[k].append(j)
            for k in range(most, 0, -1):
                moved = rounds[k]
                touched: dict[int, int] = {}
                for j in moved:
                    g = head[j]
                    last = g + size[g] - 1
                    p = where[j]
                    other = order[last]
                    order[p], where[other] = other, p
                    order[last], where[j] = j, last
                    size[g] -= 1
                    touched[g] = touched.get(g, 0) + 1
                for g, m in touched.items():
                    at = g + size[g]
                    size[at] = m
                    for p in range(at, at + m):
                        head[order[p]] = at
        end = start
    sa = [-1] * n
    sa[0] = n - 1
    nxt = {}
    placed = bytearray(n)
    placed[n - 1] = 1
    for r in range(n):
        j = sa[r] - 1
        while j >= 0 and not placed[j]:
            g = head[j]
            p = nxt.get(g, g)
            nxt[g] = p + 1
            sa[p] = j
            placed[j] = 1
            j = prev[j]
    return sa[1:]


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """Longest common prefix of each suffix with the one before it in ``sa``."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def anchors(body: np.ndarray, offsets: np.ndarray, length: int = 100):
    """(row, hash, anchor, first window start, number of windows) of every anchor in these rows.

    Which gram owns a window follows from the window's bytes alone, wherever it stands."""
    span = length - GRAM + 1
    n = len(body)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    prefix = X.prefix_hash(body)
    _, inv = X.powers(n + 1)
    gram = X.mix64((prefix[GRAM:] - prefix[:-GRAM]) * inv[: n - GRAM + 1])
    # the least hash of each window of grams, the leftmost of equals
    best, at = gram, np.arange(len(gram))
    width = 1
    while width < span:
        step = min(width, span - width)
        right = best[step:] < best[:-step]
        best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    sizes = np.diff(offsets)
    stop = np.repeat(offsets[1:], sizes)[: len(at)]
    start = np.flatnonzero(np.arange(length, length + len(at)) <= stop)
    if not len(start):
        return empty
    owner = at[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    lead = np.flatnonzero(cut)
    many = np.diff(np.append(lead, len(start)))
    owner, start = owner[lead], start[lead]
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, gram[owner], owner - offsets[row], start - offsets[row], many


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            parts = []
            for lo, hi in X.slices(off, SLICE):
                # a text longer than a slice goes in pieces that share the bytes of the windows between them
                for base in range(int(off[lo]), max(int(off[hi]) - length + 1, int(off[lo]) + 1), SLICE):
                    end = min(int(off[hi]), base + SLICE + length - 1)
                    own = np.clip(off[lo : hi + 1], base, end) - base
                    row, gram, at, start, many = anchors(body[base:end], own, length)
                    shift = base - off[lo] if hi == lo + 1 else 0
                    parts.append((row + lo, gram, at + shift, start + shift, many))
            row, gram, at, start, many = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
            if not len(row):
                continue
            order = np.argsort(gram, kind="stable")
            same = np.zeros(len(order), bool)
            sorted_gram = gram[order]
            same[1:] = sorted_gram[1:] == sorted_gram[:-1]
            again = np.zeros(len(order), bool)  # not the first here: known to repeat
            again[order] = same
            more = np.zeros(len(order), bool)
            more[:-1] = same[1:]
            known = again.copy()
            known[order] |= more
            key = np.where(again, X.mix64(np.arange(len(row), dtype=np.uint64)) ^ gram, gram)
            take = pa.array(row)
            tag = batch.column("tag").take(take).to_numpy(zero_copy_only=False)
            spot = (tag << 46) | (known.astype(np.int64) << 45) | ((at - start) << 38) | ((many - 1) << 31) | start
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), pa.array(key.view(np.int64)), pa.array(spot)], names=["doc", "key", "spot"])

    return run


#: ``spot`` packs, from the top: 17 bits tag, 1 bit known, 7 bits anchor - start, 7 bits windows - 1, 31 bits start.
_ANCHOR = "doc long, key long, spot long"
_TAG_BITS = 17


def unpack(spot: int) -> tuple[int, int, int]:
    """(start, anchor offset from it, windows)."""
    return spot & 0x7FFFFFFF, (spot >> 38) & 0x7F, ((spot >> 31) & 0x7F) + 1


def _key(common: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=bytes((lo, hi))).digest(), "little", signed=True)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=["gram", "lo", "hi", "context", "at", "doc_id", "doc", "tag", "start"])


_CONTEXT = "gram long, lo int, hi int, context binary, at int, doc_id long, doc long, tag long, start int"


def _context_rows(length: int):
    """One row for each repeated anchor: its gram hash, the owned windows' bytes and its place.

    ``lo`` and ``hi`` bound how many bytes of a window may stand left of the anchor in this shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            data = body.tobytes()
            out: list[tuple] = []
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "doc", "tag", "spots")]
            for base, doc_id, doc, tag, spots in zip(off.tolist(), *ids):
                for start, at, many in map(unpack, spots):
                    text = data[base + start : base + start + many + length - 1]
                    out.append((_key(text[at : at + GRAM], 0, length - GRAM), 0, length - GRAM, text, at, doc_id, doc, tag, start))
            yield _contexts(out)

    return run


def _split(length: int):
    """Contexts of shards that are too large, dealt to two shards each: windows with fewer and with more
    bytes left of the anchor.  The windows of half a shard have more bytes in common, and these name it;
    a shard of a single place holds equal windows only.  Equal windows stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, lo, hi, text, at, *place, start in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                half = (lo + hi) // 2
                for x, y in ((lo, half), (half + 1, hi)):
                    left, right = min(y, at), max(x, at - (len(text) - length))  # the most and the least bytes left of it
                    if right <= left:
                        cut = text[at - left : at - right + length]
                        out.append((_key(text[at - x : at - y + length], x, y), x, y, cut, left, *place, start + at - left))
            yield _contexts(out)

    return run


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def first_windows(contexts: list[tuple], length: int) -> list[tuple]:
    """Windows of one shard that occur nowhere earlier.

    ``contexts``: distinct (bytes, anchor offset, id, doc, tag, start) where bytes begin at window
    ``start``.  Returns (doc, tag, window start) runs as (doc, tag, from, to) with ``to`` exclusive.
    """
    firsts: list[tuple] = []
    if len(contexts) == 1:
        text, _, _, doc, tag, start = contexts[0]
        return [(doc, tag, start, start + len(text) - length + 1)]
    # what no other string of the shard shares around the anchor cannot repeat: it is first
    reach = [[0, 0] for _ in contexts]
    for side in (0, 1):
        parts = sorted((c[0][: c[1]][::-1] if side == 0 else c[0][c[1] :], k) for k, c in enumerate(contexts))
        for (a, i), (b, j) in zip(parts, parts[1:]):
            m = _shared(a, b)
            reach[i][side] = max(reach[i][side], m)
            reach[j][side] = max(reach[j][side], m)
    best: dict[tuple, tuple] = {}
    for (text, at, doc_id, doc, tag, start), (left, right) in zip(contexts, reach):
        windows = len(text) - length + 1
        lo, hi = max(0, at - left), min(windows, at + right - length + 1)
        if hi <= lo:
            firsts.append((doc, tag, start, start + windows))
            continue
        if lo:
            firsts.append((doc, tag, start, start + lo))
        if hi < windows:
            firsts.append((doc, tag, start + hi, start + windows))
        key = (at - lo, text[lo : hi + length - 1])
        place = (doc_id is not None, doc_id, doc, tag, start + lo)
        if key not in best or place < best[key]:
            best[key] = place
    if len(best) == 1:
        ((_, text), (*_, doc, tag, start)) = next(iter(best.items()))
        firsts.append((doc, tag, start, start + len(text) - length + 1))
        return firsts
    places = sorted(best.items(), key=lambda x: x[1])
    joined: list[int] = []
    owner: list[int] = []
    base: list[int] = []
    for k, ((_, text), _) in enumerate(places):
        base.append(len(joined))
        joined.extend(text)
        owner.extend([k] * len(text))
        joined.append(256 + k)  # separators differ, so no common prefix runs across strings
        owner.append(k)
    sa = suffix_array(joined)
    lcp = common_prefixes(joined, sa)
    kept: list[int] = []
    r, n = 0, len(sa)
    while r < n:
        e = r + 1
        while e < n and lcp[e] >= length:
            e += 1
        first = min(sa[r:e])  # strings stand in the order of their places
        if e - r > 1 or base[owner[first]] + len(places[owner[first]][0][1]) - first >= length:
            kept.append(first)
        r = e
    for i in sorted(kept):
        k = owner[i]
        if base[k] + len(places[k][0][1]) - i < length:
            continue
        *_, doc, tag, start = places[k][1]
        w = start + i - base[k]
        if firsts and firsts[-1][:2] == (doc, tag) and firsts[-1][3] == w:
            firsts[-1] = (doc, tag, firsts[-1][2], w + 1)
        else:
            firsts.append((doc, tag, w, w + 1))
    return firsts


def _shards(length: int):
    """Rows come sorted by gram, each shard's together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []

        def flush(out):
            out.extend(first_windows(held, length))

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("gram", "context", "at", "doc_id", "doc", "tag", "start")]
            for g, *rest in zip(*cols):
                if g != gram and held:
                    flush(out)
                    held = []
                gram = g
                held.append(tuple(rest))
            yield _firsts(out)
        if held:
            out = []
            flush(out)
            yield _firsts(out)

    return run


def _firsts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "tag", "lo", "hi"])


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            data = body.tobytes()
            removed, kept, spans = [], [], []
            for k, (spots, firsts) in enumerate(zip(batch.column("spots").to_pylist(), batch.column("firsts").to_pylist())):
                n = int(off[k + 1] - off[k])
                delta = np.zeros(n + 1, np.int32)
                window = np.zeros(n + 1, bool)
                for start, _, many in map(unpack, spots or ()):
                    window[start : start + many] = True
                for f in firsts or ():
                    window[f["lo"] : f["hi"]] = False
                hit = np.flatnonzero(window)
                np.add.at(delta, hit, 1)
                np.add.at(delta, np.minimum(hit + length, n), -1)
                gone = np.cumsum(delta[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                text = data[off[k] : off[k + 1]]
                keep = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed.append([{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(keep)
                spans.append(hashlib.sha256(keep).hexdigest())
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(spans, pa.string())], names=["doc", "tag", "removed", "kept", "kept_sha256"])

    return run


_APPLIED = "doc long, tag long, removed array<struct<lo:int,hi:int>>, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 100, keep_bytes: bool = True, shard_rows: int = 2000) -> DataFrame:
    """Per row: doc_id, n_bytes, removed (byte spans), kept (remaining bytes), kept_sha256.

    Null text counts as empty.  Rows that repeat both id and text are one document and come out alike,
    as often as they came in; different texts under one id are ordered by a hash; a null id sorts first.
    Extra columns of ``docs`` are ignored.  ``keep_bytes=False`` leaves ``kept`` null.  Shards of more
    than ``shard_rows`` distinct contexts are split.  An empty table gives an empty one; very long texts are
    compared whole, piece by piece.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a document is known by 81 bits of hash over its id and text
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64("text", F.lit(1), "doc_id").bitwiseAND((1 << _TAG_BITS) - 1).alias("tag"), "text")
    ids = docs.select("doc_id", "doc", "tag", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    ids = scratch.put(ids, "ids")
    own = F.struct("doc_id", "doc", "tag")
    lead = ids.groupBy("sha").agg(F.min(own).alias("lead"), F.max(own).alias("last")).where("lead <> last or lead.doc_id is null and last.doc_id is not null")
    marked = ids.join(lead, "sha", "left").withColumn("copy", F.col("lead").isNotNull() & ~own.eqNullSafe(F.col("lead"))).drop("lead", "last")
    marked = staged(marked, "copies")
    copies = marked.where("copy").select("doc", "tag")

    spot = docs.mapInArrow(_anchor_rows(length), _ANCHOR)
    spot = spot.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where((F.col("n") > 1) | (F.shiftright("spot", 45).bitwiseAND(1) == 1))
    spot = spot.select("doc", F.shiftright("spot", 46).alias("tag"), "spot")
    spots = spot.groupBy("doc", "tag").agg(F.sort_array(F.collect_set("spot")).alias("spots"))
    spots = scratch.put(spots.join(copies, ["doc", "tag"], "left_anti"), "spots")

    place = F.min(F.struct("doc_id", "doc", "tag", "start")).alias("p")

    def distinct(contexts: DataFrame) -> DataFrame:
        return contexts.groupBy("gram", "lo", "hi", "context", "at").agg(place).select("gram", "lo", "hi", "context", "at", "p.*")

    texts = docs.join(spots, ["doc", "tag"]).select("doc_id", "doc", "tag", "text", "spots")
    contexts = scratch.put(distinct(texts.mapInArrow(_context_rows(length), _CONTEXT)), "contexts")
    shards, depth = None, 0
    while (hot := contexts.groupBy("gram").count().where(F.col("count") > shard_rows).select("gram")).limit(1).count():
        hot = scratch.put(hot, f"hot-{depth}")
        # halves have names of their own, so shards that were left as they are need not be looked at again
        left = contexts.join(hot, "gram", "left_anti")
        shards = left if shards is None else shards.unionByName(left)
        contexts = scratch.put(distinct(contexts.join(hot, "gram", "left_semi").mapInArrow(_split(length), _CONTEXT)), f"split-{depth}")
        depth += 1
    shards = contexts if shards is None else shards.unionByName(contexts)
    firsts = shards.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shards(length), "doc long, tag long, lo int, hi int")
    firsts = scratch.put(firsts.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("firsts")), "firsts")
    scratch.drop("contexts", *(n for n in scratch.paths if n.startswith(("hot-", "split-"))))

    place = spots.join(firsts, ["doc", "tag"], "left")
    found = docs.join(place, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", "text", "spots", "firsts")
    done = found.mapInArrow(_apply(length), _APPLIED)
    done = staged(done if keep_bytes else done.drop("kept"), "repeats-removed")
    scratch.drop(*scratch.paths)
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi")))
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    out = marked.join(done, ["doc", "tag"], "left").select(
        "doc_id", "doc", "tag", "n_bytes", F.when(gone, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_bytes else []))
    if not keep_bytes:
        return out.drop("doc", "tag").withColumn("kept", F.lit(None).cast("binary"))
    # untouched texts come back as they are
    plain = docs.dropDuplicates(["doc", "tag"]).select("doc", "tag", F.col("text").cast("binary").alias("plain"))
    return out.join(plain, ["doc", "tag"]).select("doc_id", "n_bytes", "removed", "kept_sha256", F.coalesce("kept", "plain").alias("kept"))
