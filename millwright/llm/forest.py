"""Operator 3: near-duplicate documents by an LSH forest.

A document's set is its distinct word shingles (the whole sequence if it has fewer words).  Links
join sets with 100 * |A & B| >= percent * |A | B|, confirmed on the full sets.

1. Every set gets a min-hash signature; documents with equal sets collapse to the smallest id.
2. The forest holds ``TREES`` orders of the signatures: order t starts at value ``LEAST * t``.  The
   rows (order, values) are range-sorted; neighbours whose common prefix is ``LEAST`` values or
   more become candidates, and so does the first row of such a region.  Two sets of similarity s
   miss each other in all orders with probability (1 - s**5)**26: 3e-5 at 0.8, 2.4e-7 at 0.85, 2e-10 at 0.9.
3. Candidates are confirmed in rounds, and a pair already in one component is not looked at again:
   each document's best candidate (longest common prefixes in sum), then the other candidates, then
   each mixed region's members against its best-linked one.
4. Regions that still mix components go deeper: every row outside the region's main component is
   compared with all its rows by whole signatures, in blocks; the rows of pairs that agree within five
   standard deviations of the threshold are dealt out again with their texts, and links are confirmed
   inside the blocks, so that pairs never leave a task.  No partner is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm import textops as X
from millwright.llm.common import Scratch, staged
from millwright.llm.components import components

TREES, LEAST, DEEP = 26, 5, 5
VALUES = TREES * LEAST
BROADCAST_IDS = 1_000_000  # 16 MB
REGION_BLOCK, ASK_BLOCK = 1000, 2000  # rows, and open rows, of a region that one task compares
SEPARATORS = b" \t\n\x0b\x0c\r"
_WORD = X.class_table(SEPARATORS)
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_SPREAD = np.uint32(0x9E3779B1)
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 62, 16, dtype=np.uint64)]


def shingle_sets(body: np.ndarray, offsets: np.ndarray, size: int):
    """(distinct shingle hashes of all rows end to end, row offsets); sorted within each row."""
    body = X.lower_ascii(body)
    start, end, first = X.word_spans(body, offsets, _WORD)
    word = X.span_hash(X.prefix_hash(body), start, end)
    words = np.diff(first)
    many = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    out = np.zeros(int(many.sum()), np.uint64)
    at = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(many)), many)
    base = first[row] + (np.arange(len(out)) - at[row])
    left = np.minimum(words, size)[row]  # words in this shingle
    for k in range(size):
        use = left > k
        out[use] = X.mix64(out[use] * _MIX[k % 16] + word[base[use] + k])
    out = X.mix64(out + left.astype(np.uint64))
    parts, count = [], np.zeros(len(many), np.int64)
    for r in range(len(many)):
        u = np.unique(out[at[r] : at[r + 1]])
        parts.append(u)
        count[r] = len(u)
    return (np.concatenate(parts) if parts else out), np.concatenate(([0], np.cumsum(count)))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = X.flat(batch.column("text"))
            for lo, hi in X.slices(off, 1 << 20):
                sets, at = shingle_sets(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                n = np.diff(at)
                sig = np.zeros((len(n), VALUES), np.uint16)
                s1, s2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    lead = at[:-1][full]
                    x = (sets >> np.uint64(32)).astype(np.uint32)
                    for j in range(VALUES):
                        # the least value's mixed upper half tells it well enough, as links are confirmed
                        sig[full, j] = (np.minimum.reduceat(x * _MUL[j] + _ADD[j], lead) * _SPREAD) >> np.uint32(16)
                    s1[full] = np.add.reduceat(X.mix64(sets ^ _MIX[3]), lead).view(np.int64)
                    s2[full] = np.add.reduceat(X.mix64(sets + _MIX[4]), lead).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tag")), pa.array(n), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in sig.astype(">u2")], pa.binary())],
                    names=["doc_id", "tag", "n", "s1", "s2", "sig"])

    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, VALUES)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each order, its key in two numbers: 1 byte order, the head (LEAST values of 2 bytes)
    and the lower bytes of DEEP more values."""
    for batch in batches:
        sig = _signs(batch.column("sig"))
        for t in range(TREES):
            values = np.roll(sig, -LEAST * t, axis=1)[:, : LEAST + DEEP]
            head = np.ascontiguousarray(values[:, :LEAST]).view(np.uint8).reshape(len(sig), 2 * LEAST)
            key = np.hstack((np.full((len(sig), 1), t, np.uint8), head, (values[:, LEAST:] & 0xFF).astype(np.uint8)))
            key = np.ascontiguousarray(key).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), batch.column("doc_id")], names=["k1", "k2", "doc_id"])


_TAIL = np.int64(8 * DEEP)  # bits of k2 behind the head


def _region(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Number of the region: the order in the 5 bits below the sign, then a hash of the head."""
    head = X.mix64(X.mix64(k1.view(np.uint64)) + (k2 >> _TAIL).view(np.uint64))
    return ((k1 >> np.int64(56)) << np.int64(58)) | (head >> np.uint64(6)).view(np.int64)


def _depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix in values, at least LEAST as the heads are equal."""
    x = (a ^ b) & np.int64((1 << int(_TAIL)) - 1)
    return LEAST + DEEP - np.searchsorted(np.array([1 << 8 * k for k in range(DEEP)], np.int64), x, side="right")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; candidate pairs (kind 0), region members (1) and partition ends (2, 3) out.

    A row is paired with the row before it and with the first row of its region."""
    part = TaskContext.get().partitionId()
    rows = np.zeros((3, 0), np.int64)  # first row of the open region and the last row so far
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        old = rows.shape[1]
        rows = np.hstack((rows, np.array([batch.column(c).to_numpy() for c in ("k1", "k2", "doc_id")])))
        k1, k2, doc = rows
        if first is None:
            first = rows[:, 0]
        new = np.ones(len(doc), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] >> _TAIL != k2[:-1] >> _TAIL)
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        at = np.flatnonzero(~new)
        at = at[at >= old]
        a, b = np.concatenate((at - 1, head[at])), np.concatenate((at, at))
        use = doc[a] != doc[b]
        use[len(at) :] &= doc[head[at]] != doc[at - 1]
        a, b = a[use], b[use]
        yield _found(0, np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), _depth(k2[a], k2[b]))
        held = np.union1d(at, head[at])
        yield _found(1, _region(k1[held], k2[held]), doc[held])
        rows = rows[:, [head[-1], -1]]
    if first is not None:
        # the outer rows' regions may run on in other partitions, so they are members in any case
        ends = np.array([first, rows[:, -1]]).T
        yield _found(1, _region(ends[0], ends[1]), ends[2])
        for kind, (k1, k2, doc) in zip((2, 3), ends.T):
            yield _found(kind, np.array([part]), np.array([doc]), np.zeros(1, np.int64), np.array([k1]), np.array([k2]))


def _found(kind: int, a: np.ndarray, b: np.ndarray, depth=None, k1=None, k2=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b), *(pa.array(zero if x is None else x.astype(np.int64)) for x in (depth, k1, k2))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "depth", "k1", "k2"])


_FOUND = "kind int, a long, b long, depth long, k1 long, k2 long"


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ba, fa), (bb, fb) = (X.flat(batch.column(name)) for name in ("ta", "tb"))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in X.slices(fa + fb, 1 << 20):
                xa, oa = shingle_sets(ba[fa[lo] : fa[hi]], fa[lo : hi + 1] - fa[lo], size)
                xb, ob = shingle_sets(bb[fb[lo] : fb[hi]], fb[lo : hi + 1] - fb[lo], size)
                for r in range(hi - lo):
                    keep[lo + r] = _linked(xa[oa[r] : oa[r + 1]], xb[ob[r] : ob[r + 1]], percent)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _close(percent: int, size: int = 0):
    """Blocks of a region come sorted, open rows first.  An open row and a row of another component are
    close if their signatures agree often enough (five deviations below the threshold); such a pair
    belongs to the first order whose head they share.  Without ``size`` the rows of close pairs come
    out; with it their sets are compared, and one link for each open row and component comes out."""
    p = percent / 100
    least = VALUES * (p - 5 * (p * (1 - p) / VALUES) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asks, tables, tree, linked = None, [], None, -1, set()
        for batch in batches:
            out: set[tuple] = set()
            sig = _signs(batch.column("sig"))
            sets: list = [None] * batch.num_rows
            if size:
                body, off = X.flat(batch.column("text"))
                for lo, hi in X.slices(off, 1 << 20):
                    x, at = shingle_sets(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                    sets[lo:hi] = [x[at[r] : at[r + 1]] for r in range(hi - lo)]
            cols = [batch.column(c).to_pylist() for c in ("region", "block", "part", "ask", "doc_id", "label")]
            for k, (region, *place, ask, doc, label) in enumerate(zip(*cols)):
                if (region, place) != block:
                    block, asks, tables, tree, linked = (region, place), [], None, region >> 58, set()
                if ask:
                    asks.append((doc, label, sig[k], sets[k]))
                    continue
                if not asks:
                    continue
                if tables is None:
                    tables = np.array([a[1] for a in asks]), np.array([a[2] for a in asks])
                same = tables[1] == sig[k]
                near = np.flatnonzero((tables[0] != label) & (same.sum(axis=1) >= least))
                near = near[same[near].reshape(len(near), TREES, LEAST).all(axis=2).argmax(axis=1) == tree] if len(near) else near
                for i in near.tolist():
                    other = asks[i][0]
                    if not size:
                        out.update(((region, doc, False), (region, other, True)))
                    elif (i, label) not in linked and _linked(asks[i][3], sets[k], percent):
                        linked.add((i, label))
                        out.add((min(doc, other), max(doc, other)))
            names = ["a", "b"] if size else ["region", "doc_id", "ask"]
            kinds = [pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(len(names))], names=names)

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _dealt(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (``ask``: open rows as such) dealt into blocks that hold each open row with each row once."""
    n = rows.groupBy("region").agg(F.count_if("ask").alias("asks"), F.count_if(~F.col("ask")).alias("rows")).where("asks > 0 and rows > 0")
    blocks, parts = (F.ceil(F.col(c) / size).cast("int") for c, size in (("rows", REGION_BLOCK), ("asks", ASK_BLOCK)))
    rows = rows.join(n.select("region", blocks.alias("blocks"), parts.alias("parts")), "region")

    def own(count: str) -> Column:
        return F.array(F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int"))

    def each(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    rows = rows.withColumn("block", F.explode(F.when(F.col("ask"), each("blocks")).otherwise(own("blocks"))))
    rows = rows.withColumn("part", F.explode(F.when(F.col("ask"), own("parts")).otherwise(each("parts"))))
    return rows.select("region", "block", "part", "ask", *cols).repartition("region", "block", "part").sortWithinPartitions("region", "block", "part", F.desc("ask"), "doc_id")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept.

    Null, empty and blank texts have no shingles and link with nothing.  A row with a null id links
    with nothing, has a null component and is kept.  Repeated rows are in one component and come out
    as often as they came in; texts that share an id are linked by it.  An empty table gives an empty
    one, very long texts count with all their shingles, and columns besides doc_id and text are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    signed = scratch.put(docs.mapInArrow(_signatures(size), "doc_id long, tag long, n long, s1 long, s2 long, sig binary"), "signatures")
    reps = signed.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "tag")).alias("r"), F.max("sig").alias("sig"))
    reps = scratch.put(reps.select("n", "s1", "s2", "r.*", "sig"), "sets")
    signed = staged(signed.drop("sig", "tag"), "ids")
    some = signed.where("n > 0 and doc_id is not null")
    scratch.drop("signatures")

    keys = reps.select("doc_id", "sig").mapInArrow(_orders, "k1 long, k2 long, doc_id long")
    found = keys.repartitionByRange("k1", "k2", "doc_id").sortWithinPartitions("k1", "k2", "doc_id").mapInArrow(_neighbours, _FOUND)
    found = scratch.put(found, "neighbours")
    # a region may run on into the next partition: join each end with the next start
    ends = found.where("kind >= 2").select(F.col("a").alias("part"), "kind", F.col("b").alias("doc_id"), F.struct("k1", F.shiftright("k2", int(_TAIL))).alias("head"))
    w = W.orderBy("part", "kind")  # two rows for each partition
    ends = ends.withColumn("p", F.lag(F.struct("doc_id", "head", "part")).over(w)).where("kind = 2 and p.part < part and p.head = head")
    across = ends.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"), F.lit(LEAST).cast("long").alias("depth"))
    pairs = found.where("kind = 0").select("a", "b", "depth").unionByName(across).where("a <> b")
    pairs = scratch.put(pairs.groupBy("a", "b").agg(F.sum("depth").alias("depth")), "candidates")
    regions = scratch.put(found.where("kind = 1").select(F.col("a").alias("region"), F.col("b").alias("doc_id")).distinct(), "regions")
    scratch.drop("neighbours")

    needed = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(reps.select("doc_id", "tag"), "doc_id"), "needed")
    if needed.count() <= BROADCAST_IDS:  # else by a join that deals the texts out
        needed = F.broadcast(needed)
    texts = scratch.put(docs.join(needed, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]), "candidate-texts")

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        one = some.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return scratch.put(two.select("a", "b", "ta", "tb").mapInArrow(_confirm(size, percent), "a long, b long"), name)

    def label(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
        named = labels.select(F.col("node").alias(col), F.col("label").alias("_l"))
        return df.join(named, col, "left").withColumn(out, F.coalesce("_l", col)).drop("_l")

    def open_pairs(df: DataFrame, labels: DataFrame) -> DataFrame:
        return label(label(df, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("depth", -F.col("a"))).alias("a"))
    links = confirmed(best, "best-links")
    labels = components(links, scratch, "labels-1")
    links = links.unionByName(confirmed(open_pairs(pairs.select("a", "b"), labels).join(best, ["a", "b"], "left_anti"), "other-links"))
    labels = components(links, scratch, "labels-2")

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of the regions that hold several components, with the rows of the region."""
        rows = label(regions, labels, "doc_id", "label")
        some = rows.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        return rows.join(some.select("region"), "region")

    now = scratch.put(mixed(labels), "mixed")
    degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    hub = now.join(degree, "doc_id", "left").groupBy("region").agg(F.max_by(F.struct("doc_id", "label"), F.struct(F.coalesce("degree", F.lit(0)), -F.col("doc_id"))).alias("hub"))
    spokes = now.join(hub, "region").where("label <> hub.label").select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()
    links = links.unionByName(confirmed(spokes.join(pairs, ["a", "b"], "left_anti"), "hub-links"))
    labels = components(links, scratch, "labels-3")

    now = scratch.put(mixed(labels), "mixed")
    parts = now.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
    now = now.join(parts, "region").select("region", "doc_id", "label", F.explode(F.when(F.col("label") != F.col("main"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("ask"))
    signatures = reps.select("doc_id", "tag", "sig")
    close = _dealt(now.join(signatures, "doc_id"), ["doc_id", "label", "sig"]).mapInArrow(_close(percent), "region long, doc_id long, ask boolean")
    close = scratch.put(close.distinct(), "close").join(now, ["region", "doc_id", "ask"])
    close = close.join(signatures, "doc_id").join(texts, ["doc_id", "tag"])
    deep = scratch.put(_dealt(close, ["doc_id", "label", "sig", "text"]).mapInArrow(_close(percent, size), "a long, b long").distinct(), "deep-links")
    # an id with several texts links their sets
    held = some.select("doc_id", "n", "s1", "s2").distinct().join(reps.select("n", "s1", "s2", F.col("doc_id").alias("b")), ["n", "s1", "s2"])
    same_id = held.join(held.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a < z"), "doc_id").select("a", "b")
    final = components(links.unionByName(deep).unionByName(same_id), scratch, "labels")
    sets = staged(label(reps.select("n", "s1", "s2", "doc_id"), final, "doc_id", "label").drop("doc_id"), "components")
    scratch.drop(*scratch.paths)
    out = signed.join(sets, ["n", "s1", "s2"], "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("label")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: of its smallest id that with the smallest text.
    Columns stay as they are; rows without words or without an id all stay."""
    found = near_duplicates(docs, size, percent)
    gone = found.where("not kept").select("doc_id", F.lit(True).alias("gone"))
    again = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    marks = staged(gone.unionByName(again.select("doc_id", F.lit(False).alias("gone"))).distinct(), "marks")
    if marks.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    blank = F.coalesce(~F.col("row.text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(marks.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("blank", blank)
    first = F.row_number().over(W.partitionBy("id").orderBy("row.text"))
    once = rows.where("not gone and not blank").withColumn("k", first).where("k = 1")
    return rows.where("gone is null or blank").select("row.*").unionByName(once.select("row.*"))
