"""Operator 12 against a plain computation of features, gains, scores and ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millwright.llm import queries, resampling
from millwright.llm import textops as X
from millwright.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def features(text):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """[(doc_id, n_features, weight, score, rank)] of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features(x))
        rows.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    n = 5 * len(fit) // 100
    return sorted(((*r[:4], next((k + 1 for k, f in enumerate(fit[:n]) if f is r), None)) for r in rows), key=str)


def check(spark, docs, target):
    d = spark.createDataFrame([(i, x, "n", "r", 1) for i, x in docs], "doc_id long, text string, word string, rank string, weight int")
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.draw(d, t).collect()), key=str)
    assert got == brute(docs, target)


def test_small_table(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, SMALL, "benchmark").select("text").collect()]
    assert sorted((tuple(r) for r in queries.op12_resampling(spark, SMALL).collect()), key=str) == brute(docs, target)


def test_awkward_rows(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["the", "a", "Of", "ÉTÉ", "漢字", "x1", "rare%d" % rng.randrange(300)]) for _ in range(n))
    docs = [(k, say(rng.randrange(1, 60))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, " .,-_ "), (503, "one"), (504, "one two"), (505, "z" * 300 + " tail " + "y" * 49 + " " + "w" * 48), (506, say(80_000)), (None, say(40)), (None, None)]
    docs += [(k, docs[7][1]) for k in range(600, 640)]
    check(spark, docs, [say(30), None, "", "the a of"])
    check(spark, docs, [])


def test_repeated_rows_take_a_rank_each(spark):
    text = " ".join(f"w{k}" for k in range(25))
    d = spark.createDataFrame([(1, text)] * 60, "doc_id long, text string")
    t = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    got = resampling.draw(d, t).collect()
    assert len(got) == 60 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.draw(none, some).count() == 0


@pytest.mark.parametrize("n_words, n_pairs", [(0, 0), (1, 1), (40, 0), (40, 300)])
def test_the_head_changes_no_bucket(n_words, n_pairs):
    rng = random.Random(2)
    vocabulary = ["w%d" % (k * k) for k in range(60)] + ["é" * 8, "x" * 16, "x" * 17, "q" * 48, "q" * 49]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80))) for _ in range(50)]
    head = resampling.Head([w.encode() for w in vocabulary if len(w.encode()) <= 16][:n_words], sorted({(rng.randrange(n_words), rng.randrange(n_words)) for _ in range(n_pairs)}) if n_words else [])
    found, row = resampling.buckets(*X.flat(pa.array(texts)), head)
    for k, text in enumerate(texts):
        assert Counter(found[row == k].tolist()) == Counter(zlib.crc32(f) % 10_000 for f in features(text))
    assert len(found) == sum(len(features(t)) for t in texts)


def test_head_holds_every_frequent_word(spark):
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 200), 3000)) for _ in range(100)]
    head = resampling.head(spark.createDataFrame([(t,) for t in text], "text string"), words=100, pairs=100)
    count = Counter(w for t in text for w in words(t))
    pair = Counter(p for t in text for p in zip(words(t), words(t)[1:]))
    often = {w for w, n in count.items() if n * 100 >= sum(count.values())}
    assert len(often) > 5 and {zlib.crc32(w) for w in often} <= set(head.state.tolist())
    assert len(head.pair_bucket) >= sum(n * 100 >= sum(count.values()) and {a, b} <= often for (a, b), n in pair.items())
