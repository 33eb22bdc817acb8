"""Every stage of the corpus pipeline against brute force, each on its own input."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import SMALL, awkward, brute_components, brute_hits, frame

from millwright.llm import secrets, toxicity
from millwright.llm.common import staged, table


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    extra = frame(spark, [(10_000 + i, t) for i, t in awkward() if i is not None]).select(*docs.columns)
    docs = staged(docs.unionByName(extra), "in")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = staged(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert out.columns == docs.columns
            after = [(r.doc_id, r.text) for r in out.collect()]
            kept[name] = {i for i, _ in after}
        if name == "toxicity":
            scores = {(r.doc_id): r.score for r in toxicity.toxicity_scores(docs, table(spark, SMALL, "labels")).collect()}
            assert sorted(str(x) for x in after) == sorted(str((i, t)) for i, t in before if scores[i] < 0.7)
        elif name == "near_dedup":
            first = {i for i, _, c in brute_components(before, 5, 80) if i == c}
            assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _ in before if str(i) in first)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
            clean = {i for i, *_, bad in brute_hits(before, items, 10) if not bad}
            assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _ in before if str(i) in clean)
        elif name == "secrets":
            spans = {(r.doc_id): [(s.lo, s.hi) for s in r["all"]] for r in secrets.find_secrets(docs).collect()}
            assert len(after) == len(before)
            new = dict(after)
            for i, t in before:
                want, at = "", 0
                for lo, hi in sorted(spans[i]):
                    want += (t[at:lo] if lo > at else "") + ("[secret]" if hi > at else "")
                    at = max(at, hi)
                assert new[i] == (want + t[at:] if spans[i] else t)
                assert not re.search(r"AKIA[A-Z0-9]{16}", new[i] or "")
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == {i for i, _ in before}
            by = {}
            for r in sorted(rows, key=lambda r: r.offset):
                assert by.get(r.sequence_id, 0) == r.offset
                by[r.sequence_id] = r.offset + r.length
            assert max(by.values()) <= 4096
        docs = out


def test_stages_on_empty_and_odd_rows(spark):
    """Empty tables, nulls in every column, repeated rows, a very long text and columns with clashing names."""
    rng = random.Random(17)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    none = frame(spark, [(1, "x")]).selectExpr("doc_id", *[f"cast(null as {k}) as `{c}`" for c, k in frame(spark, []).dtypes if c != "doc_id"])
    odd = frame(spark, [(1, long), (1, long), (2, None), (2, None), (None, None), (None, "some words"), (None, "some words"), (3, ""), (4, "a few other words here"), (4, "a few other words here"), (5, long + " end")])
    odd = odd.unionByName(none.withColumn("doc_id", F.lit(6).cast("long")))
    for docs in (frame(spark, []), odd):
        docs = staged(docs, "odd")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = staged(stage(spark, docs, SMALL), name)
            if name != "packing":
                assert docs.columns == odd.columns
            if before == 0:
                assert docs.count() == 0
            elif name == "near_dedup":
                kept = sorted((str(r.doc_id), len(r.text or "")) for r in docs.collect())
                assert kept == sorted([("1", len(long)), ("2", 0), ("2", 0), ("None", 0), ("None", 10), ("None", 10), ("3", 0), ("4", 22), ("6", 0)])
            elif name == "packing":
                assert docs.where("doc_id = 1").selectExpr("sum(length)").first()[0] > 150_000 and docs.where("doc_id = 2").count() == 2
            else:
                assert docs.count() == before


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
