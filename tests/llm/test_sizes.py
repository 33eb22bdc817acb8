"""What must not grow faster than the input."""

import random

import pyarrow as pa

from millwright.llm import suffix_dedup as D
from millwright.llm import toxicity
from millwright.llm.common import BATCH, BATCH_BYTES, narrow_batches


def test_split_shards_leave_the_others_alone(spark, monkeypatch):
    """op1: every round of splitting looked again at all shards that had been left as they were."""
    rng, plans = random.Random(1), {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(90))
    part = "".join(rng.choice("abcdefghij") for _ in range(98))
    texts = [word() + part + word() for _ in range(12)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [t + "!" for t in texts])], "doc_id long, text string")

    class Seen(D.Scratch):
        def put(self, df, name):
            plans[name] = df._jdf.queryExecution().analyzed().toString()
            return super().put(df, name)

    monkeypatch.setattr(D, "Scratch", Seen)
    D.remove_repeats(docs, 100, shard_rows=2)
    deep = [line.index("Join LeftAnti") for line in plans["firsts"].splitlines() if "Join LeftAnti" in line]
    assert len(deep) > 1 and "split-1" in plans
    lines, open_at = plans["firsts"].splitlines(), None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        if open_at is not None and at <= open_at:
            open_at = None
        if "Join LeftAnti" in line:
            assert open_at is None  # no anti join over the result of another
            open_at = at


def test_texts_go_to_python_in_narrow_batches(spark, monkeypatch):
    """Pipeline, toxicity: 10,000 texts were one batch, and the driver kept the index that it had sent out."""
    own, made = spark.newSession(), []
    rows = [(k, ("good words " if k % 2 else "bad words ") * 400) for k in range(3000)]
    docs = own.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = own.createDataFrame([(k, 1, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *args: made.append(fit(*args)) or made[-1])
    kept = toxicity.without_toxic(docs, labels)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    assert max(r.size for r in docs.mapInArrow(sizes, "n long, size long").collect()) < 2 * BATCH_BYTES
    assert not vars(made[0])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(1, 3000, 2))
    own.conf.set(BATCH, "1000000")
    narrow_batches(own)  # what the session sets stays
    assert own.conf.get(BATCH) == "1000000"
