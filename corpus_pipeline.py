"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents, further columns included, whatever their
names.  An empty table gives an empty table.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millwright.llm import decontam, forest, packing, secrets, toxicity
from millwright.llm.common import narrow_batches, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose score reaches 0.7 go, that of exactly 0.7 too.

    Null and empty texts score as the share of toxic examples and stay unless that is 0.7; rows that
    repeat score alike and go or stay together, a null id is no matter.  Without labels all stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of texts linked by five-word shingles at 0.8 or more the smallest id stays, in one row.

    Of rows with that same id the smallest text stays.  Texts without words and rows with a null id
    are linked with nothing and all stay."""
    narrow_batches(spark)
    return forest.one_of_each(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go.

    Null and empty texts hold none and stay; rows that repeat go or stay together.  Items with a null id
    or text say nothing; an empty benchmark keeps all."""
    narrow_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: found secrets are replaced in the text; no document goes.

    Overlapping spans become one mark; n_chars follows the text.  Null and clean texts come back as they
    are, rows that repeat alike."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document's pieces with their place in sequences of 4096 tokens.

    A null or empty text is its end id; every row that repeats gets pieces and a place of its own.  Only
    texts of more than 4096 tokens are cut."""
    import public_tokenizers

    narrow_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the model, the forest or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
