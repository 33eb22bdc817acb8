"""Shared-storage and column helpers for the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.staging import Scratch, shared_folder, staged

__all__ = ["Scratch", "held_out", "narrow_batches", "shared_folder", "staged", "table"]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Contract split: crc32 of the id as text leaves remainder 1."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def narrow_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of about ``BATCH_BYTES``, for this session from now on.

    By rows alone, 10,000 texts of 3 kB are one batch, of which JVM and worker of every task hold several copies.
    Where the session sets the size, that stays.  A text that is longer is a batch of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
