"""Streaming form of the adjustment-event sessions: late changes count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_events(changes: DataFrame, merge_minutes: float = 2, late: str = "10 minutes") -> DataFrame:
    """Control changes (lot_id, worked_at, item_id) of a stream to (lot_id, worked_at, n_changes)."""
    gap = F.session_window("worked_at", f"{merge_minutes} minutes")
    return changes.withWatermark("worked_at", late).groupBy("lot_id", gap).agg(F.count(F.lit(1)).alias("n_changes"), F.min("worked_at").alias("started_at")).drop("session_window")
