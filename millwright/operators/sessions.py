"""Chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import scalars as S


def list_sessions(sessions: DataFrame) -> DataFrame:
    """T1."""
    return sessions.orderBy(F.desc("updated_at"), "id")


def history(messages: DataFrame, session=None) -> DataFrame:
    """Messages of every session (or one) in turn order."""
    if session is not None:
        messages = messages.where(F.col("session_id") == session)
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


def titles(messages: DataFrame) -> DataFrame:
    """title of a session from its first user message."""
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn").alias("content"))
    return first.select("session_id", S.title("content").alias("title"))


def serialize(messages: DataFrame) -> DataFrame:
    """F18."""
    return messages.withColumn("role", S.role("kind"))
