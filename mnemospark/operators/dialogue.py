"""Ordered logic over dialogue turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def speech(messages: DataFrame) -> DataFrame:
    """(session, msg_id, role, turn, step, at, text) of user and assistant messages; the latest delivery of each counts."""
    user = (F.col("type") == "user/message") & (F.col("source_kind") == "user")
    rows = messages.where(F.col("msg_id").isNotNull() & (user | (F.col("type") == "assistant/message")))
    fields = ["received_at", "session", "type", "turn", "step", "at", "text"]
    best = rows.groupBy("msg_id").agg(F.max(F.struct(*fields)).alias("m")).select("msg_id", *[f"m.{f}" for f in fields])
    return best.select("session", "msg_id", F.when(F.col("type") == "user/message", "user").otherwise("assistant").alias("role"),
                       "turn", "step", "at", "text")


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(session, turn, question, answer): the turn's user message and its last assistant step; a conditional aggregate, no join."""
    user = F.col("role") == "user"
    pair = messages.where(F.col("turn").isNotNull()).groupBy("session", "turn").agg(
        F.min(F.when(user, F.struct("at", "msg_id"))).alias("q"), F.max(F.when(~user, F.struct("step", "at", "msg_id"))).alias("a"))
    return pair.select("session", "turn", F.col("q.msg_id").alias("question"), F.col("a.msg_id").alias("answer"))


def topic_drift(messages: DataFrame) -> DataFrame:
    """(session, msg_id, drift) of user messages: 1 less the overlap with the one before; null for the first."""
    order = Window.partitionBy("session").orderBy("turn", "at", "msg_id")
    rows = messages.where((F.col("role") == "user") & F.col("turn").isNotNull()).select(
        "session", "msg_id", "turn", "at", text.token_set(F.col("text")).alias("t"))
    return rows.withColumn("before", F.lag("t").over(order)).select(
        "session", "msg_id", F.when(F.col("before").isNotNull(), F.round(1 - text.overlap(F.col("t"), F.col("before")), 6)).alias("drift"))


def turn_weights(messages: DataFrame) -> DataFrame:
    """(session, msg_id, weight) of user messages by how long ago they are: 1 for the last five, 0.5 up to twenty, else 0.2."""
    order = Window.partitionBy("session").orderBy(F.col("turn").desc(), F.col("at").desc(), "msg_id")
    ago = F.row_number().over(order) - 1
    return messages.where((F.col("role") == "user") & F.col("turn").isNotNull()).select(
        "session", "msg_id", F.when(ago < 5, 1.0).when(ago < 20, 0.5).otherwise(0.2).alias("weight"))


def continued(messages: DataFrame, short: str) -> DataFrame:
    """(session, msg_id, task_id): for messages that only say go on, the last user message before that says more."""
    order = Window.partitionBy("session").orderBy("turn", "at", "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    is_short = F.lower(F.trim("text")).rlike(short)
    rows = messages.where((F.col("role") == "user") & F.col("turn").isNotNull() & F.col("text").isNotNull()).withColumn("short", is_short)
    task = F.last(F.when(~F.col("short"), F.col("msg_id")), ignorenulls=True).over(order)
    return rows.withColumn("task_id", task).where("short").select("session", "msg_id", "task_id")
