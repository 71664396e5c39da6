"""Structured Streaming forms of the append-log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.jsonl import EPISODES


def episode_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Episodes as they arrive in day files, each id once within the watermark."""
    rows = spark.readStream.schema(EPISODES).option("columnNameOfCorruptRecord", "broken").json(path)
    fine = rows.where(F.col("id").isNotNull() & F.col("role").isin("user", "assistant") & F.col("at").isNotNull())
    return fine.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def counts_per_hour(episodes: DataFrame) -> DataFrame:
    """Messages per project and hour, in event time; final once the watermark has passed."""
    return episodes.groupBy(F.window("at", "1 hour").alias("w"), "project").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("hour"), "project", "n")


def coalesced_stream(hits: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """(key, us) of hits that count: the first of a key and any ``gap_seconds`` after the last that counted.

    The state of a key is the last counted time; within a micro-batch a key's
    hits are folded in time order.
    """
    gap = gap_seconds * 1_000_000

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b["us"].tolist()):
            if last is None or t - last >= gap:
                last = t
                out.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "us": pd.Series(out, dtype="int64")}).astype({"key": object})

    return hits.where(F.col("key").isNotNull() & F.col("us").isNotNull()).select("key", "us").groupBy("key").applyInPandasWithState(
        fold, "key string, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def merge_into(path: str, key: str):
    """A function for foreachBatch: appends the batch's rows whose key isn't in the table yet."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        else:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
