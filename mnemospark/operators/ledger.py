"""Operational ledgers: percentiles, roll-ups, windows over outcomes, ordered state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(df: DataFrame, keys: list[str], value: str, wanted: list[float]) -> DataFrame:
    """(keys, q, value) by nearest rank, exactly: a group's equal values are counted before they are ordered.

    The counts combine in the map stage, so a hot group costs a row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(*keys, value, "c", upto.alias("upto"), F.sum("c").over(w).alias("n"))
    asked = placed.withColumn("q", F.explode(F.array(*[F.lit(q) for q in wanted])))
    target = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    return asked.where((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target)).select(*keys, "q", F.col(value).alias("value"))


def rollup(df: DataFrame, key: str, at: str, outcome: str) -> DataFrame:
    """Per key: first and last time, rows, rows per outcome as a sorted text, last outcome."""
    per = df.groupBy(key, outcome).agg(
        F.count("*").alias("c"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    return per.groupBy(key).agg(
        F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), F.sum("c").alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(outcome), F.col("c").cast("string")))), ",").alias("outcomes"),
        F.max(F.struct("hi", outcome))[outcome].alias("last_outcome"),
    )


def recent_share(df: DataFrame, key: str, order: list[str], flag: Column, rows: int = 10) -> DataFrame:
    """Adds ``recent``: the share of rows with the flag among the last ``rows`` of the key, this one included."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumn("recent", F.avg(flag.cast("int")).over(w))


def streaks(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """(key, start, n) of each unbroken run of rows with the flag: gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.select(key, *order, flag.alias("hit"), F.row_number().over(w).alias("all_rank"))
    hits = marked.where(F.col("hit"))
    island = F.col("all_rank") - F.row_number().over(w)
    return hits.withColumn("island", island).groupBy(key, "island").agg(
        F.min(order[0]).alias("start"), F.count("*").alias("n")).drop("island")


def coalesced(df: DataFrame, key: str, at: str, gap_seconds: int = 60) -> DataFrame:
    """(key, at): hits that count, the first of each key and any at least ``gap_seconds`` after the last that counted.

    Whether a row counts depends on the rows before it, so each key is folded in
    time order; rows come sorted, and only the last counted time is held.
    """
    kind = dict(df.dtypes)[key]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for b in batches:
            keep = []
            for k, t in zip(b[key].tolist(), b["us"].tolist()):
                counts = k != current or t - last >= gap_seconds * 1_000_000
                if counts:
                    current, last = k, t
                keep.append(counts)
            yield b.loc[keep, [key, "us"]]

    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    return rows.repartition(key).sortWithinPartitions(key, "us").mapInPandas(fold, f"{key} {kind}, us long").select(
        key, F.timestamp_micros("us").alias(at))


def as_of_next(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the first row of ``right`` of the same key at or after it: one sort of the union, no join.

    Of equal times the smallest value of ``right`` is taken.
    """
    both = left.withColumn("side", F.lit(1)).withColumn("found", F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(key, at, F.lit(0).alias("side"), F.col(value).alias("found")), allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("side"), F.col("found").desc())
    seen = both.withColumn("hit", F.last(F.when(F.col("side") == 0, F.struct(F.col(at).alias("next_at"), F.col("found").alias("next_value"))), ignorenulls=True).over(
        back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return seen.where(F.col("side") == 1).select(*left.columns, "hit.next_at", "hit.next_value")


def within_before(df: DataFrame, key: str, at: str, seconds: int, counted: Column) -> DataFrame:
    """Adds ``n_before``: rows of the key with the flag in the ``seconds`` before each row, by a range frame instead of a join."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return df.withColumn("n_before", F.coalesce(F.sum(counted.cast("int")).over(w), F.lit(0)))
