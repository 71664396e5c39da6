"""Percentiles of very large columns by mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (value, r_min, r_max): the true
rank of the value lies in [r_min, r_max]. Stored are the values, the steps of
r_min from tuple to tuple and the widths r_max - r_min.

Every task summarises the values it holds, group by group, before anything is
shuffled: of n values those at every k-th rank, exactly. A hot group is so split
over all tasks, and each sends at most 1 / `SHARES` / eps tuples of it on, however
many values there are; a group with few values in a task is sent whole.

Any number of summaries merge in one step: r_min(v) is the sum, over the
summaries, of the r_min of their last tuple at or before v; r_max(v) adds what
each summary leaves open at v. Both are running sums over the tuples in order of
value. A merged summary is compressed: of the tuples whose ranks fall into one
bucket of the permitted width only the last is kept, besides the first and last
of all. Summaries merge by level: tasks to a day, days to a month, months to the
group; the last merge compresses nothing. The error that really accrued is a
column of the result: how far the tuple's interval reaches from the wanted rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What part of the permitted error the levels may use.
SHARES = {"task": 0.25, "day": 0.5, "month": 0.25}
#: Values or tuples a task sorts at once; a group in a task may come out in several summaries.
BUFFER = 2_000_000
METRICS = ("enrichMs", "episodeMs")
SUMMARY = "n long, vals array<double>, steps array<long>, widths array<long>"


def latest_rows(raw: DataFrame) -> DataFrame:
    """(project, day, enrichMs, episodeMs) of capturerecord, each row once; what is no measurement is null.

    A row is known by (session, turn); of its deliveries the latest logged_at
    counts. Rows without session or turn count once per distinct content. Null,
    NaN and negative values are no measurements; infinite ones are. A null or
    blank project is the project null; a null time is the day null. ``day`` is
    the number of days since 1970.
    """
    name = F.lower(F.trim("project"))
    slim = raw.select(
        "session", "turn", "logged_at", F.unix_date(F.to_date("at")).alias("day"), F.when(name != "", name).alias("project"),
        *[F.col(m).cast("double").alias(m) for m in METRICS])
    fields = ["logged_at", "day", "project", *METRICS]
    content = F.when(F.col("session").isNull() | F.col("turn").isNull(), F.xxhash64("session", "turn", *fields))
    rows = slim.groupBy("session", "turn", content.alias("content")).agg(F.max(F.struct(*fields)).alias("r"))
    return rows.select("r.project", "r.day", *[F.when(~F.isnan(x) & (x >= 0), x).alias(m) for m in METRICS for x in [F.col(f"r.{m}")]])


def measurements(raw: DataFrame) -> DataFrame:
    """(project, metric, day, value): the measurements one by one."""
    pairs = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])
    return latest_rows(raw).select("project", "day", F.explode(pairs).alias("metric", "value")).where(F.col("value").isNotNull())


def starts(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.array([], dtype=np.int64)


def spaced(rank: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray, share: float) -> np.ndarray:
    """Which tuples a compression keeps: the last of each bucket of 2 * share * n ranks, the first and the last."""
    width = np.maximum(1, np.floor(2 * share * n)).astype(np.int64)
    bucket = rank // width
    return first | last | np.r_[bucket[1:] != bucket[:-1], True]


def as_rows(keys: pd.DataFrame, code: np.ndarray, n: np.ndarray, value: np.ndarray, low: np.ndarray, width: np.ndarray) -> pd.DataFrame:
    """One row per run of equal codes, with its keys and lists."""
    begin = starts(code)
    out = keys.iloc[code[begin]].reset_index(drop=True)
    step = np.diff(low, prepend=0)
    step[begin] = low[begin]
    out["n"] = n[begin]
    for name, list_ in (("vals", value), ("steps", step), ("widths", width)):
        out[name] = np.split(list_, begin[1:]) if len(begin) else []
    return out


def summarise(eps: float):
    """A function for mapInPandas over (project, day, metrics): summaries of each task's values."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        parts = []
        for metric in METRICS:
            own = rows[rows[metric].notna()]
            code = own.groupby(["project", "day"], dropna=False, sort=False).ngroup().to_numpy()
            frame = own[["project", "day"]].iloc[np.unique(code, return_index=True)[1]]
            frame.insert(1, "metric", metric)
            order = np.lexsort((own[metric].to_numpy(), code))
            code, value = code[order], own[metric].to_numpy()[order]
            begin = starts(code)
            size = np.diff(np.r_[begin, len(code)])
            n, rank = np.repeat(size, size), np.arange(len(code)) - np.repeat(begin, size) + 1
            keep = spaced(rank, n, rank == 1, rank == n, SHARES["task"] * eps)
            parts.append(as_rows(frame, code[keep], n[keep], value[keep], rank[keep], np.zeros(keep.sum(), dtype=np.int64)))
        return pd.concat(parts, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BUFFER:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def merged(rows: pd.DataFrame, keys: list[str], share: float) -> pd.DataFrame:
    """Merges all summaries of each group in ``rows`` and compresses by ``share`` of n; 0 keeps every tuple."""
    code = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    frame = rows[keys].iloc[np.unique(code, return_index=True)[1]]
    total = np.bincount(code, weights=rows["n"].to_numpy(dtype=float)).astype(np.int64)
    sizes = rows["vals"].map(len).to_numpy()
    value, gain, width = (np.concatenate(rows[c].to_numpy()) for c in ("vals", "steps", "widths"))
    code = np.repeat(code, sizes)
    source = np.repeat(np.arange(len(rows)), sizes)
    first = np.r_[True, source[1:] != source[:-1]]
    last = np.r_[first[1:], True]
    open_after = np.where(last, 0, np.r_[gain[1:] + width[1:] - 1, 0])  # r_max of the next tuple - r_min - 1
    change = open_after - np.where(first, 0, np.r_[0, open_after[:-1]])
    order = np.lexsort((source, value, code))
    code = code[order]
    begin = starts(code)
    size = np.diff(np.r_[begin, len(code)])

    def running(x: np.ndarray) -> np.ndarray:
        sums = np.cumsum(x[order])
        return sums - np.repeat(np.r_[0, sums[begin[1:] - 1]], size)

    low = running(gain)
    slack = running(change) - open_after[order] + width[order]
    n = total[code]
    ends = np.zeros(len(code), dtype=bool)
    ends[begin] = True
    final = np.r_[ends[1:], True]
    keep = spaced(low, n, ends, final, share) if share else np.ones(len(code), dtype=bool)
    return as_rows(frame, code[keep], n[keep], value[order][keep], low[keep], slack[keep])


def merge_stream(keys: list[str], share: float):
    """A function for mapInPandas over summaries sorted by keys: merges whole groups, several at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tuples = None, 0
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tuples += int(batch["vals"].map(len).sum())
            if tuples < BUFFER or not len(held):
                continue
            group = held.groupby(keys, dropna=False, sort=False).ngroup()
            newest = group == group.iloc[-1]
            done, held = held[~newest].reset_index(drop=True), held[newest].reset_index(drop=True)
            tuples = int(held["vals"].map(len).sum())
            if len(done):
                yield merged(done, keys, share)
        if held is not None and len(held):
            yield merged(held, keys, share)

    return run


def merge(summaries: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Merges all summaries of a group of ``keys``.

    A task holds one group's summaries: at most 1 / (2 * share) tuples of each
    summary that comes from a hot group, from as many as there are tasks, days or
    months below.
    """
    kinds = dict(summaries.dtypes)
    sorted_ = summaries.select(*keys, "n", "vals", "steps", "widths").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInPandas(merge_stream(keys, share), ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {SUMMARY}")


def task_summaries(rows: DataFrame, eps: float) -> DataFrame:
    """(project, metric, day, n, vals, steps, widths): what each task knows of each group, without a shuffle."""
    return rows.mapInPandas(summarise(eps), f"project string, metric string, day int, {SUMMARY}")


def day_summaries(rows: DataFrame, eps: float) -> DataFrame:
    """Summaries per (project, metric, day): the form to store, day by day, and to combine later."""
    return merge(task_summaries(rows, eps), ["project", "metric", "day"], SHARES["day"] * eps)


def combine_days(days: DataFrame, eps: float) -> DataFrame:
    """(project, metric, value, r_min, r_max, n): stored day summaries as one summary per group, by month first."""
    dated = days.withColumn("month", F.unix_date(F.trunc(F.date_from_unix_date("day"), "month")))
    months = merge(dated, ["project", "metric", "month"], SHARES["month"] * eps)
    return tuples(merge(months, ["project", "metric"], 0.0), ["project", "metric"])


def tuples(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, r_min, r_max, n): a group's summary tuple by tuple, the steps of r_min added up."""
    x = F.posexplode(F.arrays_zip("vals", "steps", "widths")).alias("pos", "x")
    single = summaries.select(*keys, "n", x)
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.sum("x.steps").over(order)
    return single.select(*keys, F.col("x.vals").alias("value"), low.alias("r_min"), (low + F.col("x.widths")).alias("r_max"), "n")


def percentile_table(summary: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """(keys, q, value, n, rank_error): for each wanted q the tuple whose interval is nearest to rank q * n.

    ``rank_error`` bounds how far the value's true rank is from it, as a share of n.
    """
    target = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    miss = F.greatest(target - F.col("r_min"), F.col("r_max") - target)
    return (
        summary.withColumn("q", F.explode(F.array(*[F.lit(q) for q in wanted])))
        .groupBy(*keys, "q", "n").agg(F.min(F.struct(miss.alias("miss"), "value")).alias("best"))
        .select(*keys, "q", F.col("best.value").alias("value"), "n", (F.col("best.miss") / F.col("n")).alias("rank_error"))
    )


def project_percentiles(raw: DataFrame, wanted: list[float], eps: float = 0.01) -> DataFrame:
    """Percentiles per project and metric of capturerecord, from mergeable day summaries.

    An empty table gives an empty result.
    """
    days = day_summaries(latest_rows(raw), eps)
    return percentile_table(combine_days(days, eps), ["project", "metric"], wanted)
