"""The entry store: typed entries, filters, semi joins, statistics and maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text

#: Statuses that are not shown; superseded entries are. Fixed values.
HIDDEN = ("shadow", "merged", "expired")
SCALARS = ["id", "kind", "content", "source", "scope", "project", "valid_at", "asserted_at", "expires_at", "importance",
           "confidence", "reinforcement", "last_hit_at", "file"]


def entries(memories: DataFrame) -> DataFrame:
    """One row per entry: repeated rows collapse, a null status is active, a null merged_from is empty."""
    return memories.select(
        *SCALARS, F.coalesce("status", F.lit("active")).alias("status"),
        F.concat_ws(",", F.coalesce("merged_from", F.array())).alias("merged_from"),
    ).distinct()


def visible(df: DataFrame) -> DataFrame:
    return df.where(~F.col("status").isin(*HIDDEN))


def structured(
    df: DataFrame, kinds: list[str] | None = None, scope: str | None = None, project: str | None = None,
    contains: str | None = None, valid_until: str | None = None, tags: DataFrame | None = None,
    entities: DataFrame | None = None, limit: int | None = 50,
) -> DataFrame:
    """Visible entries that meet all given conditions, newest first. ``tags`` and ``entities`` have memory_id."""
    out = visible(df)
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if scope:
        out = out.where(F.col("scope") == scope)
    if project:
        out = out.where(F.col("project") == project)
    if contains:
        out = out.where(F.contains("content", F.lit(contains)) | F.contains("source", F.lit(contains)))
    if valid_until:
        out = out.where(F.col("valid_at") <= F.lit(valid_until).cast("timestamp"))
    for posting in (tags, entities):
        if posting is not None:
            out = out.join(posting.select(F.col("memory_id").alias("id")), "id", "left_semi")
    return out.orderBy(F.col("valid_at").desc(), "id").limit(limit) if limit else out


def in_lineage(project: Column, lineage: list[str]) -> Column:
    """Whether an entry's project is seen from a project with these ancestors: global entries and those of the chain."""
    return project.isNull() | project.isin(*lineage)


def with_postings(df: DataFrame, tags: DataFrame, entities: DataFrame) -> DataFrame:
    """Entries with their sorted tag and entity sets."""
    t = tags.where(F.col("tag").isNotNull()).groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    e = entities.where(F.col("entity").isNotNull()).groupBy(F.col("memory_id").alias("id")).agg(
        F.array_sort(F.collect_set("entity")).alias("entities"))
    return df.join(t, "id", "left").join(e, "id", "left").withColumns(
        {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "entities")})


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("pos", rank).where(F.col("pos") <= n)


def digest(df: DataFrame, top: int = 8) -> DataFrame:
    """The most restated contents: count, highest importance (default 5), latest entry."""
    key = text.fingerprint(F.col("content"))
    return (
        df.where(F.trim("content") != "").groupBy(key.alias("key"))
        .agg(F.count("*").alias("n"), F.max(F.coalesce("importance", F.lit(5))).alias("importance"),
             F.max(F.struct("valid_at", "id")).alias("latest"))
        .select("n", "importance", F.col("latest.valid_at").alias("latest_at"), F.col("latest.id").alias("id"))
        .orderBy(F.col("n").desc(), F.col("importance").desc(), F.col("latest_at").desc(), "id").limit(top)
    )


def quality(df: DataFrame) -> DataFrame:
    """Per kind: entries that merge others, raw ones by reason, and the share of low ones in percent."""
    short = F.length(F.trim("content")) < 40
    derived = F.col("merged_from") != ""
    unsure = F.coalesce(F.col("confidence") < 0.3, F.lit(False))
    return df.where(F.col("kind") != "doc").groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(derived).alias("derived"), F.count_if(~derived & short).alias("raw_short"),
        F.count_if(~derived & ~short & unsure).alias("raw_unsure"),
        F.round(100 * F.count_if(~derived & (short | unsure)) / F.count("*"), 1).alias("low_pct"),
    )


def consolidation(df: DataFrame, now: str, least: float = 0.15) -> DataFrame:
    """Per kind and reason the entries a consolidation would expire: past their time, or decayed and never reinforced."""
    age = scoring.age_days(F.col("valid_at"), now)
    ended = F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp"), F.lit(False))
    faded = (scoring.retention(F.col("kind"), age) < least) & (F.coalesce("reinforcement", F.lit(0)) == 0)
    reason = F.when(ended, "ttl").when(faded, "decay").otherwise("keep")
    return df.where((F.col("status") == "active") & F.col("kind").isin("event", "context")).groupBy("kind", reason.alias("reason")).agg(
        F.count("*").alias("n"))


def diff(old: DataFrame, new: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, change) over two states of a table: added, removed, updated or unchanged."""
    a = old.select(key, F.xxhash64(value).alias("h_old"), F.lit(1).alias("in_old"))
    b = new.select(key, F.xxhash64(value).alias("h_new"), F.lit(1).alias("in_new"))
    return a.join(b, key, "full").select(key, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
                                         .when(F.col("h_old") != F.col("h_new"), "updated").otherwise("unchanged").alias("change"))


def greedy_fill(items: Column, cost: str, budget: int) -> Column:
    """Of an ordered array of structs those that still fit, skipping what doesn't; the array is one small group's."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, F.lit(1), F.lit(0)).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[cost] <= budget
        return F.struct(F.when(fits, acc["used"] + x[cost]).otherwise(acc["used"]).cast("long").alias("used"),
                        F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(items, start, step, lambda acc: acc["taken"])


def greedy_stream(df: DataFrame, key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """(key, id, pos, cost): ``greedy_fill`` over groups of any size, with the place among the group's rows.

    Each group is folded in order; rows come sorted, and only the used budget is
    held. A row without cost doesn't fit.
    """
    kind = dict(df.dtypes)[key]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, pos = None, 0, 0
        for b in batches:
            keep, places = [], []
            for k, c in zip(b[key].tolist(), b[cost].tolist()):
                if k != current:
                    current, used, pos = k, 0, 0
                pos += 1
                fits = used + c <= budget
                if fits:
                    used += c
                keep.append(fits)
                places.append(pos)
            yield b.assign(pos=places).loc[keep, [key, "id", "pos", cost]]

    rows = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, "id", F.coalesce(cost, F.lit(budget + 1)).cast("long").alias(cost)).mapInPandas(
        fold, f"{key} {kind}, id string, pos int, {cost} long")


def prefix_fill(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The first rows of each group whose running cost stays within the budget; stops at the first overflow."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def upsert(current: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with the patch's non-null values in place and its new keys added."""
    p = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return current.join(p, key, "full").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def changed_fields(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changed): the names of the columns that differ between two versions of a row."""
    b = after.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]))
    return before.join(b, key).select(key, names.alias("changed"))
