"""History of changing attributes: insert-only satellites and lead-based views.

A *hub* key (one entity) has attributes that change at different rates. Each
group of attributes with one rate is a *satellite*: a table to which a row is
appended only when the hash of its attributes differs from the hash of the row
before. Rows are never updated; the end of a period is computed by ``lead`` in
a view. A presence satellite holds the periods in which the entity exists, so
that absence ends a version.

The work is one pre-aggregated shuffle on (key, date) and one on the key; the
calendar of snapshot dates is small by nature (one row for each export) and is
broadcast after a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import small

#: Attributes by change rate; ``origin`` changes least, ``state`` most.
SATELLITES = {"state": ["status"], "validity": ["expires_at"], "origin": ["valid_at", "merged_from"]}
OPEN_END = "9999-12-31"


def instant(text: Column) -> Column:
    """The instant a text denotes as microseconds in text form; null if it has none.

    No zone means UTC; empty and ``null`` mean none. A text that is no instant
    stands for itself, so that it still differs from others.
    """
    bare = F.trim(text)
    zoned = F.when(bare.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), bare).otherwise(F.concat(bare, F.lit("Z")))
    micros = F.unix_micros(zoned.try_cast("timestamp")).cast("string")
    return F.when((bare != "") & (F.lower(bare) != "null"), F.coalesce(micros, F.concat(F.lit("?"), bare)))


def word(text: Column, default: str) -> Column:
    """Trimmed, lower-case; ``default`` where nothing is left or it says null."""
    bare = F.lower(F.trim(text))
    return F.when(bare.isNull() | bare.isin("", "null"), F.lit(default)).otherwise(bare)


def id_set(json: Column) -> Column:
    """A JSON list as a sorted set in text form; null for an empty one.

    A text that is no list stands for itself.
    """
    bare = F.trim(json)
    items = F.array_sort(F.array_distinct(F.array_compact(F.from_json(bare, T.ArrayType(T.StringType())))))
    listed = F.when(F.size(items) > 0, F.to_json(items))
    return (
        F.when(bare.isNull() | bare.isin("", "null"), F.lit(None).cast("string"))
        .when(items.isNull(), F.concat(F.lit("?"), bare))
        .otherwise(listed)
    )


def normalise_snapshots(raw: DataFrame) -> DataFrame:
    """Rows of memory_snapshots with comparable values; rows without id or date are no versions."""
    return raw.where(F.col("memory_id").isNotNull() & F.col("snap_date").isNotNull()).select(
        "memory_id",
        "snap_date",
        "loaded_at",
        word(F.col("status"), "active").alias("status"),
        instant(F.col("expires_at")).alias("expires_at"),
        instant(F.col("valid_at")).alias("valid_at"),
        id_set(F.col("merged_from")).alias("merged_from"),
    )


def latest_per_date(rows: DataFrame, key: str, date: str, order: str, attributes: list[str]) -> DataFrame:
    """One row for each key and date: that with the latest ``order``.

    Partial aggregation drops repeats before the shuffle. Ties are broken by
    the attribute values; a null ``order`` is the earliest.
    """
    best = F.max(F.struct(order, *attributes)).alias("best")
    return rows.groupBy(key, date).agg(best).select(key, date, *[F.col(f"best.{a}").alias(a) for a in attributes])


def calendar(rows: DataFrame, date: str) -> DataFrame:
    """Each snapshot date, its ordinal, and the date after it."""
    order = Window.orderBy(date)  # over the distinct dates only
    return (
        rows.select(date).where(F.col(date).isNotNull()).distinct()
        .select(date, F.row_number().over(order).alias("ordinal"), F.lead(date).over(order).alias("next_date"))
    )


def hash_diff(columns: list[str]) -> Column:
    """64-bit hash of a satellite's attributes, nulls kept apart from empty texts."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in columns])


def satellite_rows(
    snapshots: DataFrame, dates: DataFrame, key: str, date: str, satellites: dict[str, list[str]]
) -> DataFrame:
    """All satellites in one pass: (key, satellite, load date, hash, attributes).

    A row stands for each satellite and date at which its hash differs from the
    one before, or at which the key (re)appears. The satellite ``presence`` has
    a row where the key appears (hash 1) and one where it vanishes (hash 0).
    """
    by_key = Window.partitionBy(key).orderBy(date)
    flagged = snapshots.join(small(dates), date).withColumn(
        "appears", F.coalesce(F.lag("ordinal").over(by_key) + 1 != F.col("ordinal"), F.lit(True))
    )
    flagged = flagged.withColumn(
        "vanishes", F.coalesce(F.lead("ordinal").over(by_key) - 1 != F.col("ordinal"), F.lit(True))
    )
    for name, columns in satellites.items():
        flagged = flagged.withColumn(f"hash_{name}", hash_diff(columns))
    for name in satellites:
        changed = F.col("appears") | (F.col(f"hash_{name}") != F.lag(f"hash_{name}").over(by_key))
        flagged = flagged.withColumn(f"changed_{name}", changed)
    parts = [
        F.when(
            F.col(f"changed_{name}"),
            F.struct(
                F.lit(name).alias("satellite"),
                F.col(date).alias("load_date"),
                F.col(f"hash_{name}").alias("hash_diff"),
                F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]).alias("attributes"),
            ),
        )
        for name, columns in satellites.items()
    ]
    none = F.create_map().cast("map<string,string>")
    parts += [
        F.when(F.col(flag), F.struct(F.lit("presence").alias("satellite"), day.alias("load_date"),
                                     F.lit(value).cast("long").alias("hash_diff"), none.alias("attributes")))
        for flag, day, value in (("appears", F.col(date), 1), ("vanishes", F.col("next_date"), 0))
    ]
    rows = flagged.select(key, F.explode(F.array_compact(F.array(*parts))).alias("row")).select(key, "row.*")
    return rows.where(F.col("load_date").isNotNull())


def satellite_view(rows: DataFrame, key: str) -> DataFrame:
    """Periods of each satellite: ``valid_to`` is the next load date of the same key and satellite."""
    order = Window.partitionBy(key, "satellite").orderBy("load_date", "hash_diff")
    return rows.withColumn("valid_to", F.lead("load_date").over(order))


def version_view(rows: DataFrame, key: str) -> DataFrame:
    """Versions over all satellites: the periods between any two changes while the key is present."""
    points = rows.groupBy(key, "load_date").agg(
        F.min(F.when(F.col("satellite") == "presence", F.col("hash_diff"))).alias("presence"),
        F.count(F.when(F.col("satellite") != "presence", 1)).alias("changes"),
    )
    order = Window.partitionBy(key).orderBy("load_date")
    ends = points.withColumn("version_to", F.lead("load_date").over(order))
    return ends.where(F.col("changes") > 0).select(key, F.col("load_date").alias("version_from"), "version_to")


def satellite_delta(current: DataFrame, batch: DataFrame, key: str, satellites: dict[str, list[str]], day: str) -> DataFrame:
    """Rows to append for one newly arrived snapshot, that of the date ``day`` (YYYY-MM-DD).

    ``current`` has the last row (key, satellite, hash_diff) of each key and
    satellite so far, presence included; ``batch`` the normalised rows of the
    date, one a key, and may be empty. Only hashes are compared; nothing that was
    loaded is read again. A key that is present and not in the batch vanishes
    (presence 0); one that is in the batch and wasn't present appears (presence
    1, and a row for each satellite, changed or not). Appending the deltas of all
    dates in order gives what ``satellite_rows`` gives at once.
    """
    date = F.lit(day).cast("date")
    none = F.create_map().cast("map<string,string>")
    known = current.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("satellite", "hash_diff"))).alias("known"))
    both = batch.withColumn("here", F.lit(True)).join(known, key, "full")
    was = F.coalesce(F.col("known")["presence"] == 1, F.lit(False))
    here = F.coalesce("here", F.lit(False))
    parts = []
    for name, columns in satellites.items():
        value = hash_diff(columns)
        changed = here & (~was | F.coalesce(F.col("known")[name] != value, F.lit(True)))
        parts.append(F.when(changed, F.struct(
            F.lit(name).alias("satellite"), date.alias("load_date"), value.alias("hash_diff"),
            F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]).alias("attributes"))))
    parts += [F.when(flag, F.struct(F.lit("presence").alias("satellite"), date.alias("load_date"),
                                    F.lit(value).cast("long").alias("hash_diff"), none.alias("attributes")))
              for flag, value in ((here & ~was, 1), (was & ~here, 0))]
    return both.select(key, F.explode(F.array_compact(F.array(*parts))).alias("row")).select(key, "row.*")


def last_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, satellite, hash_diff): the latest row of each, what ``satellite_delta`` compares with."""
    return rows.groupBy(key, "satellite").agg(F.max(F.struct("load_date", "hash_diff"))["hash_diff"].alias("hash_diff"))


def memory_satellites(raw: DataFrame) -> DataFrame:
    """Satellites of memory_snapshots. An empty table gives an empty result."""
    rows = normalise_snapshots(raw)
    attributes = [c for columns in SATELLITES.values() for c in columns]
    latest = latest_per_date(rows, "memory_id", "snap_date", "loaded_at", attributes)
    return satellite_rows(latest, calendar(raw, "snap_date"), "memory_id", "snap_date", SATELLITES)


def memory_versions(raw: DataFrame) -> DataFrame:
    """(memory_id, version_from, version_to) as texts; an open version ends at 9999-12-31."""
    view = version_view(memory_satellites(raw), "memory_id")
    return view.select(
        "memory_id",
        F.date_format("version_from", "yyyy-MM-dd").alias("version_from"),
        F.coalesce(F.date_format("version_to", "yyyy-MM-dd"), F.lit(OPEN_END)).alias("version_to"),
    )


def end_states(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory_id, hash) at the first and at the last date of memory_snapshots; the hash is over all four attributes."""
    rows = normalise_snapshots(raw)
    ends = raw.agg(F.min("snap_date").alias("first"), F.max("snap_date").alias("last"))
    attributes = [c for columns in SATELLITES.values() for c in columns]

    def at(end: str) -> DataFrame:
        day = rows.join(F.broadcast(ends.select(F.col(end).alias("snap_date"))), "snap_date")
        return latest_per_date(day, "memory_id", "snap_date", "loaded_at", attributes).select("memory_id", hash_diff(attributes).alias("hash"))

    return at("first"), at("last")
