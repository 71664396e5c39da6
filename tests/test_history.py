"""Versions from snapshots: hand-computed cases and a brute-force replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import history

SCHEMA = "memory_id string, snap_date date, valid_at string, status string, expires_at string, merged_from string, loaded_at timestamp, ordinal int"
DAYS = [dt.date(2026, 1, 5) + dt.timedelta(days=7 * k) for k in range(5)]
T0 = dt.datetime(2026, 3, 1)


def row(id_, day, status="active", valid="2026-01-01T00:00:00Z", expires=None, merged=None, loaded=0):
    return (id_, DAYS[day] if day is not None else None, valid, status, expires, merged, T0 + dt.timedelta(hours=loaded), 7)


def versions(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in history.memory_versions(df).collect())


def test_spelling_is_no_change(spark):
    rows = [
        row("a", 0, " Active ", "2026-01-01 00:00:00", "", "[]"),
        row("a", 1, None, "2026-01-01T02:00:00+02:00", "null", None),
        row("a", 2, "ACTIVE", "2026-01-01T00:00:00.000Z", None, "null"),
        row("b", 0), row("b", 1), row("b", 2), row("b", 3), row("b", 4),
    ]
    assert versions(spark, rows) == [("a", "2026-01-05", "2026-01-26"), ("b", "2026-01-05", "9999-12-31")]


def test_change_absence_return_and_order_of_sets(spark):
    rows = [row("a", 0, merged='["x","y"]'), row("a", 1, merged='["y", "x", "x"]'), row("a", 3), row("a", 4, "expired"),
            row("z", 2)]
    assert versions(spark, rows) == [
        ("a", "2026-01-05", "2026-01-19"), ("a", "2026-01-26", "2026-02-02"), ("a", "2026-02-02", "9999-12-31"),
        ("z", "2026-01-19", "2026-01-26")]


def test_latest_load_counts_and_keyless_rows_do_not(spark):
    rows = [row("a", 0, "expired", loaded=1), row("a", 0, "active", loaded=5), row("a", 0, "active", loaded=5), row("a", 1),
            row(None, 1), row("a", None)]
    assert versions(spark, rows) == [("a", "2026-01-05", "9999-12-31")]


def test_malformed_values_stand_for_themselves(spark):
    rows = [row("a", 0, valid="soon", merged="{"), row("a", 1, valid="soon", merged="{"), row("a", 2, valid="later", merged="{")]
    assert versions(spark, rows) == [("a", "2026-01-05", "2026-01-19"), ("a", "2026-01-19", "9999-12-31")]


def test_empty_table(spark):
    assert versions(spark, []) == []


def test_delta_appends_only_changes(spark):
    first = history.normalise_snapshots(spark.createDataFrame([row("a", 0), row("b", 0), row("d", 0)], SCHEMA)).drop("loaded_at")
    none = spark.createDataFrame([], "memory_id string, satellite string, hash_diff long")
    start = history.satellite_delta(none, first, "memory_id", history.SATELLITES, "2026-01-05")
    assert start.count() == 12
    second = history.normalise_snapshots(spark.createDataFrame([row("a", 1, "expired"), row("b", 1), row("c", 1)], SCHEMA)).drop("loaded_at")
    new = history.satellite_delta(start, second, "memory_id", history.SATELLITES, "2026-01-12")
    assert sorted((r.memory_id, r.satellite, r.hash_diff if r.satellite == "presence" else None) for r in new.collect()) == [
        ("a", "state", None), ("c", "origin", None), ("c", "presence", 1), ("c", "state", None), ("c", "validity", None), ("d", "presence", 0)]
    assert history.satellite_delta(none, first.limit(0), "memory_id", history.SATELLITES, "2026-01-05").count() == 0


def test_deltas_of_all_dates_give_the_whole(spark):
    rows = [row("a", 0), row("a", 1), row("a", 3), row("a", 4, "expired"), row("b", 1, merged='["x"]'), row("b", 2), row("c", 4), row("d", 0), row("d", 4)]
    raw = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r.memory_id, r.satellite, str(r.load_date), r.hash_diff) for r in history.memory_satellites(raw).collect())
    so_far = spark.createDataFrame([], "memory_id string, satellite string, load_date date, hash_diff long, attributes map<string,string>")
    for d in DAYS:
        batch = history.normalise_snapshots(raw.where(F.col("snap_date") == F.lit(d))).drop("loaded_at")
        new = history.satellite_delta(history.last_rows(so_far, "memory_id"), batch, "memory_id", history.SATELLITES, str(d))
        so_far = spark.createDataFrame(so_far.unionByName(new).collect(), so_far.schema)
    assert sorted((r.memory_id, r.satellite, str(r.load_date), r.hash_diff) for r in so_far.collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    import random

    draw = random.Random(seed)
    rows = [row(f"m{draw.randrange(6)}", draw.randrange(5), draw.choice(["active", "Expired", None]), loaded=draw.randrange(50))
            for _ in range(60)]
    best = {}
    for r in rows:
        key = (r[0], r[1])
        value = (r[6], (r[3] or "active").lower())
        best[key] = max(best.get(key, value), value)
    dates, want = sorted({r[1] for r in rows}), []
    for m in {r[0] for r in rows}:
        current = None
        for k, d in enumerate([*dates, None]):
            state = best.get((m, d), (None, None))[1]
            if current and state != current[1]:
                want.append((m, str(current[0]), str(d) if d else "9999-12-31"))
                current = None
            if state and not current:
                current = (d, state)
    assert versions(spark, rows) == sorted(want)
