"""Changes between exports count every attribute, by normal forms."""

import datetime as dt

from mnemospark.plans import store_queries

A, B = dt.date(2026, 1, 5), dt.date(2026, 3, 30)
SCHEMA = "memory_id string, snap_date date, loaded_at timestamp, status string, expires_at string, valid_at string, merged_from string"


def test_every_attribute_counts_and_spelling_does_not(spark, tmp_path):
    at = "2026-01-01T10:00:00Z"
    ends = {
        "status": (("active", None, at, "[]"), ("merged", None, at, "[]")), "merged": (("active", None, at, None), ("active", None, at, '["x"]')),
        "expires": (("active", None, at, None), ("active", at, at, None)), "valid": (("active", None, at, None), ("active", None, None, None)),
        "spelt": ((None, "", at, "[]"), ("Active ", "null", "2026-01-01 12:00:00+02:00", None)),
        "order": (("active", None, at, '["x","y"]'), ("active", None, at, '["y", "x"]')),
        "gone": (("active", None, at, None), None), "new": (None, ("active", None, at, None)),
    }
    rows = [(id_, day, dt.datetime(2026, 4, 1), *state) for id_, pair in ends.items() for day, state in zip((A, B), pair) if state]
    rows.append(("status", B, dt.datetime(2026, 3, 31), "active", None, at, "[]"))  # an earlier load of the same export
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/memory_snapshots.parquet")
    got = {x.change: x.n for x in store_queries.snapshot_changes(spark, str(tmp_path)).collect()}
    assert got == {"updated": 4, "unchanged": 2, "removed": 1, "added": 1}
