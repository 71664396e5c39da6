"""Decay, quality and composite scores as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-life in days for ranking; kinds that are not listed do not decay. Fixed values.
HALF_LIFE = {"event": 7, "context": 30, "fact": 180, "lesson": 180, "pattern": 180, "preference": 365, "decision": 365}
#: (half-life in days, floor) of retention; others keep all. Fixed values.
RETENTION = {
    "event": (3, 0.0), "context": (7, 0.05), "lesson": (60, 0.15), "pattern": (60, 0.15), "fact": (45, 0.15),
    "preference": (90, 0.2), "decision": (41, 0.15), "rule": (41, 0.2),
}
#: Weight of a kind in ranking; 1 for the others. Fixed values.
KIND_WEIGHT = {"context": 0.45, "event": 0.3}


def _by_kind(kind: Column, table: dict[str, float], default: float | None) -> Column:
    out = F.lit(default).cast("double")
    for name, value in table.items():
        out = F.when(kind == name, F.lit(float(value))).otherwise(out)
    return out


def age_days(valid_at: Column, now: str) -> Column:
    """Days from a time to ``now``, at least 0."""
    seconds = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(valid_at)
    return F.greatest(seconds / F.lit(86_400_000_000.0), F.lit(0.0))


def time_decay(kind: Column, age: Column) -> Column:
    half = _by_kind(kind, HALF_LIFE, None)
    return F.when(half.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / half))


def retention(kind: Column, age: Column) -> Column:
    half = _by_kind(kind, {k: v[0] for k, v in RETENTION.items()}, None)
    floor = _by_kind(kind, {k: v[1] for k, v in RETENTION.items()}, 1.0)
    return F.when(half.isNull(), 1.0).otherwise(floor + (1 - floor) * F.pow(F.lit(0.5), age / half))


def reinforcement_factor(n: Column) -> Column:
    return 1 + F.log1p(F.coalesce(n, F.lit(0)).cast("double")) / 4


def quality_factor(bad: Column, shown: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), 1 - (bad + 0.8) / (shown + 4)))


def effective_confidence(confidence: Column, kept: Column, superseded: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.7)) * kept * F.when(superseded, 0.1).otherwise(1.0)


def composite(base: Column, kind: Column, age: Column, importance: Column, confidence: Column, hits: Column) -> Column:
    """Base score weighted by age, kind, importance (1 to 10), confidence and reinforcement."""
    return (
        base * time_decay(kind, age) * _by_kind(kind, KIND_WEIGHT, 1.0)
        * (0.6 + 0.4 * F.coalesce(importance, F.lit(5)) / 10) * (0.7 + 0.3 * F.coalesce(confidence, F.lit(0.7)))
        * reinforcement_factor(hits)
    )
