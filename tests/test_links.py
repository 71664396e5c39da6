"""Supersession on hand-computed cases."""

import datetime as dt
import random

import pytest

from mnemospark.operators import similar

T = dt.datetime(2026, 1, 1)


def superseded(spark, rows, **more):
    df = spark.createDataFrame([(i, "decision", None, T + dt.timedelta(days=d), c) for i, d, c in rows],
                               "id string, kind string, project string, valid_at timestamp, content string")
    return sorted(tuple(x) for x in similar.superseded(df, df.select("id").where("id like 'a%'"), **more).collect())


def test_a_revision_marker_lowers_the_overlap_needed(spark):
    old = "aa bb cc dd ee"
    rows = [("a1", 0, old), ("b1", 1, "aa bb xx yy zz"), ("b2", 2, "aa bb INSTEAD yy zz"), ("b3", 3, "aa instead xx yy zz")]
    assert superseded(spark, rows) == [("a1", "b2", 0.4)]
    assert superseded(spark, [*rows, ("b4", 1, "aa bb cc yy zz")]) == [("a1", "b4", 0.6)]
    assert superseded(spark, rows, marked=None) == []


def test_the_marker_counts_in_the_newer_text_only(spark):
    assert superseded(spark, [("a1", 0, "aa bb instead dd ee"), ("b1", 1, "aa bb xx yy zz")]) == []
    assert superseded(spark, [("a1", 0, "缓存键保留六页"), ("b1", 1, "缓存键改为七")]) == [("a1", "b1", 0.4)]


def test_null_fields_repeats_and_empty_tables(spark):
    assert superseded(spark, []) == []
    assert superseded(spark, [("a1", 0, None), ("a2", 0, ""), ("b1", 1, "..."), ("b1", 1, "...")]) == []
    assert superseded(spark, [("a1", 0, "aa bb"), ("b1", 1, "aa cc"), ("b1", 1, "aa cc")]) == [("a1", "b1", 0.5)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_superseded_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    words = ["hot"] * 6 + ["warm"] * 3 + [f"w{k}" for k in range(9)]
    rows = [(f"{draw.choice('abc')}{k:03}", draw.randrange(9), " ".join(draw.choice(words) for _ in range(draw.randrange(1, 9))) + draw.choice(["", "", " instead"]))
            for k in range(120)]
    want = []
    for i, d, c in rows:
        t, best = set(c.split()), None
        for j, e, other in rows:
            u = set(other.split())
            share = round(len(t & u) / min(len(t), len(u)), 6)
            if i[0] == "a" and e > d and (share >= 0.5 or share >= 0.35 and "instead" in u):
                best = min(best or (0, 0, ""), (-share, -e, j)) if best else (-share, -e, j)
        if best:
            want.append((i, best[2], -best[0]))
    assert superseded(spark, rows) == sorted(want)


@pytest.mark.parametrize("hot", [0.0, 0.1, 0.5, 1.0])
def test_links_are_the_same_wherever_hot_begins(spark, hot):
    draw = random.Random(7)
    tags = [(f"m{draw.randrange(60):02}", draw.choice(["hot", "Hot ", "warm", *[f"t{k}" for k in range(12)], None])) for _ in range(150)]
    entities = [(f"m{draw.randrange(60):02}", draw.choice(["big", "big", "mid", *[f"e{k}" for k in range(20)]])) for _ in range(90)] + [(None, "big")]
    items = {}
    for kind, weight, rows in (("t", 1, tags), ("e", 2, entities)):
        for i, x in rows:
            if i and x:
                items.setdefault(i, set()).add((kind + x.strip().lower(), weight))
    asked = sorted(items)[::5]
    want = []
    for a in asked:
        scored = sorted((-sum(w for _, w in items[a] & items[b]), b) for b in items if b != a and items[a] & items[b])
        want += [(a, b, -s) for s, b in scored[:3]]
    got = similar.structural_links(
        spark.createDataFrame(tags, "memory_id string, tag string"), spark.createDataFrame(entities, "memory_id string, entity string"),
        spark.createDataFrame([(a,) for a in asked], "id string"), hot=hot)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_links_of_empty_tables(spark):
    none = spark.createDataFrame([], "memory_id string, tag string, entity string")
    assert similar.structural_links(none, none, spark.createDataFrame([("a",)], "id string")).count() == 0
