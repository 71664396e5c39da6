"""Interval joins, repeats and curves: hand-computed cases, nulls, ties and empty tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mnemospark.operators import evaluate, intervals, similar

T = dt.datetime(2026, 1, 10)
ENTRY = "id string, project string, asserted_at timestamp, content string, turn_id int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def at(**k):
    return T + dt.timedelta(**k)


def test_gold_pairs(spark):
    turns = spark.createDataFrame([("t1", "p", T, "the cache key"), ("t2", "p", at(hours=1), "缓存键"), ("t3", None, T, "cache"), ("t4", "p", None, "cache"),
                                   ("t5", "p", T, None), ("t1", "p", T, "the cache key")], "turn_id string, project string, at timestamp, text string")
    entries = spark.createDataFrame([
        ("a", "p", T, "cache", 0), ("b", "p", at(minutes=120), "A CACHE", 0), ("c", "p", at(minutes=120, microseconds=1), "cache", 0),
        ("d", "p", at(seconds=-1), "cache", 0), ("e", "q", T, "cache", 0), ("f", "p", at(hours=2), "缓存满", 0), ("g", "p", T, "x key", 0), ("h", "p", T, None, 0),
        ("i", "p", None, "cache", 0), (None, "p", T, "cache", 0)], ENTRY)
    assert rows(intervals.gold_pairs(turns, entries)) == [("t1", "a"), ("t1", "b"), ("t1", "g"), ("t2", "f")]
    assert intervals.gold_pairs(turns.limit(0), entries.limit(0)).count() == 0


def test_counts_before_a_point(spark):
    draw = random.Random(1)
    times = [(draw.choice("ab"), at(hours=draw.randrange(96))) for _ in range(60)]
    points = [(draw.choice("abz"), at(hours=draw.randrange(96)), k) for k in range(20)]
    got = intervals.counted_before(spark.createDataFrame(points, "k string, at timestamp, name int"), spark.createDataFrame(times, "k string, at timestamp"), "k")
    assert sorted((r.name, r.n) for r in got.collect()) == [(name, sum(k == key and t < p for k, t in times)) for key, p, name in points]


def test_recurrence(spark):
    rules = spark.createDataFrame([("r", "p", T, "never push main"), ("g", None, T, "push main"), ("s", "p", T, "one"), ("n", "p", None, "push main"), ("o", "p", T, None)],
                                  "id string, project string, at timestamp, content string")
    messages = spark.createDataFrame([
        ("m1", "p", at(days=-14), "no push main"), ("m2", "p", at(hours=-2), "push main"), ("m3", "p", T, "push main"), ("m4", "p", at(days=14), "main push"),
        ("m5", "q", at(hours=1), "push main"), ("m6", "p", at(hours=1), "push"), ("m7", "p", at(days=14, microseconds=1), "push main"), ("m8", None, T, None)],
        "msg_id string, project string, at timestamp, text string")
    starts = spark.createDataFrame([("p", at(days=-14)), ("p", at(hours=-2)), ("p", at(hours=-3)), ("p", T), ("p", at(days=14)), ("q", at(days=1)), (None, T), ("p", None)],
                                   "project string, at timestamp")
    got = intervals.recurrence(rules, messages, starts)
    assert rows(got) == [("g", 1, 2, 2, 2), ("r", 1, 1, 2, 1)]
    assert rows(intervals.reduction(got)) == [(2, 2, round(1 - 2.0 / 1.0, 6))]
    assert rows(intervals.reduction(got.limit(0))) == [(0, 0, None)]
    assert intervals.recurrence(rules.limit(0), messages.limit(0), starts.limit(0)).count() == 0


def test_repeats_within_a_day(spark):
    data = [("x", T), ("x", at(hours=20)), ("x", at(hours=44)), ("x", at(hours=68, microseconds=1)), ("x", T), ("y", T), (None, T), ("y", None)]
    df = spark.createDataFrame(data, "text string, at timestamp").withColumn("other", F.lit(1))
    assert [(r.text, r.at) for r in intervals.without_repeats(df, "text", "at").orderBy("text", "at").collect()] == [
        ("x", T), ("x", at(hours=68, microseconds=1)), ("y", T)]
    assert intervals.without_repeats(df.limit(0), "text", "at").count() == 0


def test_activity_and_half_life(spark):
    df = spark.createDataFrame([("a", T), ("a", at(days=4)), ("b", T), ("b", at(days=1)), (None, T), ("c", None)], "project string, at timestamp")
    curve = intervals.activity_curve(df, [1, 2, 9])
    assert rows(curve) == [(1, 3, round(2 / 3, 6)), (2, 3, round(1 / 3, 6)), (9, 0, None)]
    exact = spark.createDataFrame([(2, 2000, 0.5), (4, 2000, 0.25), (6, 10, 0.9), (8, 2000, 0.0)], "d int, n long, alive double")
    assert rows(intervals.half_life(exact)) == [(2, 2.0)]
    assert rows(intervals.half_life(exact.limit(0))) == [(0, None)] and rows(intervals.activity_curve(df.limit(0), [1])) == [(1, 0, None)]


def test_first_later(spark):
    data = [("a", "p", T, "aa bb cc"), ("b", "p", at(seconds=59), "aa bb cc"), ("c", "p", at(seconds=60), "aa xx yy"), ("d", "p", at(seconds=60), "aa bb"), ("e", "q", at(days=1), "aa bb cc"),
            ("f", "p", None, "aa"), ("n", None, T, "aa bb"), ("o", None, at(days=2), "bb"), ("a", "p", T, "aa bb cc")]
    df = spark.createDataFrame([(*r, 1) for r in data], ENTRY)
    got = similar.first_later(df, df.select("id").where("id in ('a', 'n', 'f')"))
    assert rows(got) == [("a", "c", round(1 / 3, 6), round(60 / 86400, 4)), ("n", "o", 1.0, 2.0)]
    assert similar.first_later(df.limit(0), df.select("id")).count() == 0


def test_cluster_bootstrap(spark):
    flat = spark.createDataFrame([(f"s{k}", True, True) for k in range(9)] + [(None, False, False)], "g string, a boolean, p boolean")
    assert rows(evaluate.cluster_bootstrap(flat, "g", F.col("a"), F.col("p"), 30)) == [(1.0, 1.0, 0.0, 0.0)]
    assert rows(evaluate.cluster_bootstrap(flat.limit(0), "g", F.col("a"), F.col("p"), 5)) == [(None, None, None, None)]
