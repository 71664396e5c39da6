"""Restatements: pairs by kind of change, and day after day against all at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import restatements as r

T = dt.datetime(2026, 1, 1)
FACT = "Decision: the cache key in docs/session/strict-gate.md stays at 62 pages until v7.0.9. the velvet team wants it checked with GateRecall before v4.7.8."
SAME = [
    "[auto] " + FACT + " thanks", FACT.upper().replace("DOCS/SESSION/STRICT-GATE.MD", "docs/session/strict-gate.md"),
    "the velvet team wants it checked with GateRecall before v4.7.8; decision: the cache key in docs/session/strict-gate.md stays at 62 pages until v7.0.9",
    FACT.replace("stays", "stasy").replace("until", "till"), "1) " + FACT.replace(" ", " "), FACT.replace("62", "６２"),
]
OTHER = [
    FACT.replace("62", "63"), FACT.replace("strict-gate.md", "strict-gate.py"), FACT.replace("stays", "never stays"),
    FACT.replace("GateRecall", "QueueRecall"), FACT.replace("v7.0.9", "v4.7.8X").replace("before v4.7.8", "before v7.0.9").replace("X", ""),
]


def entries(spark, texts, days=None):
    rows = [(f"m{k:02d}", t, T + dt.timedelta(days=days[k] if days else k), "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, content string, asserted_at timestamp, tokens string, earlier int")


def found(df):
    return sorted(tuple(x) for x in r.restatements(df, batches=1).collect())


def test_same_and_other_statements(spark):
    got = found(entries(spark, [FACT, *SAME, *OTHER]))
    assert got == [(f"m{k:02d}", "m00") for k in range(1, len(SAME) + 1)]


def test_direction_and_polarity():
    move = "we moved the flag from src/a.py to src/b.py"
    assert not r.same_statement(move, "", "we moved the flag from src/b.py to src/a.py", "")
    assert r.same_statement(move, "", "we shifted the flag from src/a.py to src/b.py", "")
    for a, b in (("it must not run", "it must run"), ("larger than", "smaller than"), ("不要改", "必须改"), ("nicht so", "stets so"),
                 ("without tests", "after tests")):
        assert r.polarity(a, a.split()) != r.polarity(b, b.split())
    for a, b in (("never raise", "do not ever raise"), ("does not", "doesn't"), ("否则", "不然"), ("larger", "bigger"), ("nicht", "nihct"),
                 ("keine einen", "keine enen")):
        assert r.polarity(a, a.split()) == r.polarity(b, b.split())


def test_nulls_blanks_repeats_and_ties(spark):
    rows = [("a", FACT, None, "", 1), ("b", FACT, T, "", 1), ("b", FACT, T, "", 1), ("c", FACT, T, "", 1), ("d", None, T, "", 1),
            ("e", " ", T, "", 1), (None, FACT, T, "", 1), ("f", "ok", T, "", 1), ("g", "ok", T, "", 1), ("h", "word " * 20000, T, "", 1)]
    df = spark.createDataFrame(rows, "id string, content string, asserted_at timestamp, tokens string, earlier int")
    assert found(df) == [("a", "b"), ("c", "b"), ("g", "f")]


def test_empty_table(spark):
    assert found(entries(spark, [])) == []


@pytest.mark.parametrize("rounds", [1, 3])
def test_leader_rounds_change_nothing(spark, rounds):
    df = entries(spark, [FACT, *OTHER, *SAME])
    assert sorted(tuple(x) for x in r.restatements(df, rounds, 1, 1).collect()) == found(df)


DAYS = [0, 0, 1, 1, 1, 2, 2, 2]
TEXTS = [FACT, SAME[0], OTHER[0], SAME[1], OTHER[0] + " thanks", SAME[2], "fresh note on src/x.py with 5 pages and 17 rows", SAME[3]]


def day(df, k):
    return df.where(f"asserted_at = timestamp'{T + dt.timedelta(days=k)}'")


def test_day_after_day_equals_all_at_once_and_the_folder_can_be_reopened(spark, tmp_path):
    df = entries(spark, TEXTS, DAYS)
    for k in range(3):
        r.PrefixIndex(spark, str(tmp_path / "index")).check(day(df, k), f"2026-01-0{k + 1}")
    index = r.PrefixIndex(spark, str(tmp_path / "index"))
    assert index.batches() == ["2026-01-01", "2026-01-02", "2026-01-03"]
    got = sorted(tuple(x) for x in index.restatements().collect())
    assert got == found(df)
    index.check(day(df, 1), "2026-01-02")  # a batch taken again leaves everything as it was
    assert sorted(tuple(x) for x in index.restatements().collect()) == got
    assert index._read("postings", index.batches()).count() == len({tuple(x) for x in index._read("postings", index.batches()).collect()})


def test_late_batches_become_the_earlier_half(spark, tmp_path):
    df = entries(spark, TEXTS, DAYS)
    index = r.PrefixIndex(spark, str(tmp_path / "index"))
    for k in (2, 0, 1):
        index.check(day(df, k), str(k))
    assert sorted(tuple(x) for x in index.restatements().collect()) == found(df)


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    df = entries(spark, TEXTS, DAYS)
    index = r.PrefixIndex(spark, str(tmp_path / "index"))
    index.check(day(df, 0), "a")
    stored = index._read("postings", ["a"]).where(F.col("bucket").isin([1, 2]))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan.replace("isnotnull", "") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_every_cut_into_batches_gives_the_same(spark):
    df = entries(spark, [FACT, *OTHER, *SAME, FACT, SAME[0]])
    assert found(df) == sorted(tuple(x) for x in r.restatements(df, 1, 3, 2).collect())
