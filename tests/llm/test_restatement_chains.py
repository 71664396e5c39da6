"""Matches that aren't transitive: leader rounds must neither lose an entry nor change its root."""

import datetime as dt

import pytest

from mnemospark.llm import restatements as r

T = dt.datetime(2026, 1, 1)
L = "decision cache key in docs/a.md stays at 62 pages by v7.0.9"
X = "decision cache key in docs/a.md limited to 62 sheets by v7.0.9"
Y = "ruling lookup handle in docs/a.md limited to 62 sheets by v7.0.9"


def found(spark, texts, rounds):
    rows = [(f"m{k}", t, T + dt.timedelta(days=k)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string, asserted_at timestamp")
    return sorted(tuple(x) for x in r.restatements(df, rounds, 1, 1).collect())


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_an_entry_is_found_through_one_that_matched_a_leader(spark, rounds):
    assert found(spark, [L, X, Y], rounds) == [("m1", "m0"), ("m2", "m0")]


@pytest.mark.parametrize("rounds", [0, 2])
def test_an_earlier_match_that_leads_no_list_is_kept(spark, rounds):
    first, other, later = "ruling lookup handle in docs/a.md limited to 62 sheets by v7.0.9", "notes zu docs/a.md 62 v7.0.9 ganz eigene worte hier", X
    assert found(spark, [other, L, first, later], rounds) == [("m3", "m1")]


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_change_nothing_in_a_mixed_list(spark, rounds):
    texts = [Y, L, X, "notes zu docs/a.md 62 v7.0.9 ganz eigene worte hier", X + " thanks", L + " thanks", Y + " thanks"]
    assert found(spark, texts, rounds) == found(spark, texts, 0)
