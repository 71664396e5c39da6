"""Asked rows against all others: the best of each is the one that all pairs give, and few pairs leave the tasks."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.operators import associate, blocks, similar

T = dt.datetime(2026, 1, 1)
ENTRY = "id string, status string, asserted_at timestamp, kind string, valid_at timestamp, content string"


def entries(spark, rows):
    return spark.createDataFrame([(i, s, T + dt.timedelta(hours=h), k, T, c) for i, s, h, k, c in rows], ENTRY)


def decided(rows, i, by_kind):
    """The decision and the other of one row by all pairs, as the SQL has it."""
    _, _, at, kind, text = next(r for r in rows if r[0] == i)
    t, met = set(text.split()), []
    for j, status, h, k, c in rows:
        u = set(c.split())
        if status == "active" and (h, j) < (at, i) and t and 10 * len(t & u) >= 3 * len(t) and (k == kind or not by_kind):
            same = text.replace(" ", "") == c.replace(" ", "")
            cover, like = (1.0, 1.0) if same else (round(len(t & u) / len(t), 6), round(len(t & u) / len(t | u), 6))
            met.append((cover, like, j, not same and bool(t - u)))
    if not met:
        return "add", None
    cover, _, other, adds = min(met, key=lambda m: (-m[0], m[2]))
    if cover >= 0.75 and len(t) >= 5 and not adds:
        return "duplicate", other
    _, like, other, _ = min(met, key=lambda m: (-m[1], m[2]))
    return ("link", other) if like >= 0.3 else ("add", None)


def drawn(seed):
    draw = random.Random(seed)
    words = ["hot"] * 4 + ["warm"] * 3 + [f"x{c}" for c in "abcdefghijklmp"]
    rows = []
    for k in range(150):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(0, 9)))
        if k % 5 == 1:  # an earlier text again, sometimes with spaces elsewhere
            text = rows[draw.randrange(len(rows))][4].replace(" ", draw.choice([" ", ""]), 1)
        rows.append((f"{draw.randrange(1000):03}{k:03}", draw.choice(["active"] * 4 + ["merged"]), draw.randrange(12), draw.choice(["fact", "fact", "event", "rule", None]), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_and_evolutions_against_all_pairs(spark, seed):
    rows = drawn(seed)
    df = entries(spark, rows)
    got = {r.id: (r.decision, r.other) for r in associate.decisions(df, df.select("id")).collect()}
    assert got == {r[0]: decided(rows, r[0], False) for r in rows}
    got = {r.id: (r.action, r.other) for r in associate.evolutions(df, df.select("id")).collect()}
    assert got == {r[0]: ("add", None) if r[3] == "rule" else decided(rows, r[0], True) for r in rows}


def test_an_equal_print_with_few_equal_tokens_is_no_pair(spark):
    rows = [("a", "active", 0, "fact", "aabbcc dd"), ("z", "active", 1, "fact", "aa bb cc dd"), *[(f"zz{k}", "active", 2, "fact", "aa bb cc") for k in range(3)]]
    df = entries(spark, rows)
    assert [tuple(r)[:3] for r in associate.decisions(df, df.select("id").where("id = 'z'")).collect()] == [("z", "add", None)]


def test_alike_entries_make_few_pairs(spark):
    df = entries(spark, [(f"m{k:03}", "active", k % 7, "fact", f"the cache key of page {k} stays") for k in range(120)])
    asked = df.select("id").where("id like '%5'")
    assert associate.compared(df, asked)[1].count() <= 2 * 12


def test_alike_entries_of_all_kinds_make_few_pairs_and_the_same_actions(spark):
    kinds = ["fact", "event", None]
    df = entries(spark, [(f"m{k:03}", "active", k // 7, kinds[k % 3], f"the cache key of page {'no longer ' * (k % 2)}stays at {k // 30}") for k in range(120)])
    asked = df.select("id").where("id in ('m029', 'm031', 'm119')")
    assert associate.compared(df, asked, by_kind=True)[1].count() <= 3 * 3
    # the earlier text with other numbers covers m031 most; m119's first equal text is of another kind
    got = sorted(tuple(r) for r in associate.evolutions(df, asked).collect())
    assert got == [("m029", "duplicate", "m005"), ("m031", "supersede", "m001"), ("m119", "duplicate", "m095")]


@pytest.mark.parametrize("dense,cells,step", [(256, 1 << 21, 1), (2, 40, 3), (1, 1, 1)])
def test_counts_of_dense_and_rare_tokens(monkeypatch, dense, cells, step):
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(blocks, "CELLS", cells)
    rows = [(i, h, sorted(set(c.split()))) for i, _, h, _, c in drawn(3) if c]
    columns = {"id": pa.array([r[0] for r in rows]), "at": pa.array([r[1] for r in rows]), "t": pa.array([r[2] for r in rows])}
    block, batch = blocks.Block(pa.table(columns).slice(0, 40), None), pa.record_batch({**columns, "t": pa.array([[*r[2], "new"] for r in rows])})
    others, mine = blocks.Others(batch, block), {r[0]: set(r[2]) for r in rows}
    seen, asked = 0, np.arange(5, block.n, step)
    for some in others.pieces(np.arange(len(rows)), block.n):
        got = block.shared(asked, others, some)
        assert got.tolist() == [[len(mine[a] & mine[b]) for b in others.column["id"][some]] for a in np.array(block.column["id"])[asked]]
        assert (block.at_most(others, some)[asked] >= got.max(axis=1)).all()
        seen += len(some)
    assert seen == len(rows)


def test_the_first_later_one_of_many_alike(spark):
    rows = [(f"m{k:03}", "active", k // 6, "fact", f"the cache key of page {k} stays") for k in range(120)]
    df = entries(spark, rows).selectExpr("*", "if(id like '%0', null, 'p') as project")
    asked = df.select("id").where("id in ('m010', 'm025', 'm117')")
    assert sorted((r.id, r.newer, r.overlap, r.days) for r in similar.first_later(df, asked).collect()) == [
        ("m010", "m020", round(6 / 7, 6), round(2 / 24, 4)), ("m025", "m031", round(6 / 7, 6), round(1 / 24, 4))]


@pytest.mark.parametrize("seed", [4, 5])
def test_first_later_against_all_pairs_in_few_small_jobs(spark, seed):
    rows, want = drawn(seed), []
    df = entries(spark, rows).selectExpr("*", "kind as project")
    for i, _, h, p, c in rows:
        t = set(c.split())
        later = [(g, j, round(len(t & u) / min(len(t), len(u)), 6)) for j, _, g, q, d in rows
                 if (q or "") == (p or "") and g > h and t and (u := set(d.split()))]
        want += [(i, j, o, round((g - h) / 24, 4)) for g, j, o in sorted(m for m in later if m[2] >= 0.3)[:1]]
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    got = similar.first_later(df, df.select("id"))
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before <= 12
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
