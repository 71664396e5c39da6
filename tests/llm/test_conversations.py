"""Rebuilt conversations: hand-computed sessions, and both ways of ordering against each other."""

import datetime as dt

from pyspark.sql import functions as F

from mnemospark.llm import conversations as c

SCHEMA = ("msg_id string, session string, type string, turn int, step int, source_kind string, at timestamp, text string, "
          "received_at timestamp, pos int, role string")
T = dt.datetime(2026, 1, 1, 23, 59)


def user(id_, s, turn, minute, text="ask", got=0):
    return (id_, s, "user/message", turn, None, "user", T + dt.timedelta(minutes=minute), text, T + dt.timedelta(minutes=minute + got), 9, "x")


def bot(id_, s, turn, step, minute, text="answer", got=0):
    return (id_, s, "assistant/message", turn, step, None, T + dt.timedelta(minutes=minute), text, T + dt.timedelta(minutes=minute + got), 9, "x")


def run(spark, rows, **more):
    return sorted(tuple(r) for r in c.conversations(spark.createDataFrame(rows, SCHEMA), **more).select("session", "pos", "msg_id", "role").collect())


GOOD = [user("u1", "s", 1, 0), bot("b1", "s", 1, 1, -5), bot("b2", "s", 1, 2, -9, " "), bot("b3", "s", 1, 3, 3),
        user("u2", "s", None, 4), bot("b4", "s", 2, 1, 6)]
WANT = [("s", 1, "u1", "user"), ("s", 2, "b1", "assistant"), ("s", 3, "b3", "assistant"), ("s", 4, "u2", "user"), ("s", 5, "b4", "assistant")]


def test_order_ignores_clocks_and_blank_steps_do_not_come_out(spark):
    assert run(spark, GOOD) == WANT


def test_large_sessions_go_by_doubling_with_the_same_result(spark):
    assert run(spark, GOOD, stream_limit=0) == WANT


def test_latest_delivery_counts(spark):
    rows = [user("u1", "s", 1, 0, None), user("u1", "s", 1, 0, "later", got=60), bot("b1", "s", 1, 1, 1), bot("b1", "s", 1, 1, 1)]
    assert run(spark, rows) == [("s", 1, "u1", "user"), ("s", 2, "b1", "assistant")]


def test_broken_sessions_do_not_come_out(spark):
    rows = [
        user("a1", "gap", 1, 0), bot("a2", "gap", 1, 1, 1), user("a3", "gap", 3, 2), bot("a4", "gap", 3, 1, 3),
        user("b1", "no reply", 1, 0),
        user("c1", "twice", 1, 0), user("c2", "twice", 1, 1), bot("c3", "twice", 1, 1, 2),
        user("d1", "step gap", 1, 0), bot("d2", "step gap", 1, 1, 1), bot("d3", "step gap", 1, 3, 2),
        user("e1", "blank ask", 1, 0, "​ \n"), bot("e2", "blank ask", 1, 1, 1),
        user("f1", "blank reply", 1, 0), bot("f2", "blank reply", 1, 1, 1, None),
        user("g1", "lost end", 1, 0), bot("g2", "lost end", 1, 1, 1), user("g3", "lost end", None, 2),
        user("h1", "agent", 1, 0), bot("h2", "agent", 1, 1, 1),
        ("h3", "agent", "subagent/descriptor", None, None, None, T, None, T, 9, "x"),
        bot("i1", "no turn", None, 1, 1), user(None, "no id", 1, 0), (None,) * 11,
    ]
    assert run(spark, rows) == []


def test_empty_table(spark):
    assert run(spark, []) == []


def test_turn_is_found_across_midnight(spark):
    rows = [user("u1", "s", None, 0), bot("b1", "s", 1, 1, 200)]
    assert [r[2] for r in run(spark, rows)] == ["u1", "b1"]


def test_kahn_drops_cycles_and_both_ways_agree(spark):
    assert c.kahn(["a", "b", "c"], [3, 2, 1], [None, "a", "a"]) == [0, 2, 1]
    assert c.kahn(["a", "b", "c"], [1, 2, 3], ["b", "a", None]) == [2]
    edges = [("s", f"m{k}", T, True, f"m{k - 1}" if k else None) for k in range(40)] + [("t", "x", T, True, "y"), ("t", "y", T, True, "x")]
    edges += [("branch", x, T, True, y) for x, y in (("a", None), ("b", "a"), ("c", "a"))] + [("two", "a", T, True, None), ("two", "b", T, True, None)]
    df = spark.createDataFrame(edges, "session string, msg_id string, at timestamp, has_text boolean, reply_to string")
    sizes = df.groupBy("session").agg(F.count("*").alias("messages"))
    got = [sorted(tuple(r) for r in c.order_messages(df, sizes, n).collect()) for n in (100, 0)]
    assert got[0] == got[1] and len(got[0]) == 40 and ("s", "m7", True, 8) in got[0]
