"""Core operators on small hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from mnemospark.functions import scoring, text
from mnemospark.operators import dialogue, evaluate, graph, ledger, search, store


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_terms_of_mixed_script(spark):
    assert one(spark, text.terms, "修复 the Cache 缓存器 x") == ["the", "cache", "x", "修复", "缓存", "存器"]
    assert one(spark, text.terms, "中") == ["中"]
    assert one(spark, text.terms, None) == []
    assert one(spark, text.nfkc, "Ａｂ１") == "Ab1"


def test_text_functions(spark):
    assert one(spark, text.estimated_tokens, "ab中文cde") == 4
    assert one(spark, text.fingerprint, "A, b! C") == "abc"
    assert one(spark, text.fnv1a32, "abc") == 440920331
    assert one(spark, text.identifiers_in, "use warm-sweeper and GateRecall, not Plain") == ["warm-sweeper", "gaterecall"]
    assert one(spark, text.hash_tags, "#Config and #42 #a-b") == ["config", "a-b"]
    assert one(spark, text.paths_in, "see src/a/b.py, v1.2") == ["src/a/b.py"]
    assert one(spark, text.module_of, "src/a/b.py") == "src/a"


def test_scores(spark):
    kept = spark.range(1).select(scoring.retention(F.lit("event"), F.lit(3.0)), scoring.retention(F.lit("doc"), F.lit(900.0)),
                                 scoring.time_decay(F.lit("fact"), F.lit(180.0)), scoring.quality_factor(F.lit(5), F.lit(5))).first()
    assert [round(x, 6) for x in kept] == [0.5, 1.0, 0.5, 0.355556]


def test_greedy_fill_skips_and_prefix_stops(spark):
    rows = spark.createDataFrame([("p", 1, 50), ("p", 2, 900), ("p", 3, 40)], "k string, pos int, cost long")
    arrays = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("items"))
    assert [x["pos"] for x in arrays.select(store.greedy_fill(F.col("items"), "cost", 100)).first()[0]] == [1, 3]
    assert [r.pos for r in store.prefix_fill(rows, ["k"], [F.col("pos")], "cost", 100).collect()] == [1]


def test_coalescing_counts_from_the_last_counted_hit(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("u", t + dt.timedelta(seconds=s)) for s in (0, 40, 70, 100)] + [("v", t), (None, t), ("v", None)]
    got = ledger.coalesced(spark.createDataFrame(rows, "u string, at timestamp"), "u", "at", 60).collect()
    assert sorted((r.u, (r.at - t).seconds) for r in got) == [("u", 0), ("u", 70), ("v", 0)]


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 1), ("b", 9)] + [("c", k) for k in range(1, 21)] + [("c", None)], "k string, v int")
    got = {(r.k, r.q): r.value for r in ledger.nearest_rank(rows, ["k"], "v", [0.5, 0.95]).collect()}
    assert got == {("a", .5): 5, ("a", .95): 5, ("b", .5): 1, ("b", .95): 9, ("c", .5): 10, ("c", .95): 19}


def test_as_of_next_and_streaks(spark):
    t = dt.datetime(2026, 1, 1)
    left = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(seconds=9)), ("w", t)], "k string, at timestamp")
    right = spark.createDataFrame([("u", t, 1), ("u", t + dt.timedelta(seconds=5), 2)], "k string, at timestamp, v int")
    got = {(r.k, (r.at - t).seconds): r.next_value for r in ledger.as_of_next(left, right, "k", "at", "v").collect()}
    assert got == {("u", 0): 1, ("u", 9): None, ("w", 0): None}
    runs = spark.createDataFrame([("s", k, f) for k, f in enumerate([1, 1, 0, 1])], "k string, o int, f int")
    assert sorted((r.start, r.n) for r in ledger.streaks(runs, "k", ["o"], F.col("f") == 1).collect()) == [(0, 2), (3, 1)]


def test_chains_stop_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "from_id string, to_id string")
    got = {r.id: (r["last"], r.hops) for r in graph.chain_ends(edges).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "x": ("y", 1), "y": ("x", 1)}


def test_bm25_prefers_rare_terms_and_abstains(spark):
    docs = spark.createDataFrame([("d1", "the cache cache broke"), ("d2", "the ledger"), ("d3", None)], "doc_id string, text string")
    asked = spark.createDataFrame([("q1", "Cache the"), ("q2", "Zanzibar"), ("q3", "")], "query_id string, text string")
    got = [(r.query_id, r.doc_id) for r in search.top(search.bm25(docs, asked), 5).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "d1"), ("q1", "d2")]
    hits = spark.createDataFrame([("q1", "the cache")], "query_id string, text string")
    assert {r.query_id: r.abstain for r in search.abstains(hits, asked).collect()} == {"q1": False, "q2": True, "q3": False}


def test_fusion_and_mmr(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, doc_id string, rank int")
    fused = {r.doc_id: (round(r.score, 6), r.channels) for r in search.fuse([("a", a, 1.0), ("b", b, 1.0)]).collect()}
    assert fused == {"x": (round(1 / 21, 6), ["a"]), "y": (round(1 / 22 + 1 / 21, 6), ["a", "b"])}
    rows = [("q", "a", 1.0, ["x", "y"]), ("q", "b", 0.99, ["x", "y"]), ("q", "c", 0.8, ["z"])]
    picked = search.mmr(spark.createDataFrame(rows, "query_id string, doc_id string, score double, terms array<string>"), pick=2)
    assert [r.doc_id for r in picked.orderBy("rank").collect()] == ["a", "c"]


def test_measures(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "query_id string, doc_id string")
    got = {r.query_id: (r.recall, r.rr, r.hit) for r in evaluate.ranking_measures(ranked, gold, 10).collect()}
    assert got == {"q": (0.5, 0.5, True), "r": (0.0, 0.0, False)}
    rows = spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, True)], "s double, y boolean")
    assert round(evaluate.auc(rows, "s", "y").first().auc, 6) == 0.5
    assert evaluate.auc(rows.limit(0), "s", "y").first().auc is None


def test_nulls_and_empty_tables_of_the_store(spark):
    schema = ("id string, kind string, content string, source string, scope string, project string, valid_at timestamp, asserted_at timestamp, "
              "expires_at timestamp, importance int, confidence double, reinforcement int, last_hit_at timestamp, file string, status string, "
              "merged_from array<string>, key string")
    rows = [("m1", "event", None, None, None, None, None, None, None, None, None, None, None, None, None, None, "k")] * 2
    df = store.entries(spark.createDataFrame(rows, schema))
    assert df.count() == 1 and store.visible(df).count() == 1
    assert store.digest(df).count() == 0 and store.structured(df, contains="x").count() == 0
    assert store.consolidation(df, "2026-01-01 00:00:00").first().n == 1
    empty = store.entries(spark.createDataFrame([], schema))
    assert store.quality(empty).count() == 0 and store.digest(empty).count() == 0


def test_turn_pairs_take_the_last_step(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("m1", "s", "user/message", 1, None, "user", t, "hi", t), ("m2", "s", "assistant/message", 1, 2, None, t, "b", t),
            ("m3", "s", "assistant/message", 1, 1, None, t, "a", t), ("m1", "s", "user/message", 1, None, "user", t, "hi", t)]
    schema = "msg_id string, session string, type string, turn int, step int, source_kind string, at timestamp, text string, received_at timestamp"
    pairs = dialogue.turn_pairs(dialogue.speech(spark.createDataFrame(rows, schema))).collect()
    assert [tuple(r) for r in pairs] == [("s", 1, "m1", "m2")]
