"""Channels, demotion, decisions and measures: hand-computed cases."""

import datetime as dt

from mnemospark.operators import associate, evaluate, search

T = dt.datetime(2026, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nearest_in_blocks_equals_one_pass(spark):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)], "doc_id long, v array<double>")
    q = v.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    assert rows(search.nearest(v, q, 3)) == rows(search.nearest(v, q, 3, block=2)) and search.nearest(v.limit(0), q, 3).count() == 0


def test_graph_and_tag_channel(spark):
    seeds = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    edges = spark.createDataFrame([("a", x) for x in "bcdefg"] + [("h", "b"), (None, "a")], "from_id string, to_id string")
    docs = spark.createDataFrame([(x,) for x in "abdefgh"], "doc_id string")
    assert rows(search.graph_channel(seeds, edges, docs)) == [("q", "d", 1), ("q", "e", 2), ("q", "f", 3), ("q", "h", 4)]
    asked = spark.createDataFrame([("q", "cache"), ("q", "x")], "query_id string, term string")
    tags = spark.createDataFrame([("a", " Cache"), ("a", "x"), ("b", "x"), ("c", "x"), ("d", None), (None, "x"), ("b", "x")], "memory_id string, tag string")
    assert [(r.doc_id, r.score, r.rank) for r in search.tag_channel(asked, tags, docs).orderBy("rank").collect()] == [("a", 2, 1), ("b", 1, 2)]


def test_decisions(spark):
    base = "the cache of session alpha keeps entries for nine days"
    data = [("01", base, 0), ("02", "The cache of session alpha keeps entries for nine days!", 1), ("03", base + " since v2", 2), ("04", "cache of session alpha keeps entries", 3),
            ("05", "nothing alike here", 4), ("06", None, 5), ("07", "...", 6), ("08", "cache of", 7)]
    df = spark.createDataFrame([(i, c, "active", T + dt.timedelta(days=d), "fact", T, 1) for i, c, d in data],
                               "id string, content string, status string, asserted_at timestamp, kind string, valid_at timestamp, other int")
    got = {r.id: (r.decision, r.other) for r in associate.decisions(df, df.select("id")).collect()}
    assert got == {"01": ("add", None), "02": ("duplicate", "01"), "03": ("link", "01"), "04": ("duplicate", "01"), "05": ("add", None),
                   "07": ("add", None), "08": ("link", "04")}
    assert associate.decisions(df.limit(0), df.select("id")).count() == 0


def test_evolutions(spark):
    base = "the cache of session alpha keeps 9 entries"
    data = [("01", base, "fact", 0, "active"), ("02", "the cache of session alpha keeps 7 entries", "fact", 1, "merged"), ("03", "the cache of session beta never keeps entries", "lesson", 2, "merged"),
            ("04", "cache of session alpha changed to 7 entries", "fact", 3, "merged"), ("05", "cache of session alpha changed to 7 entries", "rule", 4, "merged"),
            ("06", "cache of session alpha changed to 7 entries", "fact", -1, "merged"), ("07", "cache of session alpha keeps 9 entries", "fact", 5, "merged"),
            ("08", "cache of session alpha keeps 9 entries", "lesson", 6, "merged"), ("09", None, "fact", 7, "merged"), ("10", "", None, 8, None), ("11", "cache keeps 9", "fact", 9, "merged")]
    df = spark.createDataFrame([(i, c, k, T + dt.timedelta(days=d), T + dt.timedelta(days=d), s, 1) for i, c, k, d, s in data],
                               "id string, content string, kind string, asserted_at timestamp, valid_at timestamp, status string, other int")
    got = {r.id: (r.action, r.other) for r in associate.evolutions(df, df.select("id")).collect()}
    assert got == {"01": ("add", None), "02": ("contradict", "01"), "03": ("contradict", "01"), "04": ("supersede", "01"), "05": ("add", None), "06": ("add", None),
                   "07": ("duplicate", "01"), "08": ("add", None), "10": ("add", None), "11": ("link", "01")}
    assert associate.evolutions(df.limit(0), df.select("id")).count() == 0


def test_evidence_themes_and_removal(spark):
    e = spark.createDataFrame([("a", T, "cache full"), ("b", T, "other"), ("c", T, "else")], "id string, valid_at timestamp, content string")
    o = spark.createDataFrame([("x", "a"), ("x", "gone"), ("x", "a")], "id string, origin string")
    assert [(r.n_found, r.n_missing) for r in associate.evidence(e, o).collect()] == [(1, 1)]
    tags = spark.createDataFrame([("b", "t"), ("c", "T "), ("a", "t"), ("b", "u"), (None, "t"), ("b", None)], "memory_id string, tag string")
    assert rows(associate.themes(e, tags, {"c": "cache"})) == [("#t", 2), ("c", 1)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "from_id string, to_id string")
    left, rest = associate.removed(e.select("id"), edges, e.where("id = 'b'").select("id"))
    assert rows(left) == [("a",), ("c",)] and rows(rest) == [("a", "c")]


def test_measures(spark):
    pairs = spark.createDataFrame([(True, False)] * 1 + [(False, True)] * 5 + [(True, True)] * 9, "a boolean, b boolean")
    assert rows(evaluate.mcnemar(pairs, "a", "b")) == [(5, 1, round(2 * (1 + 6) / 64, 6))]
    assert rows(evaluate.mcnemar(pairs.where("a and b"), "a", "b")) == [(0, 0, 1.0)]
    many = spark.createDataFrame([(True, False)] * 900 + [(False, True)] * 1100, "a boolean, b boolean")
    assert 0 < evaluate.mcnemar(many, "a", "b").first().p_value < 1e-4
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert rows(evaluate.set_scores(a, spark.createDataFrame([(2,), (3,)], "x int"))) == [(1, 1, 1, 0.5, 0.5, 0.5)]
    flat = spark.createDataFrame([(k, 0.5) for k in range(20)], "u int, x double")
    assert rows(evaluate.interval(evaluate.bootstrap(flat, "x", "u", 20))) == [(0.5, 0.5, 0.5)]


def test_a_newer_hit_demotes_the_older(spark):
    hits = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("r", "a", 1.0)], "query_id string, doc_id string, score double")
    e = spark.createDataFrame([("a", "fact", None, T, ["x", "y"]), ("b", "fact", None, T + dt.timedelta(days=1), ["x", "z"])],
                              "doc_id string, kind string, project string, valid_at timestamp, t array<string>")
    assert rows(search.demoted(hits, e).select("query_id", "doc_id", "score", "superseded")) == [("q", "a", 0.1, True), ("q", "b", 0.5, False), ("r", "a", 1.0, False)]
