"""Queries of ranked retrieval over memories, documents and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evaluate, graph, search, store
from ..session import cut, small, spread, table
from .common import ENTRIES, NOW, terms
from .store_queries import COST, DECAY, EDGES

WITH = f"WITH {ENTRIES}"
#: Least cosine of the vector channel, and characters of a chunk; fixed values.
VECTOR_FLOOR, CHUNK = 0.35, 512


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Visible entries with text; kind, project and status for later stages."""
    return store.visible(store.entries(table(spark, d, "memories"))).where(F.col("content").isNotNull()).select(
        F.col("id").alias("doc_id"), F.col("content").alias("text"), "kind", "project", "scope", "status")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").where(F.col("query").isNotNull()).select(F.col("case_id").alias("query_id"), F.col("query").alias("text"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_docs(spark, d).select("doc_id", "text"), _asked(spark, d)).withColumn("score", F.round("score", 6))


def _best(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The n best of the lexical search."""
    return search.top(_lexical(spark, d), n)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, 10).select("query_id", "doc_id", "score", "rank")


def bm25_filtered_after_window(spark: SparkSession, d: str) -> DataFrame:
    """Filters of kind apply to the best thirty, not before: a filter after a limit keeps its meaning."""
    window = _best(spark, d, 30)
    kinds = _docs(spark, d).where(F.col("kind").isin("lesson", "decision")).select("doc_id")
    return window.join(kinds, "doc_id", "left_semi").select("query_id", "doc_id", "rank")


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per query how many documents pass the coverage gate."""
    sizes = search.query_terms(_asked(spark, d)).groupBy("query_id").agg(F.count("*").alias("n_terms"))
    scored = _lexical(spark, d).join(small(sizes), "query_id")
    return scored.where(search.qualifies(F.col("matched"), F.col("n_terms"))).groupBy("query_id").agg(F.count("*").alias("n"))


def _entity_channel(spark: SparkSession, d: str, seeds: DataFrame) -> DataFrame:
    """Entries that share identifiers with a query's seeds, most shared first."""
    docs = cut(_docs(spark, d).select("doc_id", F.explode(text.identifiers_in(F.col("text"))).alias("entity")))
    wanted = docs.join(small(seeds.select("query_id", "doc_id")), "doc_id").select("query_id", "entity").distinct()
    shared = docs.join(small(wanted), "entity").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    return search.top(shared.join(seeds, ["query_id", "doc_id"], "left_anti"), 16)


def _window(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the thirty best by words, the five best of them): ranked once."""
    window = cut(_best(spark, d, 30).select("query_id", "doc_id", "score", "rank"))
    return window, window.where(F.col("rank") <= 5)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and entity channel fused by reciprocal rank, ten best per query."""
    window, seeds = _window(spark, d)
    lists = [("bm25", window, 8.0), ("entity", _entity_channel(spark, d, seeds), 1.0)]
    fused = search.fuse(lists).withColumn("score", F.round("score", 8))
    return search.top(fused, 10).select("query_id", "doc_id", "score", F.array_join("channels", "+").alias("channels"), "rank")


def _channels(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, float]]:
    """Words, entities, tags and merge edges: each channel's ranking and weight."""
    window, seeds = _window(spark, d)
    docs = _docs(spark, d).select("doc_id")
    asked = search.query_terms(_asked(spark, d))
    return [("bm25", window, 8.0), ("entity", _entity_channel(spark, d, seeds), 1.0),
            ("graph", search.graph_channel(seeds, graph.merge_edges(table(spark, d, "memories")), docs), 1.0),
            ("tag", search.tag_channel(asked, table(spark, d, "tags"), docs), 1.0)]


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Four channels fused, the thirty best per query."""
    fused = search.fuse(_channels(spark, d)).withColumn("score", F.round("score", 8))
    return search.top(fused, 30).withColumn("channels", F.array_join("channels", "+")).select("query_id", "doc_id", "score", "channels", "rank")


def _vector_channel(spark: SparkSession, d: str) -> DataFrame:
    """The thirty entries per query whose hashed terms are nearest, from a cosine of 0.35 on; no coverage gate."""
    docs = _docs(spark, d).select("doc_id", text.hashed_vector(F.col("text")).alias("v"))
    asked = _asked(spark, d).select("query_id", text.hashed_vector(F.col("text")).alias("v"))
    return search.nearest(spread(docs, "doc_id"), asked, 30, VECTOR_FLOOR)


def vector_channel(spark: SparkSession, d: str) -> DataFrame:
    return _vector_channel(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def hybrid_channels(spark: SparkSession, d: str) -> DataFrame:
    """Five channels fused, the ten best per query: words, entities, tags, merge edges and vectors."""
    fused = search.fuse([*_channels(spark, d), ("vector", _vector_channel(spark, d), 1.0)]).withColumn("score", F.round("score", 8))
    return search.top(fused, 10).select("query_id", "doc_id", "score", F.array_join("channels", "+").alias("channels"), "rank")


def chunk_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five documents per query whose best chunk of 512 characters is nearest by hashed terms."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(CHUNK))
    chunks = spread(docs, "doc_id").select("doc_id", F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(CHUNK)))).alias("chunk"))
    asked = _asked(spark, d).select("query_id", text.hashed_vector(F.col("text")).alias("v"))
    near = search.nearest(chunks.select("doc_id", text.hashed_vector(F.col("chunk")).alias("v")), asked, 5)
    return near.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def fused_channels(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


def channel_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per set of channels: entries that some query reaches through it, and hits."""
    return _fused(spark, d).groupBy("channels").agg(F.count_distinct("doc_id").alias("entries"), F.count("*").alias("hits"))


def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits by composite score, those that a newer hit of the same query supersedes at a tenth; ten best per query."""
    rows = store.visible(store.entries(table(spark, d, "memories"))).where(F.col("content").isNotNull()).withColumnRenamed("id", "doc_id")
    composite = scoring.composite(F.col("score"), F.col("kind"), scoring.age_days(F.col("valid_at"), NOW), F.col("importance"),
                                  F.col("confidence"), F.col("reinforcement"))
    hits = cut(_fused(spark, d).select("query_id", "doc_id", "score"))
    scored = hits.join(rows, "doc_id").select("query_id", "doc_id", composite.alias("score"))
    entries = rows.select("doc_id", "kind", "project", "valid_at", text.token_set(F.col("content")).alias("t")).join(
        small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    final = search.demoted(scored, entries).withColumn("score", F.round("score", 6))
    return search.top(final, 10).select("query_id", "doc_id", "score", "superseded", "rank")


def paired_significance(spark: SparkSession, d: str) -> DataFrame:
    """McNemar's test of words alone against four channels: whether the best ten hold an expected entry."""
    gold = table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), F.explode(F.array_distinct("expect")).alias("doc_id"))
    window, _ = _window(spark, d)
    a = evaluate.ranking_measures(window, gold, 10).select("query_id", F.col("hit").alias("a"))
    b = evaluate.ranking_measures(_fused(spark, d), gold, 10).select("query_id", F.col("hit").alias("b"))
    return evaluate.mcnemar(a.join(b, "query_id"), "a", "b")


def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Eight diverse results of the forty best per query."""
    best = _best(spark, d, 40).select("query_id", "doc_id", "score")
    return search.mmr(best.join(_docs(spark, d).select("doc_id", text.token_set(F.col("text")).alias("terms")), "doc_id"))


def answer_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's twenty best those that fit 300 tokens, passing over what doesn't."""
    best = _best(spark, d, 20).join(
        _docs(spark, d).select("doc_id", (text.estimated_tokens(F.col("text")) + 8).alias("cost")), "doc_id")
    arrays = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "cost"))).alias("items"))
    return arrays.select("query_id", F.explode(store.greedy_fill(F.col("items"), "cost", 300)).alias("x")).select(
        "query_id", "x.doc_id", "x.rank", "x.cost")


def abstain_flags(spark: SparkSession, d: str) -> DataFrame:
    best = _best(spark, d, 5).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return search.abstains(best.select("query_id", "text"), _asked(spark, d))


def retrieval_measures(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank, nDCG and hits at ten of the lexical search, per type of case."""
    cases = table(spark, d, "eval_cases")
    gold = cases.select(F.col("case_id").alias("query_id"), F.explode(F.array_distinct("expect")).alias("doc_id"))
    per = evaluate.ranking_measures(_best(spark, d, 10), gold, 10)
    return per.join(cases.select(F.col("case_id").alias("query_id"), "type"), "query_id").groupBy("type").agg(
        F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("recall", "rr", "ndcg", "hit")])


def recall_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the lexical search's recall at ten over the queries: the 2.5 %, 50 % and 97.5 % points."""
    gold = table(spark, d, "eval_cases").select(F.col("case_id").alias("query_id"), F.explode(F.array_distinct("expect")).alias("doc_id"))
    per = evaluate.ranking_measures(_best(spark, d, 10), gold, 10)
    return evaluate.interval(evaluate.bootstrap(cut(per.select("query_id", "recall")), "recall", "query_id", 200))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    vectors = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return rows, vectors, asked


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest by cosine of every vector whose id is divisible by 100, against all."""
    _, vectors, asked = _vectors(spark, d)
    return search.nearest(vectors, asked, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def vector_class_precision(spark: SparkSession, d: str) -> DataFrame:
    rows, vectors, asked = _vectors(spark, d)
    near = search.nearest(vectors, asked, 10)
    a = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    b = rows.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"))
    return near.join(a, "query_id").join(b, "doc_id").groupBy("own").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("own") == F.col("other")) / F.count("*"), 6).alias("precision"))


def page_match(spark: SparkSession, d: str) -> DataFrame:
    """The best five documents per asked word list by heading (3 each) and text hits (up to 4 each)."""
    words = ["cache", "ledger", "summary", "session", "审核", "摘要"]
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    lower, head = F.lower("text"), F.lower(F.coalesce("heading", F.lit("")))
    score = F.lit(0)
    for w in words:
        times = F.size(F.split(lower, w)) - 1
        score = score + F.when(F.contains(head, F.lit(w)), 3).otherwise(0) + F.least(times, F.lit(4)) + F.when(times > 0, 2).otherwise(0)
    scored = docs.select("source", "doc_id", score.cast("long").alias("score")).where(F.col("score") > 0)
    return store.top_per_group(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 5).select("source", "doc_id", "score")


_LEX = f""", docs AS (SELECT id AS doc_id, content AS text, kind FROM visible WHERE content IS NOT NULL),
split AS (SELECT doc_id, {terms('text')} AS t FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM split) GROUP BY 1, 2),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_length FROM split),
asked AS (SELECT query_id, term FROM (SELECT case_id AS query_id, {terms('query')} AS raw FROM eval_cases WHERE query IS NOT NULL),
  LATERAL (SELECT term FROM (SELECT term, min(i) AS i FROM (SELECT unnest(raw) AS term, generate_subscripts(raw, 1) AS i) GROUP BY term) ORDER BY i LIMIT 64)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
lex AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score, count(*) AS matched
  FROM post JOIN df USING (term) JOIN asked USING (term), st GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex)
"""
_VEC = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label AS own FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT query_id, own, vec_id AS doc_id, label AS other, list_cosine_similarity(a, embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id <> query_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10)
"""
_IDS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z]*[a-z][A-Z][A-Za-z]+'), lambda x: lower(x)))"
_FUSED = f""", ent AS (SELECT doc_id, unnest({_IDS}) AS entity FROM docs),
  want AS (SELECT DISTINCT query_id, entity FROM ranked JOIN ent USING (doc_id) WHERE rank <= 5),
  seeds AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 5),
  ech AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, count(*) AS c FROM ent JOIN want USING (entity) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM seeds) GROUP BY 1, 2) QUALIFY rank <= 16),
  tch AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, count(*) AS c FROM (SELECT DISTINCT memory_id AS doc_id, lower(trim(tag)) AS term FROM tags) JOIN asked USING (term)
    WHERE doc_id IN (SELECT doc_id FROM docs) GROUP BY 1, 2) QUALIFY rank <= 16),
  {EDGES},
  near AS (SELECT query_id, seed, doc_id, rank AS seed_rank, row_number() OVER (PARTITION BY query_id, seed ORDER BY doc_id) AS place FROM (
    SELECT s.query_id, s.rank, n.seed, n.doc_id FROM seeds s JOIN (SELECT from_id AS seed, to_id AS doc_id FROM edges UNION SELECT to_id, from_id FROM edges) n ON n.seed = s.doc_id
    WHERE n.doc_id IN (SELECT doc_id FROM docs) AND (s.query_id, n.doc_id) NOT IN (SELECT (query_id, doc_id) FROM seeds))),
  gch AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS rank FROM (SELECT query_id, doc_id, min(seed_rank) AS r FROM near WHERE place <= 3 GROUP BY 1, 2)),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(s), 8) AS score, string_agg(ch, '+' ORDER BY ch) AS channels FROM (
      SELECT query_id, doc_id, 8.0::DOUBLE / (20 + rank) AS s, 'bm25' AS ch FROM ranked WHERE rank <= 30
      UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'entity' FROM ech UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'tag' FROM tch
      UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'graph' FROM gch) GROUP BY 1, 2) QUALIFY rank <= 30)
"""


def _hashed(name: str, source: str, key: str, body: str) -> str:
    """Unit vectors by hashed terms as rows (key, slot, x)."""
    words = f"regexp_extract_all(regexp_replace(lower({body}), '[\\x{{4E00}}-\\x{{9FFF}}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+')"
    pairs = (f"flatten(list_transform(regexp_extract_all({body}, '[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda r: "
             "list_transform(range(1, greatest(CAST(length(r) AS BIGINT), 2)), lambda i: substring(r, i, 2))))")
    return f"""{name}_t AS (SELECT {key}, term, sum(w) AS w FROM (SELECT {key}, unnest({words}) AS term, 1.0::DOUBLE AS w FROM {source}
        UNION ALL SELECT {key}, unnest({pairs}), 0.5 FROM {source}) GROUP BY 1, 2),
      {name}_h AS (SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(term) + 1), lambda i: unicode(substring(term, i, 1))::BIGINT)),
        lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 256 AS slot FROM (SELECT DISTINCT term FROM {name}_t)),
      {name}_s AS (SELECT {key}, slot, sum(w) AS w FROM {name}_t JOIN {name}_h USING (term) GROUP BY 1, 2),
      {name} AS (SELECT {key}, slot, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS x FROM {name}_s)"""


_VECTORS = ", " + _hashed("dv", "docs", "doc_id", "text") + ", " + _hashed("qv", "eval_cases", "case_id", "query") + """,
  vch AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT case_id AS query_id, doc_id, round(sum(dv.x * qv.x), 12) AS score FROM dv JOIN qv USING (slot) GROUP BY 1, 2) WHERE score >= 0.35 QUALIFY rank <= 30)"""
_GOLD = "gold AS (SELECT DISTINCT case_id AS query_id, unnest(expect) AS doc_id FROM eval_cases)"
_ASK = "(SELECT query_id, count(*) AS n_terms FROM asked GROUP BY 1)"

SQL = {
    "bm25_topk": WITH + _LEX + "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
    "bm25_filtered_after_window": WITH + _LEX + """SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM ranked
      WHERE rank <= 30 AND doc_id IN (SELECT doc_id FROM docs WHERE kind IN ('lesson', 'decision'))""",
    "coverage_gate": WITH + _LEX + f"""SELECT query_id, count(*) AS n FROM lex JOIN {_ASK} USING (query_id)
      WHERE matched >= 0.5 * n_terms OR (matched >= 2 AND matched::DOUBLE / n_terms >= 0.15) GROUP BY 1""",
    "rrf_fusion": WITH + _LEX + f""", ent AS (SELECT doc_id, unnest({_IDS}) AS entity FROM docs),
      want AS (SELECT DISTINCT query_id, entity FROM ranked JOIN ent USING (doc_id) WHERE rank <= 5),
      sh AS (SELECT query_id, doc_id, count(*) AS c FROM ent JOIN want USING (entity)
        WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM ranked WHERE rank <= 5) GROUP BY 1, 2),
      ech AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM sh QUALIFY rank <= 16),
      f AS (SELECT query_id, doc_id, round(sum(s), 8) AS score, string_agg(ch, '+' ORDER BY ch) AS channels FROM (
        SELECT query_id, doc_id, 8.0::DOUBLE / (20 + rank) AS s, 'bm25' AS ch FROM ranked WHERE rank <= 30
        UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'entity' FROM ech) GROUP BY 1, 2)
      SELECT query_id, doc_id, score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""",
    "fused_channels": WITH + _LEX + _FUSED + "SELECT query_id, doc_id, score, channels, CAST(rank AS INTEGER) AS rank FROM fused",
    "vector_channel": WITH + _LEX + _VECTORS + "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vch",
    "hybrid_channels": WITH + _LEX + _FUSED + _VECTORS + """, five AS (SELECT query_id, doc_id, round(sum(s), 8) AS score, string_agg(ch, '+' ORDER BY ch) AS channels FROM (
        SELECT query_id, doc_id, 8.0::DOUBLE / (20 + rank) AS s, 'bm25' AS ch FROM ranked WHERE rank <= 30
        UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'entity' FROM ech UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'tag' FROM tch
        UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'graph' FROM gch UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (20 + rank), 'vector' FROM vch) GROUP BY 1, 2)
      SELECT query_id, doc_id, score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM five QUALIFY rank <= 10""",
    "chunk_nearest": """WITH ck AS (SELECT doc_id, i, doc_id || ':' || i AS part, substring(text, i, 512) AS chunk
        FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 512)) AS i FROM documents WHERE text IS NOT NULL)), """
        + _hashed("dv", "ck", "part", "chunk") + ", " + _hashed("qv", "eval_cases", "case_id", "query") + """,
      sc AS (SELECT case_id AS query_id, part, round(sum(dv.x * qv.x), 12) AS score FROM dv JOIN qv USING (slot) GROUP BY 1, 2),
      best AS (SELECT query_id, doc_id, max(score) AS score FROM sc JOIN ck USING (part) GROUP BY 1, 2)
      SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 5""",
    "channel_coverage": WITH + _LEX + _FUSED + "SELECT channels, count(DISTINCT doc_id) AS entries, count(*) AS hits FROM fused GROUP BY 1",
    "ranked_hits": WITH + _LEX + _FUSED + f""", e AS (SELECT id AS doc_id, kind, coalesce(project, '') AS project, valid_at, list_distinct({terms('content')}) AS t, ({DECAY})
        * CASE kind WHEN 'context' THEN 0.45 WHEN 'event' THEN 0.3 ELSE 1 END * (0.6 + 0.4 * coalesce(importance, 5) / 10)
        * (0.7 + 0.3 * coalesce(confidence, 0.7)) * (1 + ln(1 + coalesce(reinforcement, 0)) / 4) AS weight FROM visible WHERE content IS NOT NULL),
      h AS (SELECT query_id, doc_id, score * weight AS score, kind, project, valid_at, t FROM fused JOIN e USING (doc_id)),
      b AS (SELECT DISTINCT a.query_id, a.doc_id FROM h a JOIN h n ON a.query_id = n.query_id AND a.kind = n.kind AND a.project = n.project AND n.valid_at > a.valid_at
        WHERE least(len(a.t), len(n.t)) > 0 AND round(len(list_intersect(a.t, n.t))::DOUBLE / least(len(a.t), len(n.t)), 6) >= 0.5),
      s AS (SELECT query_id, doc_id, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM b) AS superseded, score FROM h),
      r AS (SELECT query_id, doc_id, superseded, round(CASE WHEN superseded THEN score * 0.1 ELSE score END, 6) AS score FROM s)
      SELECT query_id, doc_id, score, superseded, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""",
    "paired_significance": WITH + _LEX + _FUSED + f""", {_GOLD}, q AS (SELECT DISTINCT query_id FROM gold),
      p AS (SELECT query_id, query_id IN (SELECT query_id FROM ranked JOIN gold USING (query_id, doc_id) WHERE rank <= 10) AS a,
        query_id IN (SELECT query_id FROM fused JOIN gold USING (query_id, doc_id) WHERE rank <= 10) AS b FROM q),
      c AS (SELECT count(*) FILTER (NOT a AND b) AS b01, count(*) FILTER (a AND NOT b) AS b10 FROM p)
      SELECT b01, b10, round(least(1.0, 2 * list_sum(list_transform(range(0, least(b01, b10) + 1),
        lambda i: exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))))), 6) AS p_value FROM c""",
    "recall_bootstrap": WITH + _LEX + f""", {_GOLD},
      per AS (SELECT g.query_id, coalesce(h.n, 0)::DOUBLE / g.n AS x FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g
        LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1) h USING (query_id)),
      d AS (SELECT r, x, CAST('0x' || substring(md5(r || ':' || query_id), 1, 8) AS BIGINT) % 10000 AS p FROM per, (SELECT unnest(range(1, 201)) AS r)),
      w AS (SELECT r, x, CASE WHEN p < 3679 THEN 0 WHEN p < 7358 THEN 1 WHEN p < 9197 THEN 2 ELSE 3 END AS w FROM d),
      m AS (SELECT round(sum(w * x) / sum(w), 6) AS mean FROM w GROUP BY r)
      SELECT quantile_disc(mean, 0.025) AS lowest, quantile_disc(mean, 0.5) AS middle, quantile_disc(mean, 0.975) AS highest FROM m""",
    "answer_within_budget": WITH.replace("WITH", "WITH RECURSIVE") + _LEX + f""", r AS (SELECT query_id, doc_id, rank, {COST.replace('content', 'text')} AS cost
        FROM ranked JOIN docs USING (doc_id) WHERE rank <= 20),
      walk AS (SELECT query_id, doc_id, rank, cost, cost <= 300 AS taken, CASE WHEN cost <= 300 THEN cost ELSE 0 END AS used FROM r WHERE rank = 1
        UNION ALL SELECT r.query_id, r.doc_id, r.rank, r.cost, w.used + r.cost <= 300, CASE WHEN w.used + r.cost <= 300 THEN w.used + r.cost ELSE w.used END
        FROM walk w JOIN r ON r.query_id = w.query_id AND r.rank = w.rank + 1)
      SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(cost AS BIGINT) AS cost FROM walk WHERE taken""",
    "abstain_flags": WITH + _LEX + """, nm AS (SELECT DISTINCT query_id, name FROM (SELECT case_id AS query_id, unnest(list_filter(regexp_extract_all(query, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}|[A-Z]{2,}'))) AS name FROM eval_cases)),
      sn AS (SELECT query_id, bool_or(list_contains(regexp_extract_all(regexp_replace(lower(text), '[\\x{4E00}-\\x{9FFF}]+', ' ', 'g'), '[\\p{L}\\p{N}_]+'), lower(name))) AS seen
        FROM nm JOIN ranked USING (query_id) JOIN docs USING (doc_id) WHERE rank <= 5 GROUP BY 1)
      SELECT case_id AS query_id, (case_id IN (SELECT query_id FROM nm) AND NOT coalesce(seen, false)) AS abstain
      FROM eval_cases LEFT JOIN sn ON sn.query_id = case_id WHERE query IS NOT NULL""",
    "retrieval_measures": WITH + _LEX + """, gold AS (SELECT DISTINCT case_id AS query_id, unnest(expect) AS doc_id FROM eval_cases),
      g0 AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
      g AS (SELECT *, list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1.0))) AS ideal FROM g0),
      h AS (SELECT query_id, count(*) AS n, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM ranked JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)
      SELECT "type", count(*) AS n, round(avg(coalesce(h.n::DOUBLE / n_gold, 0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS rr,
        round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg, round(avg(CASE WHEN h.n IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS hit
      FROM g LEFT JOIN h USING (query_id) JOIN eval_cases ON case_id = g.query_id GROUP BY 1""",
    "vector_topk": _VEC + "SELECT query_id, doc_id, round(s, 5) AS score FROM n",
    "vector_class_precision": _VEC + "SELECT own, count(*) AS n, round(count(*) FILTER (own = other)::DOUBLE / count(*), 6) AS precision FROM n GROUP BY own",
    "page_match": "WITH s AS (SELECT source, doc_id, CAST(" + " + ".join(
        f"CASE WHEN contains(lower(coalesce(heading, '')), '{w}') THEN 3 ELSE 0 END + least(len(string_split(lower(text), '{w}')) - 1, 4) + CASE WHEN contains(lower(text), '{w}') THEN 2 ELSE 0 END"
        for w in ["cache", "ledger", "summary", "session", "审核", "摘要"]) + """ AS BIGINT) AS score FROM documents WHERE text IS NOT NULL)
      SELECT source, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5""",
}
QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_filtered_after_window, coverage_gate, rrf_fusion, vector_channel, hybrid_channels, chunk_nearest, fused_channels, channel_coverage, ranked_hits, paired_significance, mmr_rerank, answer_within_budget, abstain_flags, retrieval_measures,
    recall_bootstrap, vector_topk, vector_class_precision, page_match)}
