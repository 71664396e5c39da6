"""Queries of decisions on new entries, evidence, themes, removal, field changes and extraction, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import associate, evaluate, graph, history, similar, store
from ..session import table
from . import history_queries
from .common import ENTRIES, terms
from .store_queries import EDGES

WITH = f"WITH {ENTRIES}"
#: Words of the themes, in the order in which they are tried.
THEMES = {"caching": "cache|缓存", "ledger": "ledger|账本", "sessions": "session|会话", "budget": "budget|预算", "review": "review|审核|prüf"}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return store.entries(table(spark, d, "memories"))


def association_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What each entry whose id is divisible by 100 is beside all earlier active ones: duplicate, link or add."""
    rows = _entries(spark, d)
    return associate.decisions(rows, rows.where(similar.hundredth("id")).select("id").distinct())


def evolution_actions(spark: SparkSession, d: str) -> DataFrame:
    """What each entry whose id is divisible by 100 does to the earlier active ones: supersede, contradict, duplicate, link or add."""
    rows = _entries(spark, d)
    return associate.evolutions(rows, rows.where(similar.hundredth("id")).select("id").distinct())


def evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    """Per merged entry what it was made from: entries found, entries missing, the time they span."""
    memories = table(spark, d, "memories")
    origins = graph.merge_edges(memories).select(F.col("from_id").alias("id"), F.col("to_id").alias("origin"))
    return associate.evidence(_entries(spark, d).groupBy("id").agg(F.min("valid_at").alias("valid_at")), origins)


def in_edges(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of the entry that was merged away, by what kinds of entries, both visible or not."""
    nodes = _entries(spark, d).select("id", "kind").distinct()
    edges = graph.visible_edges(graph.merge_edges(table(spark, d, "memories")), nodes)
    return edges.groupBy("to_id", "to_kind").agg(F.count("*").alias("n_in"), F.array_join(F.array_sort(F.collect_set("from_kind")), "+").alias("from_kinds"))


def theme_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Visible entries by theme; those without one by the tags that two or more of them share."""
    rows = store.visible(_entries(spark, d)).where(F.col("content").isNotNull()).select("id", "content").distinct()
    return associate.themes(rows, table(spark, d, "tags"), THEMES)


def bulk_removal(spark: SparkSession, d: str) -> DataFrame:
    """Expired and merged entries taken out with every edge that ends in one: per status of the rest, entries and outgoing edges."""
    rows = _entries(spark, d).select("id", "status").distinct()
    gone = rows.where(F.col("status").isin("expired", "merged")).select("id").distinct()
    left, edges = associate.removed(rows, graph.merge_edges(table(spark, d, "memories")), gone)
    out = left.join(edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("edges")), "id", "left")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def field_changes(spark: SparkSession, d: str) -> DataFrame:
    """Between the first and the last export: how many memories changed in which set of fields, in normal form."""
    fields = ["status", "expires_at", "valid_at", "merged_from"]
    rows = history.latest_per_date(history.normalise_snapshots(table(spark, d, "memory_snapshots")), "memory_id", "snap_date", "loaded_at", fields)
    ends = rows.agg(F.min("snap_date").alias("lo"), F.max("snap_date").alias("hi")).first()
    a, b = (rows.where(F.col("snap_date") == F.lit(x)).select("memory_id", *fields) for x in (ends["lo"], ends["hi"]))
    changed = store.changed_fields(a, b, "memory_id", fields)
    return changed.groupBy(F.array_join("changed", "+").alias("changed")).agg(F.count("*").alias("n"))


def orphan_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags whose memory is gone, and those that stand, per tag: the two parts of one set."""
    tags = table(spark, d, "tags").where(F.col("tag").isNotNull()).select("memory_id", F.lower(F.trim("tag")).alias("tag")).distinct()
    known = table(spark, d, "memories").select(F.col("id").alias("memory_id"), F.lit(True).alias("there")).distinct()
    return tags.join(known, "memory_id", "left").groupBy("tag").agg(F.count("there").alias("standing"), F.count_if(F.col("there").isNull()).alias("orphaned"))


def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers found by their shape against the entities given for the same memory, over all memories."""
    found = _entries(spark, d).where(F.col("content").isNotNull()).select(
        F.col("id").alias("memory_id"), F.explode(text.identifiers_in(F.col("content"))).alias("entity"))
    gold = table(spark, d, "entities").where(F.col("memory_id").isNotNull() & F.col("entity").isNotNull()).select(
        "memory_id", F.lower(F.trim("entity")).alias("entity"))
    return evaluate.set_scores(found, gold)


def entries_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Entries that others name as merged, looked up by id whatever their status."""
    asked = graph.merge_edges(table(spark, d, "memories")).select(F.col("to_id").alias("id")).distinct()
    return _entries(spark, d).join(asked, "id", "left_semi").select("id", "kind", "status")


_IDS = "list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z]*[a-z][A-Z][A-Za-z]+'), lambda x: lower(x)))"
_THEME = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{p}') THEN '{t}'" for t, p in THEMES.items()) + " ELSE '' END"
_HUNDREDTH = "CAST('0x' || substring(id, 2, 10) AS BIGINT) % 100 = 0"
SQL = {
    "association_decisions": WITH + f""", r AS (SELECT id, status, asserted_at, list_distinct({terms('content')}) AS t, regexp_replace(lower(content), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') AS f
        FROM entries WHERE content IS NOT NULL AND asserted_at IS NOT NULL),
      a AS (SELECT * FROM r WHERE {_HUNDREDTH}),
      m AS (SELECT a.id, b.id AS other, len(a.t) AS n, a.f = b.f AS same, a.t AS t, b.t AS u, len(list_intersect(a.t, b.t)) AS n_both
        FROM a JOIN r b ON b.status = 'active' AND a.id <> b.id AND len(a.t) > 0 AND (b.asserted_at < a.asserted_at OR (b.asserted_at = a.asserted_at AND b.id < a.id))
        WHERE len(list_intersect(a.t, b.t)) >= ceil(0.3 * len(a.t))),
      s AS (SELECT id, other, n, CASE WHEN same THEN 1.0::DOUBLE ELSE round(n_both::DOUBLE / n, 6) END AS coverage,
          CASE WHEN same THEN 1.0::DOUBLE ELSE round(n_both::DOUBLE / (n + len(u) - n_both), 6) END AS likeness,
          NOT same AND len(list_filter(t, lambda x: NOT list_contains(u, x) AND regexp_matches(x, '[0-9a-zA-Z]'))) > 0 AS adds FROM m),
      c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY coverage DESC, other) = 1),
      l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, other) = 1),
      d AS (SELECT c.id, CASE WHEN c.coverage >= 0.75 AND c.n >= 5 AND NOT c.adds THEN 'duplicate' WHEN l.likeness >= 0.3 THEN 'link' END AS decision,
          c.other AS co, c.coverage AS cc, l.other AS lo, l.coverage AS lc FROM c JOIN l USING (id))
      SELECT a.id, coalesce(decision, 'add') AS decision, CASE decision WHEN 'duplicate' THEN co WHEN 'link' THEN lo END AS other,
        CASE decision WHEN 'duplicate' THEN cc WHEN 'link' THEN lc END AS coverage FROM a LEFT JOIN d USING (id)""",
    "evolution_actions": WITH + f""", r AS (SELECT id, status, asserted_at, kind, valid_at, list_distinct({terms('content')}) AS t, regexp_replace(lower(content), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') AS f,
        list_sort(list_distinct(regexp_extract_all(content, '{associate.NUMBER}'))) AS nums, regexp_matches(content, '{associate.NEGATIONS}', 'i') AS denies,
        regexp_matches(content, '{associate.UPDATES}', 'i') AS signals FROM entries WHERE content IS NOT NULL AND asserted_at IS NOT NULL),
      a AS (SELECT * FROM r WHERE {_HUNDREDTH}),
      m AS (SELECT a.id, b.id AS other, len(a.t) AS n, a.f = b.f AS same, a.t AS t, b.t AS u, len(list_intersect(a.t, b.t)) AS n_both, a.kind IS NOT DISTINCT FROM b.kind AS same_kind,
          coalesce(a.valid_at >= b.valid_at, false) AS later, a.signals AS signals, a.nums <> b.nums AS differ, a.denies <> b.denies AS turned,
          list_filter(b.t, lambda x: NOT regexp_full_match(x, '[0-9.]+%?')) AS frame
        FROM a JOIN r b ON b.status = 'active' AND a.id <> b.id AND len(a.t) > 0 AND (b.asserted_at < a.asserted_at OR (b.asserted_at = a.asserted_at AND b.id < a.id))
        WHERE len(list_intersect(a.t, b.t)) >= ceil(0.3 * len(a.t))),
      s AS (SELECT id, other, n, CASE WHEN same THEN 1.0::DOUBLE ELSE round(n_both::DOUBLE / n, 6) END AS coverage,
          CASE WHEN same THEN 1.0::DOUBLE ELSE round(n_both::DOUBLE / (n + len(u) - n_both), 6) END AS likeness, same_kind, later, signals,
          NOT same AND len(list_filter(t, lambda x: NOT list_contains(u, x) AND regexp_matches(x, '[0-9a-zA-Z]'))) > 0 AS adds,
          CASE WHEN differ THEN len(frame) > 0 AND len(list_intersect(frame, t)) >= 0.5 * len(frame) ELSE turned END AS conflicts FROM m),
      x AS (SELECT id, other, CASE WHEN coverage >= 0.5 AND n >= 5 AND signals AND same_kind AND later THEN 'supersede' WHEN coverage >= 0.5 AND n >= 5 AND conflicts THEN 'contradict' END AS action
        FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY coverage DESC, other) = 1),
      k AS (SELECT * FROM s WHERE same_kind),
      c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY coverage DESC, other) = 1),
      l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, other) = 1),
      d AS (SELECT c.id, CASE WHEN c.coverage >= 0.75 AND c.n >= 5 AND NOT c.adds THEN 'duplicate' WHEN l.likeness >= 0.3 THEN 'link' END AS decision, c.other AS co, l.other AS lo FROM c JOIN l USING (id))
      SELECT a.id, CASE WHEN a.kind = 'rule' THEN 'add' ELSE coalesce(x.action, decision, 'add') END AS action,
        CASE WHEN a.kind = 'rule' THEN NULL WHEN x.action IS NOT NULL THEN x.other WHEN decision = 'duplicate' THEN co WHEN decision = 'link' THEN lo END AS other
      FROM a LEFT JOIN x USING (id) LEFT JOIN d USING (id)""",
    "evidence_chain": WITH + f""", {EDGES}, e AS (SELECT id, min(valid_at) AS valid_at FROM entries GROUP BY 1)
      SELECT from_id AS id, count(e.id) AS n_found, count(*) - count(e.id) AS n_missing, min(valid_at) AS first_at, max(valid_at) AS last_at
      FROM edges LEFT JOIN e ON e.id = to_id GROUP BY 1""",
    "in_edges": WITH + f""", {EDGES}, n AS (SELECT DISTINCT id, kind FROM entries)
      SELECT to_id, b.kind AS to_kind, count(*) AS n_in, string_agg(DISTINCT a.kind, '+' ORDER BY a.kind) AS from_kinds
      FROM edges JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id GROUP BY 1, 2""",
    "theme_clusters": WITH + f""", m AS (SELECT DISTINCT id, content, {_THEME} AS theme FROM visible WHERE content IS NOT NULL),
      g AS (SELECT DISTINCT memory_id, '#' || lower(trim(tag)) AS theme FROM tags WHERE trim(tag) <> '' AND memory_id IN (SELECT id FROM m WHERE theme = ''))
      SELECT theme, count(*) AS n FROM m WHERE theme <> '' GROUP BY 1 UNION ALL SELECT theme, count(*) FROM g GROUP BY 1 HAVING count(*) >= 2""",
    "bulk_removal": WITH + f""", {EDGES}, r AS (SELECT DISTINCT id, status FROM entries), gone AS (SELECT id FROM r WHERE status IN ('expired', 'merged')),
      o AS (SELECT from_id AS id, count(*) AS edges FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone) GROUP BY 1)
      SELECT status, count(*) AS n, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges FROM r LEFT JOIN o USING (id) WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1""",
    "field_changes": history_queries._NORMAL + """, o AS (SELECT * FROM latest WHERE snap_date = (SELECT min(snap_date) FROM memory_snapshots)),
      n AS (SELECT * FROM latest WHERE snap_date = (SELECT max(snap_date) FROM memory_snapshots))
      SELECT array_to_string(list_filter([CASE WHEN o.st IS DISTINCT FROM n.st THEN 'status' END, CASE WHEN o.ex IS DISTINCT FROM n.ex THEN 'expires_at' END,
        CASE WHEN o.va IS DISTINCT FROM n.va THEN 'valid_at' END, CASE WHEN o.mf IS DISTINCT FROM n.mf THEN 'merged_from' END], lambda x: x IS NOT NULL), '+') AS changed, count(*) AS n
      FROM o JOIN n ON o.memory_id = n.memory_id GROUP BY 1""",
    "orphan_tags": """WITH t AS (SELECT DISTINCT memory_id, lower(trim(tag)) AS tag FROM tags WHERE tag IS NOT NULL), k AS (SELECT DISTINCT id FROM memories)
      SELECT tag, count(k.id) AS standing, count(*) - count(k.id) AS orphaned FROM t LEFT JOIN k ON k.id = t.memory_id GROUP BY 1""",
    "extraction_scores": WITH + f""", f AS (SELECT DISTINCT id AS memory_id, unnest({_IDS}) AS entity FROM entries WHERE content IS NOT NULL),
      g AS (SELECT DISTINCT memory_id, lower(trim(entity)) AS entity FROM entities WHERE memory_id IS NOT NULL AND entity IS NOT NULL),
      c AS (SELECT (SELECT count(*) FROM f JOIN g USING (memory_id, entity)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM g) AS ng)
      SELECT tp, nf - tp AS fp, ng - tp AS fn, round(tp::DOUBLE / nf, 6) AS precision, round(tp::DOUBLE / ng, 6) AS recall, round(2.0::DOUBLE * tp / (nf + ng), 6) AS f1 FROM c""",
    "entries_by_id": WITH + f", {EDGES} SELECT id, kind, status FROM entries WHERE id IN (SELECT to_id FROM edges)",
}
QUERIES = {f.__name__: f for f in (
    association_decisions, evolution_actions, evidence_chain, in_edges, theme_clusters, bulk_removal, field_changes, orphan_tags, extraction_scores, entries_by_id)}
