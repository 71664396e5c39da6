"""Queries over the entry store and its maintenance, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import graph, history, store
from ..session import table
from . import history_queries
from .common import ENTRIES, NOW

WITH = f"WITH {ENTRIES}"
#: Tokens of a budget.
BUDGET = 1200


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return store.entries(table(spark, d, "memories"))


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return store.visible(_entries(spark, d))


def structured_filter(spark: SparkSession, d: str) -> DataFrame:
    out = store.structured(_entries(spark, d), kinds=["lesson", "decision", "fact"], scope="project", contains="docs/",
                           valid_until="2026-03-01 00:00:00")
    return out.select("id", "kind", "project", "valid_at")


def recent_entries(spark: SparkSession, d: str) -> DataFrame:
    return _visible(spark, d).orderBy(F.col("asserted_at").desc(), "id").limit(50).select("id", "asserted_at")


def as_of_slice(spark: SparkSession, d: str) -> DataFrame:
    """What was valid at a time, per kind: bitemporal slices by fact time and by write time."""
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return _visible(spark, d).groupBy("kind").agg(
        F.count_if(F.col("valid_at") <= at).alias("valid"), F.count_if(F.col("asserted_at") <= at).alias("asserted"),
        F.count_if((F.col("valid_at") <= at) & (F.col("asserted_at") > at)).alias("late"))


def tag_semi_join(spark: SparkSession, d: str) -> DataFrame:
    tagged = table(spark, d, "tags").where(F.lower(F.trim("tag")) == "config")
    return store.structured(_entries(spark, d), tags=tagged, limit=None).groupBy("kind").agg(F.count("*").alias("n"))


def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries that share entities with a set of asked ones, most shared first."""
    asked = table(spark, d, "entities").where(F.lower(F.trim("entity")).isin("gaterecall", "warm-sweeper", "queuebudget"))
    shared = asked.groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct(F.lower(F.trim("entity"))).alias("n_shared"))
    return _visible(spark, d).join(shared, "id").orderBy(F.col("n_shared").desc(), F.col("valid_at").desc(), "id").limit(50).select(
        "id", "n_shared")


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    out = store.with_postings(_visible(spark, d), table(spark, d, "tags"), table(spark, d, "entities"))
    return out.select("id", F.array_join("tags", "|").alias("tags"), F.size("entities").cast("long").alias("n_entities"))


def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("kind", "status").agg(
        F.count("*").alias("n"), F.count_distinct("project").alias("projects"), F.max("valid_at").alias("latest"))


def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return store.digest(_visible(spark, d))


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.quality(_visible(spark, d))


def lineage_visible(spark: SparkSession, d: str) -> DataFrame:
    seen = store.in_lineage(F.col("project"), ["quillbox", "tidelog"])
    return _visible(spark, d).where(seen).groupBy("scope", "project").agg(F.count("*").alias("n"))


def consolidate_report(spark: SparkSession, d: str) -> DataFrame:
    return store.consolidation(_entries(spark, d), NOW)


def decay_view(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the mean age, retention and effective confidence."""
    age = scoring.age_days(F.col("valid_at"), NOW)
    kept = scoring.retention(F.col("kind"), age)
    sure = scoring.effective_confidence(F.col("confidence"), kept, F.col("status") == "superseded")
    return _visible(spark, d).groupBy("kind").agg(
        F.round(F.avg(age), 3).alias("age"), F.round(F.avg(kept), 5).alias("kept"), F.round(F.avg(sure), 5).alias("sure"))


def composite_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best entries per project by composite score."""
    age = scoring.age_days(F.col("valid_at"), NOW)
    score = scoring.composite(F.lit(1.0), F.col("kind"), age, F.col("importance"), F.col("confidence"), F.col("reinforcement"))
    scored = _visible(spark, d).where(F.col("project").isNotNull()).withColumn("score", F.round(score, 6))
    return store.top_per_group(scored, ["project"], [F.col("score").desc(), F.col("id")], 10).select("project", "id", "score", "pos")


def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    """Share of entries, per kind and number of days, that were hit again at least so many days after they became valid."""
    days = F.explode(F.array(*[F.lit(x) for x in (0, 7, 30, 60, 90, 120)]))
    lived = F.unix_micros("last_hit_at") - F.unix_micros("valid_at")
    return _entries(spark, d).select("kind", lived.alias("lived"), days.alias("days")).groupBy("kind", "days").agg(
        F.round(F.count_if(F.col("lived") >= F.col("days") * F.lit(86_400_000_000)) / F.count("*"), 6).alias("alive"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changes of status as it is written between the first and the last export; snapshot_changes has those of all attributes."""
    raw = table(spark, d, "memory_snapshots")
    ends = raw.agg(F.min("snap_date").alias("a"), F.max("snap_date").alias("b"))

    def at(end: str) -> DataFrame:
        rows = raw.join(F.broadcast(ends), F.col("snap_date") == F.col(end))
        best = rows.groupBy("memory_id").agg(F.max(F.struct("loaded_at", F.coalesce(F.lower(F.trim("status")), F.lit("")).alias("s"))).alias("m"))
        return best.select("memory_id", F.col("m.s").alias("s"))

    return store.diff(at("a"), at("b"), "memory_id", F.col("s")).groupBy("change").agg(F.count("*").alias("n"))


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between the first and the last export: a full outer join on the id, by a hash of all attributes' normal forms."""
    old, new = history.end_states(table(spark, d, "memory_snapshots"))
    return store.diff(old, new, "memory_id", F.col("hash")).groupBy("change").agg(F.count("*").alias("n"))


def _costs(spark: SparkSession, d: str) -> DataFrame:
    cost = text.estimated_tokens(F.col("content")) + 8
    return _visible(spark, d).where(F.col("project").isNotNull()).select("project", "id", "importance", cost.alias("cost"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Per project the most important entries whose running token cost fits a budget of 1200."""
    order = [F.coalesce("importance", F.lit(5)).desc(), F.col("id")]
    return store.prefix_fill(_costs(spark, d), ["project"], order, "cost", BUDGET).select("project", "id", "used")


def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The same with skipping: what doesn't fit is passed over, over all entries of each project."""
    order = [F.coalesce("importance", F.lit(5)).desc(), F.col("id")]
    return store.greedy_stream(_costs(spark, d), "project", order, "cost", BUDGET).select("project", "id", "pos", "cost")


def out_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.visible_edges(graph.merge_edges(table(spark, d, "memories")), _visible(spark, d).select("id", "kind"))
    return edges.groupBy("from_kind", "to_kind").agg(F.count("*").alias("n"))


def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.merge_edges(table(spark, d, "memories"))).groupBy("n_out", "n_in").agg(F.count("*").alias("n"))


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(graph.merge_edges(table(spark, d, "memories")), _entries(spark, d)).select("from_id", "to_id")


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop(graph.merge_edges(table(spark, d, "memories")))


def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_ends(graph.merge_edges(table(spark, d, "memories")))


EDGES = "edges AS (SELECT DISTINCT id AS from_id, to_id FROM (SELECT id, unnest(merged_from) AS to_id FROM memories) WHERE to_id IS NOT NULL)"
AGE = f"greatest(epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(valid_at), 0) / 86400000000.0"
RETAIN = f"""CASE kind WHEN 'event' THEN pow(0.5, ({AGE}) / 3) WHEN 'context' THEN 0.05 + 0.95 * pow(0.5, ({AGE}) / 7)
  WHEN 'lesson' THEN 0.15 + 0.85 * pow(0.5, ({AGE}) / 60) WHEN 'pattern' THEN 0.15 + 0.85 * pow(0.5, ({AGE}) / 60)
  WHEN 'fact' THEN 0.15 + 0.85 * pow(0.5, ({AGE}) / 45) WHEN 'preference' THEN 0.2 + 0.8 * pow(0.5, ({AGE}) / 90)
  WHEN 'decision' THEN 0.15 + 0.85 * pow(0.5, ({AGE}) / 41) WHEN 'rule' THEN 0.2 + 0.8 * pow(0.5, ({AGE}) / 41) ELSE 1.0 END"""
DECAY = f"""CASE kind WHEN 'event' THEN pow(0.5, ({AGE}) / 7) WHEN 'context' THEN pow(0.5, ({AGE}) / 30)
  WHEN 'fact' THEN pow(0.5, ({AGE}) / 180) WHEN 'lesson' THEN pow(0.5, ({AGE}) / 180) WHEN 'pattern' THEN pow(0.5, ({AGE}) / 180)
  WHEN 'preference' THEN pow(0.5, ({AGE}) / 365) WHEN 'decision' THEN pow(0.5, ({AGE}) / 365) ELSE 1.0 END"""
COST = """(length(regexp_replace(content, '[^\\x{4E00}-\\x{9FFF}]', '', 'g'))
  + CAST(ceil((length(content) - length(regexp_replace(content, '[^\\x{4E00}-\\x{9FFF}]', '', 'g'))) / 4.0) AS BIGINT) + 8)"""

SQL = {
    "structured_filter": WITH + """SELECT id, kind, project, valid_at FROM visible
      WHERE kind IN ('lesson', 'decision', 'fact') AND scope = 'project' AND (contains(content, 'docs/') OR contains(source, 'docs/'))
        AND valid_at <= TIMESTAMPTZ '2026-03-01 00:00:00+00' ORDER BY valid_at DESC, id LIMIT 50""",
    "recent_entries": WITH + "SELECT id, asserted_at FROM visible ORDER BY asserted_at DESC NULLS LAST, id LIMIT 50",
    "as_of_slice": WITH + """SELECT kind, count(*) FILTER (valid_at <= t) AS valid, count(*) FILTER (asserted_at <= t) AS asserted,
      count(*) FILTER (valid_at <= t AND asserted_at > t) AS late FROM visible, (SELECT TIMESTAMPTZ '2026-01-01 00:00:00+00' AS t) GROUP BY kind""",
    "tag_semi_join": WITH + """SELECT kind, count(*) AS n FROM visible
      WHERE id IN (SELECT memory_id FROM tags WHERE lower(trim(tag)) = 'config') GROUP BY kind""",
    "entity_lookup": WITH + """, s AS (SELECT memory_id AS id, count(DISTINCT lower(trim(entity))) AS n_shared FROM entities
      WHERE lower(trim(entity)) IN ('gaterecall', 'warm-sweeper', 'queuebudget') GROUP BY 1)
      SELECT id, n_shared FROM visible JOIN s USING (id) ORDER BY n_shared DESC, valid_at DESC NULLS LAST, id LIMIT 50""",
    "hydrated": WITH + """, t AS (SELECT memory_id AS id, array_to_string(list_sort(list_distinct(list(tag))), '|') AS tags FROM tags WHERE tag IS NOT NULL GROUP BY 1),
      e AS (SELECT memory_id AS id, count(DISTINCT entity) AS c FROM entities GROUP BY 1)
      SELECT id, coalesce(tags, '') AS tags, coalesce(c, 0) AS n_entities FROM visible LEFT JOIN t USING (id) LEFT JOIN e USING (id)""",
    "library_stats": WITH + """SELECT kind, status, count(*) AS n, count(DISTINCT project) AS projects, max(valid_at) AS latest FROM entries GROUP BY 1, 2""",
    "digest_groups": WITH + """SELECT n, importance, latest_at, id FROM (
      SELECT count(*) AS n, max(coalesce(importance, 5)) AS importance, max(valid_at) AS latest_at,
        arg_max(id, (coalesce(epoch_us(valid_at), -1), id)) AS id
      FROM visible WHERE trim(content) <> '' GROUP BY regexp_replace(lower(content), '[\\s\\p{P}\\p{S}]+', '', 'g'))
      ORDER BY n DESC, importance DESC, latest_at DESC NULLS LAST, id LIMIT 8""",
    "quality_summary": WITH + """SELECT kind, count(*) AS n, count(*) FILTER (d) AS derived, count(*) FILTER (NOT d AND s) AS raw_short,
      count(*) FILTER (NOT d AND NOT s AND u) AS raw_unsure, round(100.0 * count(*) FILTER (NOT d AND (s OR u)) / count(*), 1) AS low_pct
      FROM (SELECT kind, merged_from <> '' AS d, coalesce(length(trim(content)) < 40, false) AS s, coalesce(confidence < 0.3, false) AS u FROM visible WHERE kind <> 'doc') GROUP BY kind""",
    "lineage_visible": WITH + "SELECT scope, project, count(*) AS n FROM visible WHERE project IS NULL OR project IN ('quillbox', 'tidelog') GROUP BY 1, 2",
    "consolidate_report": WITH + f"""SELECT kind, CASE WHEN expires_at < TIMESTAMPTZ '{NOW}+00' THEN 'ttl'
      WHEN ({RETAIN}) < 0.15 AND coalesce(reinforcement, 0) = 0 THEN 'decay' ELSE 'keep' END AS reason, count(*) AS n
      FROM entries WHERE status = 'active' AND kind IN ('event', 'context') GROUP BY 1, 2""",
    "decay_view": WITH + f"""SELECT kind, round(avg({AGE}), 3) AS age, round(avg({RETAIN}), 5) AS kept,
      round(avg(coalesce(confidence, 0.7) * ({RETAIN}) * CASE WHEN status = 'superseded' THEN 0.1 ELSE 1 END), 5) AS sure FROM visible GROUP BY kind""",
    "composite_top": WITH + f""", s AS (SELECT project, id, round(({DECAY}) * CASE kind WHEN 'context' THEN 0.45 WHEN 'event' THEN 0.3 ELSE 1 END
        * (0.6 + 0.4 * coalesce(importance, 5) / 10) * (0.7 + 0.3 * coalesce(confidence, 0.7)) * (1 + ln(1 + coalesce(reinforcement, 0)) / 4), 6) AS score
      FROM visible WHERE project IS NOT NULL)
      SELECT project, id, score, CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS INTEGER) AS pos FROM s
      QUALIFY pos <= 10""",
    "survival_curve": WITH + """SELECT kind, days, round(CAST(count(*) FILTER (epoch_us(last_hit_at) - epoch_us(valid_at) >= days * 86400000000) AS DOUBLE) / count(*), 6) AS alive
      FROM entries, (SELECT CAST(unnest([0, 7, 30, 60, 90, 120]) AS INTEGER) AS days) GROUP BY 1, 2""",
    "snapshot_diff": """WITH e AS (SELECT min(snap_date) AS a, max(snap_date) AS b FROM memory_snapshots),
      r AS (SELECT memory_id, snap_date, coalesce(lower(trim(status)), '') AS s FROM memory_snapshots
        QUALIFY row_number() OVER (PARTITION BY memory_id, snap_date ORDER BY loaded_at DESC, coalesce(lower(trim(status)), '') DESC) = 1),
      o AS (SELECT memory_id, s FROM r, e WHERE snap_date = a), n AS (SELECT memory_id, s FROM r, e WHERE snap_date = b)
      SELECT CASE WHEN o.memory_id IS NULL THEN 'added' WHEN n.memory_id IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'updated' ELSE 'unchanged' END AS change,
        count(*) AS n FROM o FULL JOIN n ON o.memory_id = n.memory_id GROUP BY 1""",
    "snapshot_changes": history_queries._NORMAL + """, o AS (SELECT * FROM latest WHERE snap_date = (SELECT min(snap_date) FROM memory_snapshots)),
      n AS (SELECT * FROM latest WHERE snap_date = (SELECT max(snap_date) FROM memory_snapshots))
      SELECT CASE WHEN o.memory_id IS NULL THEN 'added' WHEN n.memory_id IS NULL THEN 'removed'
        WHEN o.st IS DISTINCT FROM n.st OR o.ex IS DISTINCT FROM n.ex OR o.va IS DISTINCT FROM n.va OR o.mf IS DISTINCT FROM n.mf THEN 'updated'
        ELSE 'unchanged' END AS change, count(*) AS n FROM o FULL JOIN n ON o.memory_id = n.memory_id GROUP BY 1""",
    "budget_prefix": WITH + f""", r AS (SELECT project, id, importance, {COST} AS cost,
        row_number() OVER (PARTITION BY project ORDER BY coalesce(importance, 5) DESC, id) AS pos FROM visible WHERE project IS NOT NULL)
      SELECT project, id, CAST(sum(cost) OVER (PARTITION BY project ORDER BY pos) AS BIGINT) AS used FROM r QUALIFY used <= 1200""",
    "budget_greedy": WITH.replace("WITH", "WITH RECURSIVE") + f""", r AS (SELECT project, id, coalesce({COST}, 1201) AS cost,
        row_number() OVER (PARTITION BY project ORDER BY coalesce(importance, 5) DESC, id) AS pos FROM visible WHERE project IS NOT NULL),
      walk AS (SELECT project, id, pos, cost, cost <= 1200 AS taken, CASE WHEN cost <= 1200 THEN cost ELSE 0 END AS used FROM r WHERE pos = 1
        UNION ALL SELECT r.project, r.id, r.pos, r.cost, w.used + r.cost <= 1200, CASE WHEN w.used + r.cost <= 1200 THEN w.used + r.cost ELSE w.used END
        FROM walk w JOIN r ON r.project = w.project AND r.pos = w.pos + 1)
      SELECT project, id, CAST(pos AS INTEGER) AS pos, CAST(cost AS BIGINT) AS cost FROM walk WHERE taken""",
    "out_edges": WITH + f", {EDGES}" + """ SELECT a.kind AS from_kind, b.kind AS to_kind, count(*) AS n FROM edges
      JOIN visible a ON a.id = from_id JOIN visible b ON b.id = to_id GROUP BY 1, 2""",
    "degree_summary": f"WITH {EDGES}" + """, d AS (SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (
        SELECT from_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_id, 0, 1 FROM edges) GROUP BY 1)
      SELECT CAST(n_out AS BIGINT) AS n_out, CAST(n_in AS BIGINT) AS n_in, count(*) AS n FROM d GROUP BY 1, 2""",
    "dangling_edges": f"WITH {EDGES} SELECT from_id, to_id FROM edges WHERE to_id NOT IN (SELECT id FROM memories)",
    "two_hop": f"WITH {EDGES}" + """ SELECT DISTINCT a.from_id AS id, b.to_id AS far FROM edges a JOIN edges b ON a.to_id = b.from_id
      WHERE a.from_id <> b.to_id AND (a.from_id, b.to_id) NOT IN (SELECT (from_id, to_id) FROM edges)""",
    "version_chain": f"WITH RECURSIVE {EDGES}, step AS (SELECT from_id, min(to_id) AS nx FROM edges GROUP BY 1)," + """
      walk AS (SELECT from_id AS id, nx AS last, 1 AS hops FROM step
        UNION ALL SELECT w.id, s.nx, w.hops + 1 FROM walk w JOIN step s ON s.from_id = w.last WHERE s.nx <> w.id AND w.hops < 10)
      SELECT id, arg_max(last, hops) AS last, max(hops) AS hops FROM walk GROUP BY id""",
}
QUERIES = {f.__name__: f for f in (
    structured_filter, recent_entries, as_of_slice, tag_semi_join, entity_lookup, hydrated, library_stats, digest_groups, quality_summary,
    lineage_visible, consolidate_report, decay_view, composite_top, survival_curve, snapshot_diff, snapshot_changes, budget_prefix, budget_greedy, out_edges,
    degree_summary, dangling_edges, two_hop, version_chain)}
