"""Queries of links, supersession, classification and round trips through files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, similar, store
from ..session import table
from ..sources import jsonl, markdown
from .common import ENTRIES, terms

WITH = f"WITH {ENTRIES}"


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return store.visible(store.entries(table(spark, d, "memories")))


def structural_links(spark: SparkSession, d: str) -> DataFrame:
    """The three entries most linked with each entry whose id is divisible by 100, against all."""
    asked = _visible(spark, d).where(similar.hundredth("id")).select("id")
    return similar.structural_links(table(spark, d, "tags"), table(spark, d, "entities"), asked)


def supersession(spark: SparkSession, d: str) -> DataFrame:
    """For each entry whose id is divisible by 100 the newer one that overlaps most, by half or more: the first tier only."""
    rows = _visible(spark, d)
    return similar.superseded(rows, rows.where(similar.hundredth("id")).select("id"), marked=None)


def supersession_two_tier(spark: SparkSession, d: str) -> DataFrame:
    """The whole of supersession: a newer text with a revision marker needs an overlap of 0.35 only."""
    rows = _visible(spark, d)
    return similar.superseded(rows, rows.where(similar.hundredth("id")).select("id"))


def classifier_folds(spark: SparkSession, d: str) -> DataFrame:
    """Complaints told from other lines by a linear model, in grouped folds."""
    lines = table(spark, d, "regression").select("id", "text", (F.col("expect") == "hit").alias("label"), F.col("source").alias("group")).distinct()
    return classify.cross_validated(lines)


def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries rendered as front-matter blocks and parsed again: how many come back as they were, per kind."""
    rows = store.entries(table(spark, d, "memories")).where(F.col("content").isNotNull())
    blocks = markdown.render(rows, ["id", "kind", "scope", "project"]).select(F.lit("f").alias("file"), F.col("block").alias("body"))
    parsed = markdown.parse_entries(blocks).where("valid").select("id", F.col("kind").alias("kind_back"), F.col("content").alias("back"))
    same = (F.col("kind") == F.col("kind_back")) & (text.content_hash(F.regexp_replace("content", r"^\n+|\n+$", "")) == text.content_hash(F.col("back")))
    return rows.join(parsed, "id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def import_report(spark: SparkSession, d: str) -> DataFrame:
    """What an import of all entries would do to the visible ones that are not rules."""
    rows = store.entries(table(spark, d, "memories"))
    current = store.visible(rows).where(F.col("kind") != "rule").withColumn(
        "content", F.when(F.col("importance") == 10, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return jsonl.import_states(current, rows, "id", "content").groupBy("state").agg(F.count("*").alias("n"))


def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """Visible entries as JSON lines: characters in all, and the hash of the smallest line."""
    rows = _visible(spark, d).select("id", "kind", "scope", "status")
    return jsonl.export(rows).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"), F.min("value").alias("first"))


_HUNDREDTH = "CAST('0x' || substring(id, 2, 10) AS BIGINT) % 100 = 0"
SQL = {
    "structural_links": WITH + f""", items AS (SELECT DISTINCT memory_id AS id, 't:' || lower(trim(tag)) AS item, 1 AS weight FROM tags WHERE tag IS NOT NULL
        UNION SELECT DISTINCT memory_id, 'e:' || lower(trim(entity)), 2 FROM entities WHERE entity IS NOT NULL),
      s AS (SELECT a.id, b.id AS other, CAST(sum(b.weight) AS BIGINT) AS score FROM items a JOIN items b USING (item)
        WHERE a.id <> b.id AND a.id IN (SELECT id FROM visible WHERE {_HUNDREDTH}) GROUP BY 1, 2)
      SELECT id, other, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 3""",
    "supersession": WITH + f""", r AS (SELECT id, kind, coalesce(project, '') AS project, valid_at, list_distinct({terms('content')}) AS t FROM visible WHERE content IS NOT NULL AND valid_at IS NOT NULL),
      m AS (SELECT a.id, b.id AS newer, b.valid_at AS ts, CASE WHEN least(len(a.t), len(b.t)) = 0 THEN 0.0
          ELSE round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) END AS overlap
        FROM r a JOIN r b ON a.kind = b.kind AND a.project = b.project AND b.valid_at > a.valid_at WHERE a.id IN (SELECT id FROM visible WHERE {_HUNDREDTH}))
      SELECT id, newer, overlap FROM m WHERE overlap >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, ts DESC, newer) = 1""",
    "supersession_two_tier": WITH + f""", r AS (SELECT id, kind, coalesce(project, '') AS project, valid_at, list_distinct({terms('content')}) AS t,
        regexp_matches(content, '{similar.REVISION_MARKERS}', 'i') AS revises FROM visible WHERE content IS NOT NULL AND valid_at IS NOT NULL),
      m AS (SELECT a.id, b.id AS newer, b.valid_at AS ts, b.revises, CASE WHEN least(len(a.t), len(b.t)) = 0 THEN 0.0
          ELSE round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) END AS overlap
        FROM r a JOIN r b ON a.kind = b.kind AND a.project = b.project AND b.valid_at > a.valid_at WHERE a.id IN (SELECT id FROM visible WHERE {_HUNDREDTH}))
      SELECT id, newer, overlap FROM m WHERE overlap >= 0.5 OR (revises AND overlap >= 0.35)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, ts DESC, newer) = 1""",
    "markdown_round_trip": WITH + "SELECT kind, count(*) AS n, count(*) AS same FROM entries WHERE content IS NOT NULL GROUP BY kind",
    "import_report": WITH + """, c AS (SELECT id, importance FROM visible WHERE kind <> 'rule')
      SELECT CASE WHEN coalesce(trim(e.content), '') = '' THEN 'malformed' WHEN c.id IS NULL THEN 'new' WHEN c.importance = 10 THEN 'updated' ELSE 'unchanged' END AS state, count(*) AS n
      FROM entries e LEFT JOIN c USING (id) GROUP BY 1""",
    "export_lines": WITH + """, l AS (SELECT '{' || array_to_string(list_filter(['"id":"' || id || '"', '"kind":"' || kind || '"', '"scope":"' || scope || '"', '"status":"' || status || '"'], lambda x: x IS NOT NULL), ',') || '}' AS v FROM visible)
      SELECT count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars, min(v) AS first FROM l""",
}
QUERIES = {f.__name__: f for f in (
    structural_links, supersession, supersession_two_tier, classifier_folds, markdown_round_trip, import_report, export_lines)}
