"""Queries of interval joins, repeated statements, activity and cluster resampling, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dialogue, evaluate, intervals, similar, store
from ..session import table
from .common import ENTRIES, terms
from .ledger_queries import _SPEECH
from .text_queries import _FLAG, NEGATIVE

WITH = f"WITH {ENTRIES}"
CURVE = [1, 3, 7, 14, 21, 30, 45, 60]


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """(session, project): the project of a session's records, trimmed and lower-case; the smallest where they differ."""
    name = F.lower(F.trim("project"))
    return table(spark, d, "capturerecord").where(F.col("session").isNotNull() & (name != "")).groupBy("session").agg(F.min(name).alias("project"))


def _user_lines(spark: SparkSession, d: str) -> DataFrame:
    """(msg_id, session, project, at, text) of user messages in sessions with a known project."""
    said = dialogue.speech(table(spark, d, "session_messages")).where((F.col("role") == "user") & F.col("at").isNotNull() & F.col("text").isNotNull())
    return said.join(_projects(spark, d), "session").select("msg_id", "session", "project", "at", "text")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return store.entries(table(spark, d, "memories"))


def dialogue_gold(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a user turn should recall later: of its project, asserted within two hours after it, sharing a word."""
    turns = _user_lines(spark, d).withColumnRenamed("msg_id", "turn_id")
    return intervals.gold_pairs(turns, _entries(spark, d))


def first_later_assertion(spark: SparkSession, d: str) -> DataFrame:
    """For each entry whose id is divisible by 100 the first later one of its project with an overlap of 0.3 or more."""
    rows = _entries(spark, d)
    return similar.first_later(rows, rows.where(similar.hundredth("id")).select("id").distinct())


def _recurrence(spark: SparkSession, d: str) -> DataFrame:
    lines = _user_lines(spark, d)
    corrections = lines.where(text.has_negation(F.col("text")) | text.has_update_signal(F.col("text")))
    starts = lines.groupBy("session", "project").agg(F.min("at").alias("at"))
    rules = store.visible(_entries(spark, d)).where(F.col("kind").isin("rule", "lesson")).select("id", "project", F.col("asserted_at").alias("at"), "content")
    return intervals.recurrence(rules, corrections, starts)


def correction_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """Per rule or lesson the corrections like it in the two weeks before and after, and the sessions begun there."""
    return _recurrence(spark, d)


def recurrence_reduction(spark: SparkSession, d: str) -> DataFrame:
    return intervals.reduction(_recurrence(spark, d))


def fresh_statements(spark: SparkSession, d: str) -> DataFrame:
    """How often each user message was said, repeats within a day left out."""
    rows = _user_lines(spark, d).select("project", "at", "text")
    return intervals.without_repeats(rows, "text", "at").groupBy("text").agg(F.count("*").alias("n"))


def project_activity(spark: SparkSession, d: str) -> DataFrame:
    return intervals.activity_curve(_user_lines(spark, d), CURVE)


def activity_half_life(spark: SparkSession, d: str) -> DataFrame:
    return intervals.half_life(intervals.activity_curve(_user_lines(spark, d), CURVE), 100)


def detection_interval(spark: SparkSession, d: str) -> DataFrame:
    """Recall and false-positive rate of the complaint patterns, by drawing whole sources."""
    lines = table(spark, d, "regression").where(F.col("text").isNotNull()).select("id", "text", "expect", "source").distinct()
    return evaluate.cluster_bootstrap(lines, "source", F.col("expect") == "hit", F.size(text.all_labels(F.col("text"), NEGATIVE)) > 0)


_LINES = _SPEECH + """, proj AS (SELECT session, min(lower(trim(project))) AS project FROM capturerecord WHERE session IS NOT NULL AND lower(trim(project)) <> '' GROUP BY 1),
  lines AS (SELECT msg_id, session, project, ts, text FROM s JOIN proj USING (session) WHERE role = 'user' AND ts IS NOT NULL AND text IS NOT NULL)"""
_LINES_ENTRIES = _LINES + "," + ENTRIES
_HUNDREDTH = "CAST('0x' || substring(id, 2, 10) AS BIGINT) % 100 = 0"
_CORRECTION = (
    "(regexp_matches(lower(text), '\\b(not|never|no|cannot|nicht|kein|keine|nie)\\b') OR regexp_matches(text, '不|没|别|勿') "
    "OR regexp_matches(lower(text), '\\b(now|instead|no longer|changed|moved|since|replaces|statt|jetzt)\\b') OR regexp_matches(text, '改成|改为|换成|不再|现在|之后'))")
_RECUR = _LINES_ENTRIES + f""", r AS (SELECT id, project, asserted_at AS ts, list_distinct({terms('content')}) AS t FROM visible
    WHERE kind IN ('rule', 'lesson') AND asserted_at IS NOT NULL AND content IS NOT NULL),
  r2 AS (SELECT * FROM r WHERE len(t) >= 2),
  m AS (SELECT project, ts, list_distinct({terms('text')}) AS t FROM lines WHERE {_CORRECTION}),
  st AS (SELECT project, min(ts) AS ts FROM lines GROUP BY session, project),
  alike AS (SELECT r2.id, m.ts > r2.ts AS after FROM r2 JOIN m ON (r2.project IS NULL OR r2.project = m.project) AND len(list_intersect(r2.t, m.t)) >= 2
    AND ((m.ts >= r2.ts - INTERVAL 14 DAY AND m.ts < r2.ts - INTERVAL 2 HOUR) OR (m.ts > r2.ts AND m.ts <= r2.ts + INTERVAL 14 DAY))),
  am AS (SELECT id, count(*) FILTER (NOT after) AS pre, count(*) FILTER (after) AS post FROM alike GROUP BY 1),
  sn AS (SELECT r2.id, count(*) FILTER (st.ts >= r2.ts - INTERVAL 14 DAY AND st.ts < r2.ts - INTERVAL 2 HOUR) AS pre_sessions,
      count(*) FILTER (st.ts > r2.ts AND st.ts <= r2.ts + INTERVAL 14 DAY) AS post_sessions
    FROM r2 LEFT JOIN st ON r2.project IS NULL OR r2.project = st.project GROUP BY 1),
  rec AS (SELECT id, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post, pre_sessions, post_sessions FROM sn LEFT JOIN am USING (id))"""
_CURVE = _LINES + f""", l AS (SELECT project, max(epoch_us(ts)) AS last FROM lines GROUP BY 1), e AS (SELECT max(last) AS e FROM l), days AS (SELECT unnest({CURVE}) AS d),
  cv AS (SELECT d, count(*) FILTER (e - epoch_us(ts) >= d * 86400000000) AS n,
      round(count(*) FILTER (e - epoch_us(ts) >= d * 86400000000 AND last >= epoch_us(ts) + d * 86400000000)::DOUBLE
        / nullif(count(*) FILTER (e - epoch_us(ts) >= d * 86400000000), 0), 6) AS alive
    FROM days, e, lines JOIN l USING (project) GROUP BY d)"""
SQL = {
    "dialogue_gold": _LINES_ENTRIES + f""", a AS (SELECT msg_id AS turn_id, project, ts, list_filter({terms('text')}, lambda x: length(x) >= 2) AS t FROM lines),
      b AS (SELECT id, project, asserted_at, list_filter({terms('content')}, lambda x: length(x) >= 2) AS u FROM entries WHERE content IS NOT NULL)
      SELECT DISTINCT turn_id, id FROM a JOIN b ON a.project = b.project AND asserted_at >= ts AND asserted_at <= ts + INTERVAL 120 MINUTE WHERE list_has_any(t, u)""",
    "first_later_assertion": WITH + f""", r AS (SELECT id, coalesce(project, '') AS project, asserted_at AS ts, list_distinct({terms('content')}) AS t FROM entries
        WHERE content IS NOT NULL AND asserted_at IS NOT NULL),
      m AS (SELECT a.id, b.id AS newer, b.ts, (epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0::DOUBLE AS days,
          CASE WHEN least(len(a.t), len(b.t)) = 0 THEN 0.0 ELSE round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) END AS overlap
        FROM r a JOIN r b ON a.project = b.project AND epoch_us(b.ts) - epoch_us(a.ts) >= 60000000 WHERE a.id IN (SELECT id FROM entries WHERE {_HUNDREDTH}))
      SELECT id, newer, overlap, round(days, 4) AS days FROM m WHERE overlap >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, newer) = 1""",
    "correction_recurrence": _RECUR + " SELECT * FROM rec",
    "recurrence_reduction": _RECUR + """, j AS (SELECT pre::DOUBLE / pre_sessions AS a, post::DOUBLE / post_sessions AS b FROM rec WHERE pre_sessions > 0 AND post_sessions > 0)
      SELECT count(*) AS n_rules, count(*) FILTER (a > 0) AS n_used, round(1 - sum(b) FILTER (a > 0) / nullif(sum(a) FILTER (a > 0), 0), 6) AS reduction FROM j""",
    "fresh_statements": _LINES + """, u AS (SELECT DISTINCT text, ts FROM lines), p AS (SELECT text, ts, lag(ts) OVER (PARTITION BY text ORDER BY ts) AS before FROM u)
      SELECT text, count(*) AS n FROM p WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 86400000000 GROUP BY 1""",
    "project_activity": _CURVE + " SELECT * FROM cv",
    "activity_half_life": _CURVE + """ SELECT count(*) AS n_points, round(sum(d * d)::DOUBLE / nullif(sum(d * -log2(alive)), 0), 4) AS half_life FROM cv WHERE alive > 0 AND alive < 1 AND n >= 100""",
    "detection_interval": f"""WITH p AS (SELECT DISTINCT id, text, source, coalesce(expect = 'hit', false) AS a, ({_FLAG}) AS p FROM regression WHERE text IS NOT NULL),
      c AS (SELECT coalesce(source, '') AS u, count(*) FILTER (a AND p) AS tp, count(*) FILTER (a) AS pos, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a) AS neg FROM p GROUP BY 1),
      d AS (SELECT *, CAST('0x' || substring(md5(r || ':' || u), 1, 8) AS BIGINT) % 10000 AS x FROM c, (SELECT unnest(range(1, 201)) AS r)),
      w AS (SELECT *, CASE WHEN x < 3679 THEN 0 WHEN x < 7358 THEN 1 WHEN x < 9197 THEN 2 ELSE 3 END AS w FROM d),
      m AS (SELECT round(sum(w * tp)::DOUBLE / nullif(sum(w * pos), 0), 6) AS recall, round(sum(w * fp)::DOUBLE / nullif(sum(w * neg), 0), 6) AS fpr FROM w GROUP BY r)
      SELECT quantile_disc(recall, 0.025) AS recall_low, quantile_disc(recall, 0.975) AS recall_high, quantile_disc(fpr, 0.025) AS fpr_low, quantile_disc(fpr, 0.975) AS fpr_high FROM m""",
}
QUERIES = {f.__name__: f for f in (
    dialogue_gold, first_later_assertion, correction_recurrence, recurrence_reduction, fresh_statements, project_activity, activity_half_life, detection_interval)}
