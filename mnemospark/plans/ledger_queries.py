"""Queries over ledgers, dialogue and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialogue, evaluate, ledger, store
from ..session import table
from .common import terms

SHORT = r"^(continue|go on|继续|weiter|ok)[.!。]?$"


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """One row per (session, turn): repeated rows collapse."""
    return table(spark, d, "capturerecord").groupBy("session", "turn").agg(
        F.max(F.struct("logged_at", "at", "outcome", "skip", "totalMs", "entries")).alias("m")).select("session", "turn", "m.*")


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.speech(table(spark, d, "session_messages"))


def ledger_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ledger.nearest_rank(_captures(spark, d), ["outcome"], "totalMs", [0.5, 0.95, 1.0])


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rollup(_captures(spark, d).where(F.col("at").isNotNull()), "session", "at", "outcome").drop("last_outcome")


def outcome_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = _captures(spark, d)
    return rows.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("outcome") == "error") / F.count("*"), 6).alias("error_rate"),
        F.sum("entries").cast("long").alias("entries"))


def failure_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose last ten records at some point hold at least three errors, and how often."""
    rows = ledger.recent_share(_captures(spark, d), "session", ["turn"], F.col("outcome") == "error", 10)
    return rows.groupBy("session").agg(F.count_if(F.col("recent") >= 0.3).alias("n"), F.round(F.max("recent"), 6).alias("worst")).where(F.col("n") > 0)


def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    runs = ledger.streaks(_captures(spark, d), "session", ["turn"], F.col("outcome") == "skipped")
    return runs.groupBy("n").agg(F.count("*").alias("runs")).withColumnRenamed("n", "length")


def coalesced_hits(spark: SparkSession, d: str) -> DataFrame:
    """Events per user that count when hits within five minutes of the last counted one don't."""
    events = table(spark, d, "events").select("user_id", "ts")
    return ledger.coalesced(events, "user_id", "ts", 300).groupBy("user_id").agg(F.count("*").alias("n"))


def latest_per_day(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "ts")
    return store.top_per_group(rows, ["day"], [F.col("ts").desc(), F.col("event_id")], 20).select("day", "event_id", "pos")


def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    """Whole days outside the last 14 of the log: what a prune would drop."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    newest = days.agg(F.max("d").alias("last"))
    return days.join(F.broadcast(newest)).where(F.col("d") < F.date_sub("last", 13)).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n")


def next_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the user's first purchase at or after it: an as-of join."""
    events = table(spark, d, "events")
    clicks = events.where(F.col("event_type") == "click").select("user_id", "ts", "event_id")
    bought = events.where(F.col("event_type") == "purchase").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    found = ledger.as_of_next(clicks, bought, "user_id", "ts", "purchase_id")
    return found.select("event_id", F.col("next_value").alias("purchase_id"))


def errors_before(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's errors in the day before it: an interval join as a range frame."""
    rows = ledger.within_before(table(spark, d, "events"), "user_id", "ts", 86_400, F.col("event_type") == "error")
    return rows.where(F.col("event_type") == "purchase").select("event_id", "n_before")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.turn_pairs(_speech(spark, d))


def topic_drift(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.topic_drift(_speech(spark, d))


def turn_weights(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.turn_weights(_speech(spark, d)).groupBy("session").agg(F.round(F.sum("weight"), 4).alias("weight"))


def continued_tasks(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.continued(_speech(spark, d), SHORT)


def error_rate_interval(spark: SparkSession, d: str) -> DataFrame:
    """Per event type the share of values above 50, with its Wilson interval."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"))
    low, high = evaluate.wilson(F.col("hits"), F.col("n"))
    return rows.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def value_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well an event's value tells purchases from the rest."""
    rows = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("bought"))
    return evaluate.auc(rows, "value", "bought").withColumn("auc", F.round("auc", 6))


_CAP = """WITH c AS (SELECT * FROM capturerecord QUALIFY row_number() OVER (PARTITION BY session, turn ORDER BY logged_at DESC) = 1)
"""
_SPEECH = """WITH s AS (SELECT session, msg_id, CASE WHEN "type" = 'user/message' THEN 'user' ELSE 'assistant' END AS role, turn, step, "at" AS ts, text
  FROM (SELECT * FROM session_messages WHERE msg_id IS NOT NULL AND (("type" = 'user/message' AND source_kind = 'user') OR "type" = 'assistant/message')
    QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY received_at DESC) = 1))
"""
SQL = {
    "coalesced_hits": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      w AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1
        UNION ALL SELECT w.user_id, min(e.us) FROM w JOIN e ON e.user_id = w.user_id AND e.us >= w.us + 300000000 GROUP BY 1)
      SELECT user_id, count(*) AS n FROM w GROUP BY 1""",
    "ledger_percentiles": _CAP + """SELECT outcome, q, value FROM (SELECT outcome, unnest([0.5::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE]) AS q,
      unnest([quantile_disc(totalMs, 0.5), quantile_disc(totalMs, 0.95), max(totalMs)]) AS value FROM c WHERE totalMs IS NOT NULL GROUP BY outcome)""",
    "session_rollup": _CAP + """, p AS (SELECT session, outcome, count(*) AS k, min("at") AS lo, max("at") AS hi FROM c WHERE "at" IS NOT NULL GROUP BY 1, 2)
      SELECT session, min(lo) AS first_at, max(hi) AS last_at, CAST(sum(k) AS BIGINT) AS n, array_to_string(list_sort(list(outcome || '=' || k)), ',') AS outcomes
      FROM p GROUP BY session""",
    "outcome_by_day": _CAP + """SELECT strftime("at" AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, round(count(*) FILTER (outcome = 'error')::DOUBLE / count(*), 6) AS error_rate,
      CAST(sum(entries) AS BIGINT) AS entries FROM c GROUP BY 1""",
    "failure_windows": _CAP + """, r AS (SELECT session, avg(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM c)
      SELECT session, count(*) FILTER (recent >= 0.3) AS n, round(max(recent), 6) AS worst FROM r GROUP BY session HAVING n > 0""",
    "error_streaks": _CAP + """, m AS (SELECT session, turn, outcome = 'skipped' AS hit, row_number() OVER (PARTITION BY session ORDER BY turn) AS k FROM c),
      i AS (SELECT session, k - row_number() OVER (PARTITION BY session ORDER BY turn) AS island FROM m WHERE hit),
      r AS (SELECT session, island, count(*) AS length FROM i GROUP BY 1, 2) SELECT length, count(*) AS runs FROM r GROUP BY length""",
    "latest_per_day": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id) AS INTEGER) AS pos
      FROM events QUALIFY pos <= 20""",
    "retention_prune": """WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
      SELECT strftime(d, '%Y-%m-%d') AS day, n FROM d WHERE d < (SELECT max(d) FROM d) - INTERVAL 13 DAY""",
    "next_purchase": """SELECT c.event_id, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts >= c.ts) AS purchase_id
      FROM events c WHERE c.event_type = 'click'""",
    "errors_before": """SELECT p.event_id, (SELECT count(*) FROM events e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.ts >= p.ts - INTERVAL 1 DAY AND e.ts < p.ts) AS n_before
      FROM events p WHERE p.event_type = 'purchase'""",
    "turn_pairs": _SPEECH + """SELECT session, turn, arg_min(msg_id, (ts, msg_id)) FILTER (role = 'user') AS question,
      arg_max(msg_id, (step, ts, msg_id)) FILTER (role = 'assistant') AS answer FROM s WHERE turn IS NOT NULL GROUP BY 1, 2""",
    "topic_drift": _SPEECH + f""", u AS (SELECT session, msg_id, list_distinct({terms("coalesce(text, '')")}) AS t, turn, ts FROM s WHERE role = 'user' AND turn IS NOT NULL),
      l AS (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY turn, ts, msg_id) AS b FROM u)
      SELECT session, msg_id, CASE WHEN b IS NULL THEN NULL WHEN least(len(t), len(b)) = 0 THEN 1.0
        ELSE round(1 - len(list_intersect(t, b))::DOUBLE / least(len(t), len(b)), 6) END AS drift FROM l""",
    "turn_weights": _SPEECH + """, w AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn DESC, ts DESC, msg_id) - 1 AS ago FROM s WHERE role = 'user' AND turn IS NOT NULL)
      SELECT session, round(sum(CASE WHEN ago < 5 THEN 1.0::DOUBLE WHEN ago < 20 THEN 0.5 ELSE 0.2 END), 4) AS weight FROM w GROUP BY session""",
    "continued_tasks": _SPEECH + f""", u AS (SELECT *, regexp_matches(lower(trim(text)), '{SHORT}') AS short FROM s WHERE role = 'user' AND turn IS NOT NULL AND text IS NOT NULL),
      t AS (SELECT session, msg_id, short, last_value(CASE WHEN NOT short THEN msg_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn, ts, msg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS task_id FROM u) SELECT session, msg_id, task_id FROM t WHERE short""",
    "error_rate_interval": """WITH c AS (SELECT event_type, count(*) FILTER (value > 50)::DOUBLE AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1)
      SELECT event_type, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
        round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM c""",
    "value_auc": """WITH r AS (SELECT value, event_type = 'purchase' AS b, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
      n AS (SELECT count(*) FILTER (b) AS n_pos, count(*) FILTER (NOT b) AS n_neg, sum(k) FILTER (b) AS s FROM r)
      SELECT round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg), 6) AS auc, n_pos, n_neg FROM n""",
}
QUERIES = {f.__name__: f for f in (
    ledger_percentiles, session_rollup, outcome_by_day, failure_windows, error_streaks, coalesced_hits, latest_per_day, retention_prune,
    next_purchase, errors_before, turn_pairs, topic_drift, turn_weights, continued_tasks, error_rate_interval, value_auc)}
