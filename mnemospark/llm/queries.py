"""Queries of the problems that belong to training data for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import nearest_rank
from ..session import small, table
from . import conversations, cooccurrence, leaks, personal, quantiles, reading, restatements, tokenise


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "session_messages")).select("session", "pos", "msg_id")


_P5 = """
WITH m AS (
  SELECT * FROM session_messages WHERE msg_id IS NOT NULL AND session IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY received_at DESC) = 1),
speech AS (
  SELECT session, msg_id, turn AS turn0, step, "at" AS ts, "type" = 'user/message' AS is_user,
         coalesce(regexp_replace("text", '\\s+', '', 'g') <> '', false) AS has_text
  FROM m WHERE ("type" = 'user/message' AND source_kind = 'user') OR "type" = 'assistant/message'),
t AS (
  SELECT s.*, CASE WHEN is_user AND turn0 IS NULL THEN
    (SELECT arg_min(a.turn0, a.ts) FROM speech a WHERE a.session = s.session AND NOT a.is_user AND a.ts >= s.ts) ELSE turn0 END AS turn
  FROM speech s),
per_turn AS (
  SELECT session, turn, count(*) FILTER (is_user) AS u, count(*) FILTER (is_user AND has_text) AS ut,
    count(*) FILTER (NOT is_user) AS a, count(*) FILTER (NOT is_user AND has_text) AS at1,
    count(DISTINCT step) FILTER (NOT is_user) AS ad, min(step) FILTER (NOT is_user) AS lo, max(step) FILTER (NOT is_user) AS hi
  FROM t GROUP BY session, turn),
kept AS (
  SELECT session FROM per_turn GROUP BY session
  HAVING bool_and(coalesce(turn IS NOT NULL AND u = 1 AND ut = 1 AND at1 >= 1 AND lo = 1 AND hi = a AND ad = a, false))
    AND min(turn) = 1 AND max(turn) = count(*)),
good AS (
  SELECT t.* FROM t JOIN kept USING (session)
  WHERE session NOT IN (SELECT session FROM m WHERE "type" = 'subagent/descriptor'))
"""

def _item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "tags").select(
        F.lit("tag").alias("kind"), F.col("memory_id").alias("record"), F.col("tag").alias("value"))
    entities = table(spark, sf_dir, "entities").select(
        F.lit("entity").alias("kind"), F.col("memory_id").alias("record"), F.col("entity").alias("value"))
    return cooccurrence.pair_counts([tags, entities])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _item_pairs(spark, sf_dir).where(F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return pairs.select(F.col("kind").alias("item_kind"), "item_a", "item_b")


def p4_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the wanted support with counts and lift."""
    return _item_pairs(spark, sf_dir).select(
        F.col("kind").alias("item_kind"), "item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 4).alias("lift"))


#: Full-width forms that occur in items, for SQL, which has no NFKC.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "\u3000"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " "
_P4 = f"""
WITH v AS (
  SELECT 'tag' AS item_kind, memory_id, tag AS x FROM tags UNION ALL SELECT 'entity', memory_id, entity FROM entities),
i AS (
  SELECT DISTINCT item_kind, memory_id, lower(trim(ltrim(trim(translate(x, '{_WIDE}', '{_NARROW}'), e' \\t\\n\\r'), '#'), e' \\t\\n\\r')) AS item
  FROM v WHERE x IS NOT NULL AND memory_id IS NOT NULL),
g AS (
  SELECT * FROM i WHERE item NOT IN ('', 'null', 'undefined', 'none', 'nan') AND NOT regexp_full_match(item, '[+-]?[0-9]+([.,][0-9]+)*')),
n AS (SELECT item_kind, count(DISTINCT memory_id) AS n FROM g GROUP BY 1),
c AS (SELECT item_kind, item, count(*) AS c FROM g GROUP BY 1, 2),
p AS (
  SELECT a.item_kind, a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM g a JOIN g b ON a.item_kind = b.item_kind AND a.memory_id = b.memory_id AND a.item < b.item GROUP BY 1, 2, 3),
s AS (
  SELECT p.*, ca.c AS n_a, cb.c AS n_b, n.n FROM p JOIN n USING (item_kind)
  JOIN c ca ON ca.item_kind = p.item_kind AND ca.item = item_a JOIN c cb ON cb.item_kind = p.item_kind AND cb.item = item_b
  WHERE n_ab >= 5 AND 2000 * n_ab >= n.n)
"""

QUANTILES = [0.5, 0.9, 0.95, 0.99]
EPS = 0.01


def p2_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which days combine: each project's, metric's and day's summary, tuple by tuple."""
    days = quantiles.day_summaries(quantiles.latest_rows(table(spark, sf_dir, "capturerecord")), EPS)
    keys = ["project", "metric", "day"]
    return quantiles.tuples(days, keys).withColumn("day", F.date_from_unix_date("day"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per project and metric with their bounds on the rank error."""
    return quantiles.project_percentiles(table(spark, sf_dir, "capturerecord"), QUANTILES, EPS)


def p2_bounds_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each project, metric and q: the exact percentile, and whether the summary's value has a rank within EPS * n of its rank."""
    raw = table(spark, sf_dir, "capturerecord")
    found = quantiles.project_percentiles(raw, QUANTILES, EPS)
    values = quantiles.measurements(raw)
    same = F.col("v.project").eqNullSafe(F.col("f.project")) & (F.col("v.metric") == F.col("f.metric"))
    ranks = (
        values.alias("v").join(small(found).alias("f"), same)
        .groupBy(F.col("f.project").alias("project"), F.col("f.metric").alias("metric"), "q", "n")
        .agg(F.count(F.when(F.col("v.value") < F.col("f.value"), 1)).alias("below"),
             F.count(F.when(F.col("v.value") <= F.col("f.value"), 1)).alias("upto"))
    )
    target, slack = F.ceil(F.col("q") * F.col("n")), F.lit(EPS) * F.col("n") + 1
    held = (F.col("below") + 1 <= target + slack) & (F.col("upto") >= target - slack)
    exact = nearest_rank(values, ["project", "metric"], "value", QUANTILES).alias("e")
    ranks = ranks.withColumn("held", held).alias("r")
    where = F.col("r.project").eqNullSafe(F.col("e.project")) & (F.col("r.metric") == F.col("e.metric")) & (F.col("r.q") == F.col("e.q"))
    return ranks.join(exact, where).select("r.project", "r.metric", "r.q", "r.n", F.col("e.value").alias("exact_value"), "r.held")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "memories").select("id", "asserted_at", "content")
    return restatements.ordered_pairs(restatements.restatements(entries))


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories").select(
        F.lit("memories").alias("src"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    regression = table(spark, sf_dir, "regression").select(
        F.lit("regression").alias("src"), F.col("id").alias("row_id"), "text")
    return memories.unionByName(regression)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.items(_free_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"))
    return found.select("src", "row_id", "pii_type", "start_at").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders; repeated rows once."""
    texts = _free_texts(spark, sf_dir).distinct()
    return personal.redact(texts, personal.items(texts, table(spark, sf_dir, "name_lexicon")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one changed, missing or added word (Chinese: character) in the passage."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"), max_edits=1)


#: Normalisation of texts in SQL, which has no NFKC and no entities: full-width forms and the entities that occur.
def _plain_sql(x: str) -> str:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    x = f"regexp_replace({x}, '&#(?:33|40|41|44|46|58|59|63);', ' ', 'g')"
    x = f"regexp_replace({x}, '</?[a-zA-Z][^<>]{{0,80}}>', ' ', 'g')"
    x = f"regexp_replace(translate({x}, '{_WIDE}', '{_NARROW}'), '[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]', '', 'g')"
    x = f"regexp_replace({x}, '(\\p{{L}})-[ \\t]*\\r?\\n[ \\t>]*(\\p{{L}})', '\\1\\2', 'g')"
    return f"lower(regexp_replace({x}, '[*_~`''’ʼ]', '', 'g'))"


_HAN_SQL = "[\u3400-\u9fff\uf900-\ufaff]"


def _p8_sql() -> str:
    words = f"regexp_extract_all(regexp_replace(x, '({_HAN_SQL})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    chars = "regexp_extract_all(x, '[\\p{L}\\p{N}]')"
    return f"""
WITH i AS (
  SELECT case_id, {_plain_sql('item')} AS x
  FROM (SELECT case_id, query AS item FROM eval_cases UNION SELECT case_id, fragment FROM eval_cases) WHERE item IS NOT NULL AND case_id IS NOT NULL),
k AS (SELECT case_id, x, {words} AS w, len(regexp_extract_all(x, '{_HAN_SQL}')) AS han FROM i),
ci AS (
  SELECT case_id, CASE WHEN han > 0 AND han >= len(w) - han THEN 'c' ELSE 'w' END AS kind,
    CASE WHEN han > 0 AND han >= len(w) - han THEN {chars} ELSE w END AS t FROM k),
cw AS (
  SELECT DISTINCT case_id, kind, array_to_string(t[p:p + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS p FROM (SELECT *, CASE kind WHEN 'c' THEN 20 ELSE 10 END AS n FROM ci))),
d AS (SELECT doc_id, {_plain_sql('"text"')} AS x FROM documents WHERE doc_id IS NOT NULL AND "text" IS NOT NULL),
dt AS (
  SELECT doc_id, 'w' AS kind, 10 AS n, {words} AS t FROM d UNION ALL
  SELECT doc_id, 'c', 20, {chars} FROM d WHERE regexp_matches(x, '{_HAN_SQL}')),
dw AS (SELECT doc_id, kind, array_to_string(t[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS p FROM dt))
SELECT DISTINCT case_id, doc_id FROM dw JOIN cw USING (kind, g)
"""


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return levels.select("doc_id", "band")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and band: documents, mean share of unfamiliar words, mean sentence length."""
    documents = table(spark, sf_dir, "documents")
    levels = reading.reading_levels(documents, table(spark, sf_dir, "reading_labels"))
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(
        F.count("*").alias("n"), F.round(F.avg("unfamiliar"), 4).alias("unfamiliar"),
        F.round(F.avg("sentence_words"), 2).alias("sentence_words"))


QUERIES = {
    "p2_day_summaries": p2_day_summaries, "p2_percentiles": p2_percentiles, "p2_bounds_hold": p2_bounds_hold,
    "p3_found": p3_found, "p4_found": p4_found, "p4_lift": p4_lift, "p5_found": p5_found, "p6_found": p6_found,
    "p6_redacted": p6_redacted, "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_near": p8_near, "p9_found": p9_found, "p9_profile": p9_profile,
}
SQL = {
    "p2_bounds_hold": """
WITH r AS (
  SELECT nullif(lower(trim(project)), '') AS project, enrichMs, episodeMs FROM capturerecord
  QUALIFY row_number() OVER (PARTITION BY session, turn ORDER BY logged_at DESC) = 1),
v AS (
  SELECT project, 'enrichMs' AS metric, enrichMs AS x FROM r UNION ALL SELECT project, 'episodeMs', CAST(episodeMs AS DOUBLE) FROM r),
o AS (
  SELECT project, metric, x, row_number() OVER (PARTITION BY project, metric ORDER BY x) AS place, count(*) OVER (PARTITION BY project, metric) AS n
  FROM v WHERE x IS NOT NULL AND NOT isnan(x) AND x >= 0)
SELECT project, metric, q, n, x AS exact_value, true AS held
FROM o JOIN (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q) ON place = greatest(1, ceil(q * n))
""",
    "p4_found": _P4 + "SELECT item_kind, item_a, item_b FROM s WHERE n_ab * n >= 3 * n_a * n_b",
    "p4_lift": _P4 + """
SELECT item_kind, item_a, item_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b), 4) AS lift FROM s
""",
    "p8_found": _p8_sql(),
    "p5_found": _P5 + """
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY turn, is_user DESC, step) AS INTEGER) AS pos, msg_id
FROM good WHERE has_text
""",
}
