"""Queries of text functions over memories, documents, messages and user lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate, store
from ..session import table
from .common import ENTRIES, terms

WITH = f"WITH {ENTRIES}"
#: Signals of a kind, by order; the first that occurs counts.
KINDS = {
    "decision": r"decision|decided|entscheidung|决定", "lesson": r"lesson|教训|经验|lehre", "rule": r"never|must not|不要|darf",
    "preference": r"prefer|better use|希望", "event": r"we moved|after v|seit v|之后",
}
#: What a user line asks for.
INTENTS = {
    "fix": r"check why|wrong|broken|fails|bug|修|为什么", "change": r"set the|change|move|改成|rename", "continue": r"^(continue|go on|继续|weiter)",
    "question": r"\?|？|what|how|can you",
}
#: Complaints, by kind.
NEGATIVE = {
    "correction": r"wrong file|not what i|ignored|undo|stop rewriting|falsche datei|nicht gemeint|不是这个意思|不该动|没看吗|zurücknehmen",
    "insult": r"are you even|useless|stupid|why is it so slow|warum dauert|怎么这么慢|根本没过|never passed",
}
PATH = r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return store.entries(table(spark, d, "memories"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    split = _entries(spark, d).select("kind", text.terms(F.col("content")).alias("t"))
    return split.select("kind", F.explode("t").alias("term")).groupBy("kind").agg(
        F.count("*").alias("n_terms"), F.count_distinct("term").alias("n_distinct"))


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("kind", text.estimated_tokens(F.col("text")).alias("c"))
    return rows.groupBy("kind").agg(F.sum("c").alias("tokens"), F.max("c").alias("most"))


def fingerprint_copies(spark: SparkSession, d: str) -> DataFrame:
    """Groups of entries equal after the fingerprint: size and first id."""
    return _entries(spark, d).where(F.trim("content") != "").groupBy(text.fingerprint(F.col("content")).alias("f")).agg(
        F.count("*").alias("n"), F.min("id").alias("id")).where(F.col("n") > 1).select("id", "n")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where(F.col("content").isNotNull()).select("id", text.content_hash(F.col("content")).alias("hash"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """The fifty identifiers that stand in most entries."""
    found = _entries(spark, d).select("id", F.explode(text.identifiers_in(F.col("content"))).alias("entity"))
    return found.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity").limit(50)


def paths_by_module(spark: SparkSession, d: str) -> DataFrame:
    paths = _entries(spark, d).select(F.explode(text.paths_in(F.col("content"))).alias("path"))
    return paths.groupBy(text.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


def text_signals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _entries(spark, d).groupBy("kind").agg(
        F.sum(F.size(text.numbers_in(c)).cast("long")).alias("numbers"), F.count_if(text.has_negation(c)).alias("negated"),
        F.count_if(text.has_update_signal(c)).alias("updates"))


def inferred_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("kind", text.first_label(F.col("content"), KINDS, "fact").alias("inferred")).agg(F.count("*").alias("n"))


def intents(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "session_messages").where((F.col("type") == "user/message") & (F.col("source_kind") == "user") & F.col("text").isNotNull())
    return users.groupBy(text.first_label(F.col("text"), INTENTS, "none").alias("intent")).agg(F.count("*").alias("n"))


def negativity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "regression").select("id", "text").distinct()
    found = lines.select("id", text.all_labels(F.coalesce("text", F.lit("")), NEGATIVE).alias("labels"))
    return found.select("id", F.array_join("labels", "+").alias("labels"), F.size("labels").cast("long").alias("level"))


def detection_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The complaint patterns against the expected outcome of the user lines."""
    lines = table(spark, d, "regression").where(F.col("text").isNotNull()).select("id", "text", "expect").distinct()
    predicted = F.size(text.all_labels(F.col("text"), NEGATIVE)) > 0
    return evaluate.confusion(lines, F.col("expect") == "hit", predicted)


def kb_slices(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at second-level headings: slices per document, blank ones left out."""
    parts = table(spark, d, "documents").where(F.col("text").isNotNull()).select(
        "doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n", "\n"), r"(?m)^## ")).alias("pos", "part"))
    return parts.where(F.col("part").rlike(r"[^ \t\r\n]")).groupBy("doc_id").agg(
        F.count("*").alias("n_slices"), F.max(F.length("part")).cast("long").alias("longest"))


def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand in 3 to 8 entries."""
    found = _entries(spark, d).select("id", F.explode(text.token_set(F.col("content"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n").between(3, 8))


def tag_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Stored tags against #tags and identifiers found in the content, per kind of agreement."""
    stored = table(spark, d, "tags").where(F.col("tag").isNotNull()).select(
        F.col("memory_id").alias("id"), F.lower(F.trim("tag")).alias("tag")).distinct().withColumn("stored", F.lit(True))
    found = _entries(spark, d).select("id", F.explode(F.array_union(
        text.identifiers_in(F.col("content")), text.hash_tags(F.col("content")))).alias("tag")).withColumn("found", F.lit(True))
    both = stored.join(found, ["id", "tag"], "full")
    state = F.when(F.col("found").isNull(), "orphan").when(F.col("stored").isNull(), "missing").otherwise("derived")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _case(x: str, patterns: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{k}'" for k, p in patterns.items())
    return f"CASE {whens} ELSE '{default}' END"


_IDS = "list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z]*[a-z][A-Z][A-Za-z]+'), lambda x: lower(x)))"
_HASH = "list_filter(list_transform(regexp_extract_all(content, '#([\\p{L}\\p{N}_-]+)', 1), lambda x: lower(x)), lambda x: NOT regexp_full_match(x, '[0-9]+'))"
_LEVELS = " , ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{k}' END" for k, p in NEGATIVE.items())
_FLAG = " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in NEGATIVE.values())

SQL = {
    "token_stats": WITH + f", t AS (SELECT kind, unnest({terms('content')}) AS term FROM entries) SELECT kind, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM t GROUP BY kind",
    "token_costs": """WITH c AS (SELECT kind, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS h, length(text) AS l FROM documents WHERE text IS NOT NULL)
      SELECT kind, CAST(sum(h + CAST(ceil((l - h) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, max(h + CAST(ceil((l - h) / 4.0) AS BIGINT)) AS most FROM c GROUP BY kind""",
    "fingerprint_copies": WITH + """SELECT min(id) AS id, count(*) AS n FROM entries WHERE trim(content) <> ''
      GROUP BY regexp_replace(lower(content), '[\\s\\p{P}\\p{S}]+', '', 'g') HAVING count(*) > 1""",
    "content_hashes": WITH + "SELECT id, substring(sha256(trim(content)), 1, 16) AS hash FROM entries WHERE content IS NOT NULL",
    "identifiers": WITH + f", f AS (SELECT id, unnest({_IDS}) AS entity FROM entries) SELECT entity, count(*) AS n FROM f GROUP BY entity ORDER BY n DESC, entity LIMIT 50",
    "paths_by_module": WITH + f""", p AS (SELECT unnest(regexp_extract_all(content, '{PATH}', 1)) AS path FROM entries)
      SELECT array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') AS module, count(*) AS n, count(DISTINCT path) AS n_paths FROM p GROUP BY 1""",
    "text_signals": WITH + """SELECT kind, CAST(sum(len(regexp_extract_all(content, '\\d+(?:\\.\\d+)*'))) AS BIGINT) AS numbers,
      count(*) FILTER (regexp_matches(lower(content), '\\b(not|never|no|cannot|nicht|kein|keine|nie)\\b') OR regexp_matches(content, '不|没|别|勿')) AS negated,
      count(*) FILTER (regexp_matches(lower(content), '\\b(now|instead|no longer|changed|moved|since|replaces|statt|jetzt)\\b') OR regexp_matches(content, '改成|改为|换成|不再|现在|之后')) AS updates
      FROM entries GROUP BY kind""",
    "inferred_kinds": WITH + f"SELECT kind, {_case('content', KINDS, 'fact')} AS inferred, count(*) AS n FROM entries GROUP BY 1, 2",
    "intents": f"""SELECT {_case('text', INTENTS, 'none')} AS intent, count(*) AS n FROM session_messages
      WHERE "type" = 'user/message' AND source_kind = 'user' AND text IS NOT NULL GROUP BY 1""",
    "negativity": f"""WITH l AS (SELECT id, list_filter([{_LEVELS}], lambda x: x IS NOT NULL) AS labels FROM (SELECT DISTINCT id, text FROM regression))
      SELECT id, coalesce(array_to_string(labels, '+'), '') AS labels, len(labels) AS level FROM l""",
    "detection_confusion": f"""WITH p AS (SELECT DISTINCT id, text, coalesce(expect = 'hit', false) AS a, ({_FLAG}) AS p FROM regression WHERE text IS NOT NULL),
      c AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM p)
      SELECT *, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr FROM c""",
    "kb_slices": """WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\\r\\n', chr(10), 'g'), '(?m)^## ')) AS part FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, count(*) AS n_slices, max(length(part)) AS longest FROM p WHERE regexp_matches(part, '[^ \\t\\r\\n]') GROUP BY doc_id""",
    "shared_words": WITH + f", f AS (SELECT id, unnest(list_distinct({terms('content')})) AS term FROM entries) SELECT term, count(*) AS n, min(id) AS first_id FROM f GROUP BY term HAVING count(*) BETWEEN 3 AND 8",
    "tag_provenance": WITH + f""", s AS (SELECT DISTINCT memory_id AS id, lower(trim(tag)) AS tag FROM tags WHERE tag IS NOT NULL),
      f AS (SELECT DISTINCT id, tag FROM (SELECT id, unnest(list_concat({_IDS}, {_HASH})) AS tag FROM entries))
      SELECT CASE WHEN f.id IS NULL THEN 'orphan' WHEN s.id IS NULL THEN 'missing' ELSE 'derived' END AS state, count(*) AS n
      FROM s FULL JOIN f ON s.id = f.id AND s.tag = f.tag GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (
    token_stats, token_costs, fingerprint_copies, content_hashes, identifiers, paths_by_module, text_signals, inferred_kinds, intents,
    negativity, detection_confusion, kb_slices, shared_words, tag_provenance)}
