"""Markdown sources and sinks: entry files with front-matter blocks, knowledge pages in slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

FIELDS = ["id", "kind", "source", "scope", "project", "status", "valid_at", "asserted_at"]
BLOCK = r"(?s)(?:^|\n)---\n(.*?)\n---\n(.*?)(?=\n---\n[A-Za-z_]+:|\z)"


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(file, body) of each matching file below a folder, line ends as \\n."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("body"))


def field(head: Column, name: str) -> Column:
    """The value of one front-matter field; null where it is missing or empty."""
    value = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.when(value != "", value)


def unknown_lines(head: Column) -> Column:
    """Front-matter lines of fields that aren't known, kept as they are for a later rewrite."""
    known = "|".join([*FIELDS, "tags"])
    return F.filter(F.split(head, "\n"), lambda line: ~line.rlike(rf"^({known}):") & (F.trim(line) != ""))


def parse_tags(value: Column) -> Column:
    """Tags from a JSON list or, as written earlier, from comma-separated words; without numbers and stand-ins for nothing."""
    listed = F.coalesce(F.from_json(value, "array<string>"), F.split(value, ","))
    clean = F.transform(listed, lambda t: F.lower(F.trim(F.regexp_replace(t, r"^\s*#+", ""))))
    return F.array_distinct(F.filter(clean, lambda t: ~t.isin("", "null", "undefined", "none", "nan") & ~t.rlike(r"^[\d.]+$")))


def parse_entries(files: DataFrame) -> DataFrame:
    """One row per block of each file: the fields, tags, content, unknown lines and whether it is valid.

    A block without a usable id or content is not valid; the caller writes such
    rows to a side output. Of equal ids the one of the last file counts.
    """
    blocks = files.select("file", F.posexplode(F.regexp_extract_all("body", F.lit(BLOCK), F.lit(0))).alias("pos", "block"))
    cut = blocks.select("file", "pos", F.regexp_extract("block", BLOCK, 1).alias("head"), F.regexp_extract("block", BLOCK, 2).alias("content"))
    rows = cut.select("file", "pos", *[field(F.col("head"), f).alias(f) for f in FIELDS], parse_tags(field(F.col("head"), "tags")).alias("tags"),
                      F.trim(F.regexp_replace("content", r"^\n+|\n+$", "")).alias("content"), unknown_lines(F.col("head")).alias("extra"))
    valid = F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False)) & (F.col("content") != "")
    return rows.withColumn("valid", valid)


def latest_of_ids(rows: DataFrame) -> DataFrame:
    """One valid row per id: that of the greatest (file, pos)."""
    return rows.where("valid").groupBy("id").agg(F.max(F.struct("file", "pos", *[c for c in rows.columns if c not in ("id", "file", "pos")])).alias("r")).select("id", "r.*")


def render(df: DataFrame, columns: list[str]) -> DataFrame:
    """(block): entries as front-matter blocks; lines of the content that look like a border are escaped."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.regexp_replace(F.col(c).cast("string"), r"\s*\n\s*", " "))) for c in columns]
    body = F.regexp_replace("content", r"(?m)^---$", r"\\---")
    return df.select(F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), body, F.lit("\n")).alias("block"))


def slices(files: DataFrame) -> DataFrame:
    """(id, file, title, body): pages cut before each second-level heading; blank parts are left out."""
    parts = files.select("file", F.posexplode(F.split("body", r"(?m)^(?=## )")).alias("pos", "body")).where(F.col("body").rlike(r"\S"))
    return parts.select(F.concat(F.substring(F.sha2("file", 256), 1, 12), F.lit("-s"), F.col("pos").cast("string")).alias("id"), "file",
                        F.trim(F.regexp_extract("body", r"(?m)^#{1,2} (.*)$", 1)).alias("title"), "body")


def changed_slices(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) between two states of sliced pages, by content hash."""
    a = old.select("id", text.content_hash(F.col("body")).alias("h_old"))
    b = new.select("id", text.content_hash(F.col("body")).alias("h_new"))
    return a.join(b, "id", "full").select("id", F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed")
                                          .when(F.col("h_old") != F.col("h_new"), "updated").otherwise("unchanged").alias("change"))
