"""JSON-lines sources and sinks: append logs by day, exports, idempotent imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPISODES = "id string, session string, turn int, role string, text string, at timestamp, project string, broken string"


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Valid episodes of day files, one per id; broken lines and other roles are left out, the earliest of equal ids counts."""
    rows = spark.read.schema(EPISODES).option("columnNameOfCorruptRecord", "broken").json(path)
    fine = rows.where(F.col("id").isNotNull() & F.col("role").isin("user", "assistant") & F.col("at").isNotNull())
    return fine.groupBy("id").agg(F.min(F.struct("at", "session", "turn", "role", "text", "project")).alias("e")).select("id", "e.*")


def append(df: DataFrame, path: str, at: str = "at") -> None:
    """Appends rows as JSON lines to folders by UTC day."""
    df.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def tail(df: DataFrame, at: str, n: int) -> DataFrame:
    return df.orderBy(F.col(at).desc()).limit(n)


def capped_per_day(df: DataFrame, at: str, most: int, tie: str) -> DataFrame:
    """The first ``most`` rows of each day: a ledger's cap on its lines, a stated feature."""
    order = Window.partitionBy(F.to_date(at)).orderBy(at, tie)
    return df.withColumn("n_of_day", F.row_number().over(order)).where(F.col("n_of_day") <= most).drop("n_of_day")


def export(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with its keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def import_states(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state) of each incoming row: new, unchanged or updated; a row without key or content is malformed."""
    now = current.select(key, F.sha2(content, 256).alias("h_now"))
    rows = incoming.withColumn("h", F.sha2(content, 256))
    fine = rows.where(F.col(key).isNotNull() & (F.trim(content) != ""))
    states = fine.join(now, key, "left").select(
        key, F.when(F.col("h_now").isNull(), "new").when(F.col("h_now") == F.col("h"), "unchanged").otherwise("updated").alias("state"))
    bad = rows.where(F.col(key).isNull() | F.coalesce(F.trim(content) == "", F.lit(True))).select(key, F.lit("malformed").alias("state"))
    return states.unionByName(bad)
