"""Queries of problem 1 over memory_snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.memory_versions(table(spark, sf_dir, "memory_snapshots"))


def p1_satellite_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each satellite holds, and how many of their periods are open."""
    view = history.satellite_view(history.memory_satellites(table(spark, sf_dir, "memory_snapshots")), "memory_id")
    return view.groupBy("satellite").agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("n_open")
    )


_NORMAL = """
WITH raw AS (
  SELECT memory_id, snap_date, loaded_at,
    CASE WHEN status IS NULL OR lower(trim(status)) IN ('', 'null') THEN 'active' ELSE lower(trim(status)) END AS st,
    CASE WHEN expires_at IS NULL OR lower(trim(expires_at)) IN ('', 'null') THEN NULL
         ELSE epoch_us(CAST(CASE WHEN regexp_matches(trim(expires_at), '([Zz]|[+-]\\d{2}:?\\d{2})$') THEN trim(expires_at)
              ELSE trim(expires_at) || 'Z' END AS TIMESTAMPTZ)) END AS ex,
    CASE WHEN valid_at IS NULL OR lower(trim(valid_at)) IN ('', 'null') THEN NULL
         ELSE epoch_us(CAST(CASE WHEN regexp_matches(trim(valid_at), '([Zz]|[+-]\\d{2}:?\\d{2})$') THEN trim(valid_at)
              ELSE trim(valid_at) || 'Z' END AS TIMESTAMPTZ)) END AS va,
    CASE WHEN merged_from IS NULL OR trim(merged_from) IN ('', 'null', '[]') THEN ''
         ELSE array_to_string(list_sort(list_distinct(from_json(merged_from, '["VARCHAR"]'))), ',') END AS mf
  FROM memory_snapshots WHERE memory_id IS NOT NULL AND snap_date IS NOT NULL),
latest AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY memory_id, snap_date ORDER BY loaded_at DESC NULLS LAST, st DESC, ex DESC, va DESC, mf DESC) = 1),
cal AS (
  SELECT snap_date, row_number() OVER (ORDER BY snap_date) AS k, lead(snap_date) OVER (ORDER BY snap_date) AS nx
  FROM (SELECT DISTINCT snap_date FROM memory_snapshots WHERE snap_date IS NOT NULL)),
seq AS (
  SELECT l.*, k, nx,
    lag(k) OVER w AS pk, lag(st) OVER w AS pst, lag(ex) OVER w AS pex, lag(va) OVER w AS pva, lag(mf) OVER w AS pmf, lead(k) OVER w AS nk
  FROM latest l JOIN cal USING (snap_date) WINDOW w AS (PARTITION BY memory_id ORDER BY snap_date)),
flag AS (
  SELECT *, (pk IS NULL OR pk + 1 <> k) AS app, (nk IS NULL OR nk - 1 <> k) AS van FROM seq)
"""

SQL = {
    "p1_found": _NORMAL + """
, run AS (
  SELECT *, sum(CASE WHEN app OR st IS DISTINCT FROM pst OR ex IS DISTINCT FROM pex OR va IS DISTINCT FROM pva OR mf IS DISTINCT FROM pmf
                THEN 1 ELSE 0 END) OVER (PARTITION BY memory_id ORDER BY snap_date) AS grp FROM flag)
SELECT memory_id, strftime(min(snap_date), '%Y-%m-%d') AS version_from,
       max_by(coalesce(strftime(nx, '%Y-%m-%d'), '9999-12-31'), snap_date) AS version_to
FROM run GROUP BY memory_id, grp
""",
    "p1_satellite_periods": _NORMAL + """
, rws AS (
  SELECT memory_id, 'state' AS satellite FROM flag WHERE app OR st IS DISTINCT FROM pst
  UNION ALL SELECT memory_id, 'validity' FROM flag WHERE app OR ex IS DISTINCT FROM pex
  UNION ALL SELECT memory_id, 'origin' FROM flag WHERE app OR va IS DISTINCT FROM pva OR mf IS DISTINCT FROM pmf
  UNION ALL SELECT memory_id, 'presence' FROM flag WHERE app
  UNION ALL SELECT memory_id, 'presence' FROM flag WHERE van AND nx IS NOT NULL)
SELECT satellite, count(*) AS n_rows, count(DISTINCT memory_id) AS n_open FROM rws GROUP BY satellite
""",
}
QUERIES = {"p1_found": p1_found, "p1_satellite_periods": p1_satellite_periods}
