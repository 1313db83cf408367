"""Queries over nested publication records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import nested

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/publication_raw.parquet")


def _table(name: str) -> Query:
    return lambda spark, d: nested.publication_tables(_raw(spark, d))[name]


def queries() -> dict[str, Query]:
    return {
        "p2_found": lambda spark, d: nested.license_links(_raw(spark, d)),
        "p2_links": lambda spark, d: nested.link_counts(_raw(spark, d)),
        "p2_records": _table("records"),
        "p2_platforms": _table("platforms"),
        "p2_license_files": _table("license_files"),
        "p2_bindings": _table("bindings"),
        "p2_executables": _table("executables"),
    }


FLAT = r"""
WITH base AS (SELECT record_id, ltrim(payload, chr(65279)) AS t FROM publication_raw),
whole AS (SELECT record_id, CAST(t AS JSON) AS j FROM base WHERE json_valid(t)),
plain AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM whole),
record AS (SELECT record_id, coalesce(j -> 'record', j) AS r FROM plain),
listed AS (SELECT record_id, coalesce(r -> 'platforms', r -> 'packs') AS p FROM record),
part AS (
  SELECT record_id, NULL AS key, unnest(CAST(p AS JSON[])) AS x FROM listed WHERE json_type(p) = 'ARRAY'
  UNION ALL
  SELECT record_id, e.key AS key, e.value AS x FROM (SELECT record_id, unnest(map_entries(CAST(p AS MAP(VARCHAR, JSON)))) AS e FROM listed WHERE json_type(p) = 'OBJECT')),
held AS (
  SELECT record_id, coalesce(x ->> 'platform_id', key) AS platform_id,
         CASE WHEN json_type(x -> 'license_files') = 'VARCHAR' THEN CAST(x ->> 'license_files' AS JSON) ELSE x -> 'license_files' END AS lf,
         CASE WHEN json_type(x -> 'baseline_binding') = 'ARRAY' THEN x -> 'baseline_binding' -> 0 ELSE x -> 'baseline_binding' END AS b,
         x -> 'executable' AS e, CASE WHEN json_type(x -> 'executable') = 'OBJECT' THEN x -> 'executable' ->> 'sha256' END AS sha
  FROM part),
one AS (
  SELECT record_id, platform_id, b, sha, unnest(CAST(lf AS JSON[])) AS f, NULL AS k FROM held WHERE json_type(lf) = 'ARRAY'
  UNION ALL
  SELECT record_id, platform_id, b, sha, lf AS f, NULL AS k FROM held WHERE json_type(lf) = 'OBJECT' AND (lf -> 'path') IS NOT NULL
  UNION ALL
  SELECT record_id, platform_id, b, sha, NULL AS f, unnest(json_keys(lf)) AS k FROM held WHERE json_type(lf) = 'OBJECT' AND (lf -> 'path') IS NULL),
flat AS (
  SELECT record_id, platform_id, coalesce(k, CASE WHEN json_type(f) = 'VARCHAR' THEN f ->> '$' ELSE f ->> 'path' END) AS license_path,
         coalesce(b ->> 'fixture_id', '') AS fixture_id, coalesce(sha, '') AS executable_sha256
  FROM one)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""{FLAT}
SELECT DISTINCT record_id, platform_id, license_path, fixture_id, executable_sha256 FROM flat WHERE license_path IS NOT NULL""",
        "p2_links": f"""{FLAT},
counts AS (
  SELECT record_id, count(DISTINCT coalesce(platform_id, '')) AS platforms,
         count(DISTINCT CASE WHEN json_type(b) = 'OBJECT' THEN coalesce(platform_id, '') END) AS bindings,
         count(DISTINCT CASE WHEN json_type(e) <> 'NULL' THEN coalesce(platform_id, '') END) AS executables
  FROM held GROUP BY record_id),
files AS (SELECT record_id, count(DISTINCT (platform_id, license_path)) AS license_files FROM flat WHERE license_path IS NOT NULL GROUP BY record_id)
SELECT record_id, platforms, coalesce(license_files, 0) AS license_files, bindings, executables FROM counts LEFT JOIN files USING (record_id)""",
    }
