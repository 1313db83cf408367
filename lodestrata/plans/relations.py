"""Input relations of the catalogue, once as DataFrames and once as SQL.

Tables may repeat rows; each relation says which rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import change_plan, diffs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_lines(table(spark, d, "split_suggestion"))


LINES = """
diff AS (SELECT DISTINCT split_id, repo_id, path, diff_text FROM split_suggestion WHERE diff_text IS NOT NULL),
line AS (
  SELECT split_id, repo_id, path, i AS line_no, regexp_replace(l, chr(13) || '$', '') AS line
  FROM (SELECT split_id, repo_id, path, unnest(string_split(diff_text, chr(10))) AS l, generate_subscripts(string_split(diff_text, chr(10)), 1) AS i FROM diff))"""

NUMSTAT = f"""{LINES},
numstat AS (
  SELECT split_id, count(*) FILTER (WHERE line LIKE '+%' AND line NOT LIKE '+++ %') AS additions,
         count(*) FILTER (WHERE line LIKE '-%' AND line NOT LIKE '--- %') AS deletions
  FROM line GROUP BY split_id)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """Changed files with their counts, sizes and classes."""
    files = table(spark, d, "candidate_file").select("file_id", "repo_id", "path", "change_status", "presence")
    each = lines(spark, d)
    counts = diffs.numstat(each)
    sizes = table(spark, d, "split_suggestion").where("diff_text is not null").groupBy("split_id").agg(F.max(F.octet_length("diff_text")).cast("bigint").alias("size"))
    risky = change_plan.content_risk_files(diffs.current_files(each)).select("split_id").distinct().withColumn("content_risk", F.lit(True))
    parts = reduce(lambda a, b: a.join(b, "split_id", "left"), [sizes, counts, risky]).withColumnRenamed("split_id", "file_id")
    joined = files.join(parts, "file_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("additions", "deletions")}
    joined = joined.withColumns({**zero, "diff_bytes": F.coalesce("size", F.lit(0))}).drop("size")
    return change_plan.classify(joined, F.col("content_risk"))


def sql_any(expression: str, patterns: tuple[str, ...]) -> str:
    """The SQL test that corresponds to ``change_plan.matches_any``."""
    pattern = change_plan.alternation(patterns).replace("'", "''")
    return f"coalesce(regexp_matches({expression}, '{pattern}'), false)"


COMPONENT = """regexp_replace(CASE WHEN len(string_split(path, '/')) >= 2 THEN
  CASE WHEN string_split(path, '/')[2] IN ('migration', 'migrations', 'schema', 'schemas') THEN string_split(path, '/')[1] || '-' || string_split(path, '/')[2]
       ELSE string_split(path, '/')[1] END ELSE path END, '[^A-Za-z0-9._-]', '_', 'g')"""

CURRENT = """
carried AS (
  SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS)
    OVER (PARTITION BY split_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), path) AS current_file
  FROM line)"""

RISKY = f"""{CURRENT},
risky AS (
  SELECT DISTINCT split_id, current_file FROM carried
  WHERE (line LIKE '+%' OR line LIKE '-%') AND line NOT LIKE '+++%' AND line NOT LIKE '---%' AND {sql_any("substr(line, 2)", change_plan.CONTENT_RISK)})"""

UNITS = f"""{NUMSTAT}, {RISKY},
sizes AS (SELECT split_id, max(strlen(diff_text)) AS size FROM split_suggestion WHERE diff_text IS NOT NULL GROUP BY split_id),
plain AS (
  SELECT c.file_id, c.repo_id, c.path, c.change_status, c.presence, coalesce(n.additions, 0) AS additions, coalesce(n.deletions, 0) AS deletions,
         CAST(coalesce(s.size, 0) AS BIGINT) AS diff_bytes, r.split_id IS NOT NULL AS content_risk,
         {sql_any("c.path", change_plan.PATH_RISK)} AS path_risk, {sql_any("c.path", change_plan.GENERATED)} AS gen, {sql_any("c.path", change_plan.LOCKFILE)} AS lock
  FROM candidate_file c LEFT JOIN sizes s ON s.split_id = c.file_id LEFT JOIN numstat n ON n.split_id = c.file_id
  LEFT JOIN (SELECT DISTINCT split_id FROM risky) r ON r.split_id = c.file_id),
unit AS (
  SELECT *, CASE WHEN path_risk OR content_risk THEN 'high-risk' WHEN gen THEN 'generated-like' WHEN lock THEN 'lockfile' ELSE 'medium' END AS risk_tag,
    CASE WHEN path_risk OR content_risk THEN 'high-risk-' || {COMPONENT} WHEN gen THEN 'consistency-' || {COMPONENT}
         WHEN lock THEN 'consistency-lockfiles' ELSE 'module-' || {COMPONENT} END AS group_id,
    CASE WHEN path_risk OR content_risk THEN 'high' WHEN gen OR lock THEN 'consistency' ELSE 'medium' END AS risk,
    CASE WHEN path_risk OR content_risk THEN 'path-or-content-risk' WHEN gen THEN 'generated-like' WHEN lock THEN 'lockfile' ELSE 'module' END AS reason
  FROM plain)"""

#: Smaller limits than in production, so that all three budget states occur in the test tables.
TARGET, HARD = 6_000, 15_000

GROUPS = f"""{UNITS},
grp AS (
  SELECT repo_id, group_id, arg_min(risk, path) AS risk, arg_min(reason, path) AS reason, CAST(sum(diff_bytes) AS BIGINT) AS diff_bytes, count(*) AS n_files,
         CASE WHEN sum(diff_bytes) > {HARD} THEN 'split-required' WHEN sum(diff_bytes) > {TARGET} THEN 'over-target' ELSE 'ok' END AS budget_status
  FROM unit GROUP BY repo_id, group_id),
planned AS (
  SELECT *, CAST(CASE WHEN budget_status = 'split-required' THEN 1 WHEN risk = 'high' THEN 2 WHEN risk = 'consistency' THEN 3 ELSE 4 END AS INT) AS priority,
         CASE WHEN budget_status = 'split-required' THEN 'split' ELSE 'review' END AS action,
         CASE WHEN budget_status = 'split-required' THEN 'Split Suggestions and Split Unit Diff Preview' ELSE 'none' END AS split_source,
         CASE WHEN budget_status = 'split-required' THEN 'replace-with-split-suggestions-before-review' ELSE 'review-complete-group-before-coverage-validation' END AS notes
  FROM grp)"""

HUNKS = f"""{LINES},
inhunk AS (
  SELECT * FROM (
    SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '{diffs.HEADER}') THEN 1 ELSE 0 END) OVER w AS INT) AS hunk_no,
           last_value(CASE WHEN regexp_matches(line, '{diffs.HEADER}') THEN line END IGNORE NULLS) OVER w AS hunk_header
    FROM line WINDOW w AS (PARTITION BY split_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE hunk_no > 0),
part AS (
  SELECT *, regexp_extract(hunk_header, '^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@', ['a', 'b', 'c', 'd']) AS p FROM inhunk),
hunk AS (
  SELECT split_id, hunk_no, hunk_header, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS hunk_bytes,
         CAST(p.a AS INT) AS old_start, CAST(CASE WHEN p.b = '' THEN '1' ELSE p.b END AS INT) AS old_count,
         CAST(p.c AS INT) AS new_start, CAST(CASE WHEN p.d = '' THEN '1' ELSE p.d END AS INT) AS new_count
  FROM part GROUP BY split_id, hunk_no, hunk_header, p)"""
