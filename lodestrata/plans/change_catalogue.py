"""Queries of the change plan and of diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.operators import change_plan as cp
from lodestrata.operators import diffs
from lodestrata.plans import relations as R
from lodestrata.plans.relations import GROUPS, HARD, HUNKS, LINES, NUMSTAT, RISKY, TARGET, UNITS, sql_any, table

UNIT_COLS = ["file_id", "repo_id", "path", "additions", "deletions", "diff_bytes", "risk_tag", "group_id", "risk", "reason"]
GROUP_COLS = ["repo_id", "group_id", "risk", "reason", "diff_bytes", "n_files", "budget_status"]
PLAN_COLS = [*GROUP_COLS, "priority", "action", "split_source", "notes"]
CUSTOM = ("(^|/)planner", "ledger")


def _groups(s, d):
    return cp.group_units(R.units(s, d), TARGET, HARD)


def manifest_units(s, d):
    u = R.units(s, d)
    fingerprint = ids.stable_id("unit/v1", "repo_id", "path", "diff_bytes")
    return u.select(*UNIT_COLS, F.concat(F.lit("file:"), "path").alias("unit_id"), fingerprint.alias("fingerprint"))


def numstat_left_join(s, d):
    status = table(s, d, "candidate_file").select("path", F.col("repo_id").alias("old_path"), F.coalesce("change_status", F.lit("M")).alias("status")).distinct()
    counts = diffs.numstat(R.lines(s, d)).join(table(s, d, "split_suggestion").select("split_id", "repo_id", "path").distinct(), "split_id")
    per = counts.groupBy("path", F.col("repo_id").alias("old_path")).agg(F.max("additions").cast("string").alias("add"), F.when(F.max("deletions") == 0, "-").otherwise(F.max("deletions").cast("string")).alias("del"))
    return cp.name_status_numstat(status, per)


def control_totals(s, d):
    return R.units(s, d).groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("additions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.count_if(F.col("risk") == "high").alias("high_risk_files"), F.count_if(F.col("diff_bytes") == 0).alias("without_diff"),
    )


def path_risk(s, d):
    f = table(s, d, "manifest_entry").select("entry_id", "path")
    flags = {f"rule_{i}": cp.matches_any("path", (p,)) for i, p in enumerate(cp.PATH_RISK)}
    return f.select("entry_id", cp.matches_any("path", cp.PATH_RISK).alias("risky"), sum(c.cast("int") for c in flags.values()).alias("n_rules"))


def custom_rules(s, d):
    e = table(s, d, "manifest_entry").select("entry_id", "path")
    return e.select("entry_id", cp.matches_any("path", CUSTOM).alias("custom"), (cp.matches_any("path", CUSTOM) | cp.matches_any("path", cp.PATH_RISK)).alias("risky"))


def language_detect(s, d):
    e = table(s, d, "manifest_entry")
    return e.select("entry_id", cp.language("path").alias("by_path"), cp.skip_reason("path").alias("skip"))


def generated_lockfile_flags(s, d):
    return table(s, d, "manifest_entry").select("entry_id", cp.matches_any("path", cp.GENERATED).alias("generated_like"), cp.matches_any("path", cp.LOCKFILE).alias("lockfile"))


def hunk_split(s, d):
    return diffs.hunks(R.lines(s, d))


def path_functions(s, d):
    e = table(s, d, "manifest_entry")
    return e.select(
        "entry_id", text.group_component("path").alias("component"), text.safe_component("path").alias("safe"),
        text.valid_repo_path("path").alias("valid"), text.shell_quote("path").alias("quoted"),
    )


def queries():
    return {
        "manifest_units": manifest_units,
        "review_groups": lambda s, d: _groups(s, d).select(*GROUP_COLS),
        "review_plan": lambda s, d: cp.plan(_groups(s, d)).select(*PLAN_COLS),
        "plan_totals": lambda s, d: cp.plan_totals(cp.plan(_groups(s, d))),
        "numstat_left_join": numstat_left_join,
        "top_churn": lambda s, d: cp.top_churn(R.units(s, d)),
        "control_totals": control_totals,
        "path_risk": path_risk,
        "content_risk": lambda s, d: cp.content_risk_files(diffs.current_files(R.lines(s, d))),
        "custom_rules": custom_rules,
        "language_detect": language_detect,
        "generated_lockfile_flags": generated_lockfile_flags,
        "hunk_split": hunk_split,
        "added_lines": lambda s, d: diffs.added_lines(R.lines(s, d)),
        "diff_changed_ranges": lambda s, d: diffs.changed_ranges(R.lines(s, d)),
        "split_suggestions": lambda s, d: cp.split_suggestions(R.units(s, d), _groups(s, d), diffs.hunks(R.lines(s, d))),
        "review_queue": lambda s, d: cp.review_queue(R.units(s, d)),
        "dependency_lines": lambda s, d: cp.dependency_lines(R.lines(s, d)),
        "path_functions": path_functions,
    }


def oracle_sql():
    lang = "lower(path)"
    return {
        "manifest_units": f"""WITH {UNITS} SELECT {", ".join(UNIT_COLS)}, 'file:' || path AS unit_id,
  substr(sha256('unit/v1' || chr(0) || repo_id || chr(0) || path || chr(0) || CAST(diff_bytes AS VARCHAR) || chr(0)), 1, 16) AS fingerprint FROM unit""",
        "review_groups": f"WITH {GROUPS} SELECT {', '.join(GROUP_COLS)} FROM grp",
        "review_plan": f"WITH {GROUPS} SELECT {', '.join(PLAN_COLS)} FROM planned",
        "plan_totals": f"""WITH {GROUPS} SELECT repo_id, count(*) AS review_groups, CAST(sum(CASE WHEN risk = 'high' THEN n_files ELSE 0 END) AS BIGINT) AS high_risk_units,
  count(*) FILTER (WHERE action = 'split') AS split_required_groups FROM planned GROUP BY repo_id""",
        "numstat_left_join": f"""WITH {NUMSTAT},
status AS (SELECT DISTINCT path, repo_id AS old_path, coalesce(change_status, 'M') AS status FROM candidate_file),
per AS (SELECT d.path, d.repo_id AS old_path, max(n.additions) AS a, max(n.deletions) AS x FROM numstat n JOIN (SELECT DISTINCT split_id, repo_id, path FROM split_suggestion) d USING (split_id) GROUP BY 1, 2)
SELECT s.path, s.old_path, s.status, CAST(coalesce(p.a, 0) AS BIGINT) AS additions, CAST(coalesce(p.x, 0) AS BIGINT) AS deletions
FROM status s LEFT JOIN per p ON s.path = p.path AND s.old_path IS NOT DISTINCT FROM p.old_path""",
        "top_churn": f"WITH {UNITS} SELECT file_id, path, additions + deletions AS churn FROM unit ORDER BY churn DESC, path DESC, file_id DESC LIMIT 5",
        "control_totals": f"""WITH {UNITS} SELECT repo_id, count(*) AS files, CAST(sum(additions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
  count(*) FILTER (WHERE risk = 'high') AS high_risk_files, count(*) FILTER (WHERE diff_bytes = 0) AS without_diff FROM unit GROUP BY repo_id""",
        "path_risk": f"SELECT entry_id, {sql_any('path', cp.PATH_RISK)} AS risky, CAST({' + '.join(f'CAST({sql_any(chr(112) + chr(97) + chr(116) + chr(104), (p,))} AS INT)' for p in cp.PATH_RISK)} AS INT) AS n_rules FROM manifest_entry",
        "content_risk": f"WITH {LINES}, {RISKY} SELECT split_id, current_file FROM risky",
        "custom_rules": f"SELECT entry_id, {sql_any('path', CUSTOM)} AS custom, {sql_any('path', CUSTOM)} OR {sql_any('path', cp.PATH_RISK)} AS risky FROM manifest_entry",
        "language_detect": f"""SELECT entry_id, CASE WHEN {lang} LIKE '%.rs' THEN 'rust' WHEN {lang} LIKE '%.toml' THEN 'toml' WHEN regexp_matches({lang}, '[.]ya?ml$') THEN 'yaml'
  WHEN {lang} LIKE '%dockerfile' OR {lang} LIKE '%dockerfile.%' THEN 'dockerfile' WHEN {lang} LIKE '%.sql' THEN 'sql' ELSE 'unknown' END AS by_path,
  CASE WHEN NOT regexp_matches({lang}, '(^|/)(vendor|generated|dist)/|[.]min[.](js|css)$') THEN NULL WHEN {lang} LIKE '%vendor%' THEN 'vendored-structure-skipped'
  WHEN regexp_matches({lang}, '[.]min[.](js|css)$') THEN 'minified-structure-skipped' ELSE 'generated-like-structure-skipped' END AS skip FROM manifest_entry""",
        "generated_lockfile_flags": f"SELECT entry_id, {sql_any('path', cp.GENERATED)} AS generated_like, {sql_any('path', cp.LOCKFILE)} AS lockfile FROM manifest_entry",
        "hunk_split": f"WITH {HUNKS} SELECT * FROM hunk",
        "added_lines": f"""WITH {HUNKS},
body AS (SELECT split_id, path, hunk_no, line, line_no, CAST(p.c AS INT) + coalesce(sum(CASE WHEN line LIKE '-%' OR starts_with(line, chr(92)) THEN 0 ELSE 1 END)
  OVER (PARTITION BY split_id, hunk_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM part WHERE NOT regexp_matches(line, '{diffs.HEADER}'))
SELECT split_id, path, hunk_no, CAST(n AS INT) AS new_line FROM body WHERE line LIKE '+%'""",
        "diff_changed_ranges": f"""WITH {HUNKS} SELECT split_id, hunk_no, CASE WHEN new_count = 0 THEN greatest(new_start, 1) ELSE new_start END AS start_line,
  CASE WHEN new_count = 0 THEN greatest(new_start, 1) ELSE new_start + new_count - 1 END AS end_line, new_count = 0 AS deletion_anchor FROM hunk""",
        "split_suggestions": f"""WITH {GROUPS}, {HUNKS.replace(LINES + ",", "")},
want AS (SELECT u.file_id, u.repo_id, u.group_id, u.path FROM unit u JOIN grp g USING (repo_id, group_id) WHERE g.budget_status = 'split-required')
SELECT w.file_id, w.repo_id, w.group_id AS parent_group_id, CASE WHEN h.hunk_no IS NULL THEN 'file:' || w.path ELSE 'hunk:' || w.path || ':' || CAST(h.hunk_no AS VARCHAR) END AS unit_id,
  CASE WHEN h.hunk_no IS NULL THEN 'file' ELSE 'hunk' END AS split_kind, coalesce(h.hunk_header, 'none') AS hunk_header, coalesce(h.hunk_bytes, 0) AS hunk_bytes
FROM want w LEFT JOIN hunk h ON h.split_id = w.file_id""",
        "review_queue": f"""WITH {UNITS} SELECT file_id, repo_id, risk_tag, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY
  CASE risk_tag WHEN 'high-risk' THEN 0 WHEN 'medium' THEN 1 WHEN 'generated-like' THEN 2 ELSE 3 END, additions + deletions DESC, path, file_id) AS BIGINT) AS queue_no FROM unit""",
        "dependency_lines": rf"""WITH {LINES}, b AS (SELECT split_id, line_no, substr(line, 2) AS t FROM line WHERE line LIKE '+%' AND line NOT LIKE '+++%'),
k AS (SELECT split_id, CAST(line_no AS INT) AS line_no, CASE WHEN regexp_matches(t, '^\s*(import|from|use|require|include)\b') THEN 'import' WHEN regexp_matches(t, '^\s*(export|pub)\b') THEN 'export'
  WHEN regexp_matches(t, '^\s*(async\s+)?(fn|def|function|class|struct|interface)\b') THEN 'signature' WHEN regexp_matches(t, '(?i)^\s*(create|alter|drop)\s+(table|index|view)\b') THEN 'schema' END AS kind FROM b)
SELECT * FROM k WHERE kind IS NOT NULL""",
        "path_functions": f"""SELECT entry_id, CASE WHEN len(string_split(path, '/')) >= 2 THEN CASE WHEN string_split(path, '/')[2] IN ('migration', 'migrations', 'schema', 'schemas')
  THEN string_split(path, '/')[1] || '-' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END ELSE path END AS component, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS safe,
  path <> '' AND strlen(path) <= 4096 AND NOT regexp_matches(path, '(^|/)([.]{{1,2}})?(/|$)') AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '^[A-Za-z]:') AS valid,
  CASE WHEN regexp_matches(path, '^[A-Za-z0-9_@%+=:,./-]+$') THEN path ELSE '''' || replace(path, '''', '''"''"''') || '''' END AS quoted FROM manifest_entry""",
    }
