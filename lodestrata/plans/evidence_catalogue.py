"""Queries of evidence: facts stand in for findings, changed files for units."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evidence as ev
from lodestrata.plans.relations import table

#: Stand-ins: a fact's kind as raw severity, its resolution as baseline state.
SEVERITIES = {"authorization": "fatal", "storage": "high", "cache": "HIGH", "network": "medium", "broker": "warning", "framework": "info", "lifecycle": "low"}
BASELINES = {"resolved": "existing", "unresolved": "new"}
COLS = [*ev.KEY, "severity", "confidence", "category", "baseline_state", "completed"]


def findings(s, d):
    f = table(s, d, "normalized_fact")
    raw = F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p]), F.col("kind"))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in BASELINES.items() for x in p]), F.col("resolution")), F.lit("unknown"))
    return f.select(
        "repo_id", F.col("provider_id").alias("tool"), "rule_id", F.col("text").alias("message"), "path",
        F.col("source_range.start_line").alias("start_line"), F.col("source_range.end_line").alias("end_line"), ev.severity(raw).alias("severity"), ev.confidence("confidence").alias("confidence"),
        ev.category("rule_id", "text", "provider_id").alias("category"), base.alias("baseline_state"), (F.col("provenance") != "inferred").alias("completed"), F.col("fact_id").alias("report_id"),
    )


def units(s, d):
    c = table(s, d, "candidate_file").where("presence = 'present'")
    added = F.filter(F.coalesce("changed_ranges", F.array().cast("array<struct<start_line:int,end_line:int,deletion_anchor:boolean>>")), lambda r: ~r["deletion_anchor"])
    return c.groupBy("repo_id", "path").agg(F.min(F.concat(F.lit("file:"), "path")).alias("unit_id"), F.flatten(F.collect_list(added)).alias("added"))


def assessed(s, d):
    return ev.assess(ev.merge(findings(s, d)), units(s, d))


OUT = [*COLS, "report_ids", "unit_id", "line_scope", "blocking_candidate", "disposition", "finding_id"]


def union(s, d):
    a = assessed(s, d).select("repo_id", "finding_id", "disposition")
    both = ev.union_evidence([("exec-a", a), ("exec-b", a.where("disposition <> 'outside-scope'"))])
    return both.groupBy("execution_id", "disposition").agg(F.count("*").alias("n"), F.countDistinct("finding_id").alias("ids"), F.min("finding_id").alias("least"))


def queries():
    return {
        "finding_merge": lambda s, d: ev.merge(findings(s, d)),
        "disposition": lambda s, d: assessed(s, d).select(*OUT),
        "evidence_rank": lambda s, d: ev.truncated(ev.ranked(assessed(s, d)), 20).select("repo_id", "place", "finding_id", "disposition", "truncated"),
        "evidence_counts": lambda s, d: ev.counts(findings(s, d), assessed(s, d)),
        "evidence_union": union,
        "report_union": lambda s, d: ev.report_union(table(s, d, "normalized_fact").select(F.col("fact_id").alias("report_id"), F.concat_ws("|", "text", "rule_id").alias("content"))),
        "orchestration_status": lambda s, d: ev.orchestration_status(table(s, d, "manifest_entry").select("repo_id", (F.col("status") == "completed").alias("accepted")), "repo_id"),
        "severity_category": lambda s, d: findings(s, d).select(F.col("report_id").alias("fact_id"), "severity", "confidence", "category").distinct(),
    }


def _case(expression: str, words: dict[str, str], other: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items()) + f" ELSE {other} END"


def oracle_sql():
    rk = ev.ranks.sql_rank
    back = lambda e, order: f"CASE {e} " + " ".join(f"WHEN {n} THEN '{w}'" for w, n in order.items()) + " END"
    corpus = "lower(concat_ws(' ', rule_id, text, provider_id))"
    cat = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({corpus}, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{c}'" for c, needles in ev.CATEGORIES.items()) + " ELSE 'unknown' END"
    low = lambda e: f"replace(lower({e}), '_', '-')"
    raw = _case("kind", SEVERITIES, "NULL")
    find = f"""finding AS (SELECT repo_id, provider_id AS tool, rule_id, text AS message, path, source_range.start_line AS start_line, source_range.end_line AS end_line,
  {_case(low(raw), ev.SEVERITY_WORDS, "'unknown'")} AS severity, {_case(low('confidence'), ev.CONFIDENCE_WORDS, "'unknown'")} AS confidence, {cat} AS category,
  {_case('resolution', BASELINES, "'unknown'")} AS baseline_state, provenance <> 'inferred' AS completed, fact_id AS report_id FROM normalized_fact)"""
    key = ", ".join(ev.KEY)
    merged = f"""{find}, merged AS (SELECT {key}, {back(f"max({rk('severity', ev.SEVERITY)})", ev.SEVERITY)} AS severity, {back(f"max({rk('confidence', ev.CONFIDENCE)})", ev.CONFIDENCE)} AS confidence,
  coalesce(arg_min(category, report_id || category) FILTER (WHERE category <> 'unknown'), 'unknown') AS category, {back(f"max({rk('baseline_state', ev.BASELINE)})", ev.BASELINE)} AS baseline_state,
  bool_or(completed) AS completed, list_sort(list(DISTINCT report_id)) AS report_ids FROM finding GROUP BY {key})"""
    mat = ", ".join(f"'{m}'" for m in ev.MATERIAL)
    assess = f"""{merged},
unit AS (SELECT repo_id, path, min('file:' || path) AS unit_id, flatten(list(list_filter(coalesce(changed_ranges, []), lambda r: NOT r.deletion_anchor))) AS added FROM candidate_file WHERE presence = 'present' GROUP BY repo_id, path),
scoped AS (SELECT m.* EXCLUDE (baseline_state), m.baseline_state AS b0, u.unit_id, CASE WHEN u.unit_id IS NULL THEN 'outside-scope' WHEN m.start_line IS NULL THEN 'unknown'
    WHEN len(list_filter(u.added, lambda r: r.start_line <= coalesce(m.end_line, m.start_line) AND r.end_line >= m.start_line)) > 0 THEN 'added' ELSE 'unchanged' END AS line_scope
  FROM merged m LEFT JOIN unit u ON u.repo_id = m.repo_id AND u.path = m.path),
based AS (SELECT *, CASE WHEN line_scope = 'added' THEN 'new' ELSE b0 END AS baseline_state FROM scoped),
marked AS (SELECT *, completed AND line_scope = 'added' AND category IN ({mat}) AND severity IN ('critical', 'error') AND confidence IN ('very-high', 'high') AS blocking_candidate FROM based),
assessed AS (SELECT *, CASE WHEN line_scope = 'outside-scope' THEN 'outside-scope' WHEN blocking_candidate THEN 'blocking-candidate'
    WHEN completed AND category IN ({mat}) AND severity IN ('critical', 'error', 'warning') AND (line_scope IN ('added', 'unknown') OR baseline_state = 'new') THEN 'priority-candidate' ELSE 'note' END AS disposition,
  substr(sha256(tool || chr(0) || rule_id || chr(0) || message || chr(0) || path || chr(0) || coalesce(CAST(start_line AS VARCHAR), 'None') || chr(0) || coalesce(CAST(end_line AS VARCHAR), 'None') || chr(0)), 1, 16) AS finding_id FROM marked)"""
    return {
        "finding_merge": f"WITH {merged} SELECT * FROM merged",
        "disposition": f"WITH {assess} SELECT {', '.join(OUT)} FROM assessed",
        "evidence_rank": f"""WITH {assess}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {rk('disposition', ev.DISPOSITION)}, {rk('severity', ev.SEVERITY)} DESC, {rk('confidence', ev.CONFIDENCE)} DESC,
  path, coalesce(start_line, 0), tool, rule_id, message, coalesce(end_line, 0)) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM assessed)
SELECT repo_id, CAST(place AS BIGINT) AS place, finding_id, disposition, n > 20 AS truncated FROM r WHERE place <= 20""",
        "evidence_counts": f"""WITH {assess}, a AS (SELECT repo_id, count(*) AS input_findings, count(DISTINCT report_id) AS reports FROM finding GROUP BY repo_id),
b AS (SELECT repo_id, count(*) AS deduplicated_findings, count(unit_id) AS mapped_to_units, count(*) FILTER (WHERE line_scope = 'added') AS added_line,
  count(*) FILTER (WHERE disposition = 'blocking-candidate') AS blocking_candidates, count(*) FILTER (WHERE disposition = 'priority-candidate') AS priority_candidates,
  count(*) FILTER (WHERE disposition = 'note') AS notes, count(*) FILTER (WHERE disposition = 'outside-scope') AS outside_scope FROM assessed GROUP BY repo_id) SELECT * FROM a JOIN b USING (repo_id)""",
        "evidence_union": f"""WITH {assess}, u AS (SELECT 'exec-a' AS execution_id, disposition, finding_id FROM assessed UNION ALL SELECT 'exec-b', disposition, finding_id FROM assessed WHERE disposition <> 'outside-scope'),
k AS (SELECT execution_id, disposition, substr(sha256('orchestration-finding-v1' || chr(0) || execution_id || chr(0) || finding_id || chr(0)), 1, 16) AS id FROM u)
SELECT execution_id, disposition, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS least FROM k GROUP BY execution_id, disposition""",
        "report_union": "SELECT fact_id AS report_id, count(*) AS copies, count(DISTINCT concat_ws('|', text, rule_id)) > 1 AS collision FROM normalized_fact GROUP BY fact_id",
        "orchestration_status": """SELECT repo_id, CASE WHEN count(*) FILTER (WHERE status = 'completed') = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE status = 'completed') > 0 THEN 'partial' ELSE 'unavailable' END AS status,
  count(*) FILTER (WHERE status = 'completed') AS accepted_runs FROM manifest_entry GROUP BY repo_id""",
        "severity_category": f"WITH {find} SELECT DISTINCT report_id AS fact_id, severity, confidence, category FROM finding",
    }
