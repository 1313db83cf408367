"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import authorship, contamination, credentials, packing, percentiles, pii, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, d: function(*[spark.read.parquet(f"{d}/{t}.parquet") for t in tables])


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(authorship.foreign_entries, "manifest_entry", "candidate_content"),
        "p1_kinds": _over(authorship.entry_kinds, "manifest_entry", "candidate_content"),
        "p3_found": _over(percentiles.wrong_baselines, "reviewed_baseline", "baseline_run"),
        "p3_percentiles": _over(percentiles.group_percentiles, "baseline_run"),
        "p4_found": _over(splitting.oversized_hunks, "split_suggestion"),
        "p4_pieces": _over(splitting.split_pieces, "split_suggestion"),
        "p4_rebuilt": _over(lambda df: splitting.rebuilt(splitting.split_pieces(df)), "split_suggestion"),
        "p5_found": _over(credentials.found_lines, "candidate_content", "normalized_fact"),
        "p5_redacted": _over(credentials.redacted, "candidate_content", "normalized_fact"),
        "p6_packed": _over(packing.packed, "documents"),
        "p6_containers": _over(lambda docs: packing.containers(packing.packed(docs)), "documents"),
        "p6_audit": _over(lambda docs: packing.audit(docs, packing.packed(docs)), "documents"),
        "p7_found": _over(contamination.leaked, "documents", "eval_item"),
        "p7_leaks": _over(contamination.leaks, "documents", "eval_item"),
        "p8_found": _over(pii.found_items, "documents"),
        "p8_redacted": _over(pii.redacted_texts, "documents"),
    }


SAMPLES = """
runs AS (SELECT baseline_id, platform_id, samples_ms, row_number() OVER (PARTITION BY run_id ORDER BY received_at) AS k FROM baseline_run),
samples AS (SELECT baseline_id, platform_id, unnest(samples_ms) AS v FROM runs WHERE k = 1),
ranked AS (
  SELECT baseline_id, platform_id, v, row_number() OVER (PARTITION BY baseline_id, platform_id ORDER BY v) AS r,
         count(*) OVER (PARTITION BY baseline_id, platform_id) AS n
  FROM samples WHERE v >= 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
WITH {SAMPLES}
SELECT DISTINCT b.baseline_id, b.platform_id FROM reviewed_baseline b JOIN ranked q USING (baseline_id, platform_id)
WHERE q.r = (95 * q.n + 99) // 100 AND abs(b.p95_ms - q.v) * 20 > q.v""",
        "p3_percentiles": f"""
WITH {SAMPLES}
SELECT baseline_id, platform_id, p.pct AS pct, v AS value, n
FROM ranked, (VALUES ('0.5', 50), ('0.9', 90), ('0.95', 95), ('0.99', 99)) AS p(pct, k) WHERE r = (p.k * n + 99) // 100""",
        "p4_rebuilt": """
SELECT DISTINCT split_id, strlen(diff_text) AS n_bytes, md5(diff_text) AS text_md5, TRUE AS within FROM split_suggestion WHERE strlen(diff_text) > 12000""",
        "p6_audit": """
SELECT count(*) AS docs, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS broken
FROM documents WHERE text <> ''""",
        "p4_found": r"""
WITH t AS (SELECT DISTINCT split_id, diff_text FROM split_suggestion WHERE strlen(diff_text) > 12000),
l AS (SELECT split_id, unnest(string_split(diff_text, chr(10))) AS line, generate_subscripts(string_split(diff_text, chr(10)), 1) AS i FROM t),
h AS (SELECT split_id, i, regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,[0-9]+)? @@', 1) AS s FROM l)
SELECT DISTINCT split_id, CAST(row_number() OVER (PARTITION BY split_id ORDER BY i) AS INT) AS hunk_no, CAST(s AS INT) AS start_line
FROM h WHERE s <> ''""",
    }
