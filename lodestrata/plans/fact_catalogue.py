"""Queries of text facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.operators import facts
from lodestrata.plans.relations import table

LINE_RULES = [("release-note", r"(?i)(release|rollback)"), ("limit", r"[0-9]+ (ms|rows|attempts)"), ("version", r"v[0-9]+[.][0-9]+[.][0-9]+")]
HINTS = [("tests-first", r"^tests/", ""), ("planner", r"planner", ""), ("await", "", r"\bawait\b"), ("limit", r"[.]ya?ml$", r"\blimit\b")]
REDACTIONS = [("ip", r"[0-9]{1,3}([.][0-9]{1,3}){3}"), ("hex", r"[0-9a-f]{32,64}"), ("mail", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+")]
GREP = [("todo", r"(?i)(todo|fixme)"), ("queue", r"(^|[^A-Za-z0-9_])queue([^A-Za-z0-9_]|$)"), ("absent", r"zzz-no-such-word")]


def texts(s, d):
    """Files with UTF-8 text; repeated rows count once."""
    c = table(s, d, "candidate_content").where("not coalesce(is_binary, false)")
    valid = F.try_validate_utf8(F.col("bytes").cast("string"))
    return c.select("file_id", "path", valid.alias("text")).where("text is not null").dropDuplicates(["file_id", "path", "text"])


FILES = "file AS (SELECT DISTINCT file_id, path, TRY(decode(bytes)) AS text FROM candidate_content WHERE NOT coalesce(is_binary, false) AND TRY(decode(bytes)) IS NOT NULL)"


def documents(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", "text")


def fact_functions(s, d):
    f = table(s, d, "normalized_fact").select("fact_id", "path", "text", "rule_id", "kind", "provider_id", "provenance", "source_range").distinct()
    identity = ids.range_identity(*[f"source_range.{c}" for c in ("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")])
    return f.select(
        "fact_id", text.clean_text("text", "(none)", 60).alias("clean"), text.bounded_text("text", 40).alias("bounded"), text.tsv_field("text").alias("tsv"),
        ids.stable_id("impact-fact/v1", "provider_id", "path", "kind", identity, "rule_id", "provenance").alias("stable"),
    ).distinct()


def normalize_paths(s, d):
    m = table(s, d, "manifest_entry")
    return m.select("entry_id", text.normalize_path(F.concat(F.lit("file://./"), F.replace("path", F.lit("_"), F.lit("%5F")))).alias("normal"))


def redaction(s, d):
    r = text.redact("text", REDACTIONS)
    return documents(s, d).select("doc_id", F.sha2(r, 256).alias("digest"), (F.length(r) - F.length("text")).alias("growth"), F.substring(r, 1, 80).alias("head"))


def git_path_quoting(s, d):
    paths = table(s, d, "manifest_entry").select(F.lit("manifest_entry").alias("origin"), F.col("entry_id").alias("row_key"), F.col("path").alias("plain"))
    both = paths.unionByName(documents(s, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_key"), F.col("text").alias("plain")))
    return both.select("origin", "row_key", text.quote_git_path("plain").alias("quoted")).withColumn("back", text.unquote_git_path("quoted"))


def queries():
    return {
        "key_value_facts": lambda s, d: facts.key_values(texts(s, d)),
        "earliest_marker": lambda s, d: facts.earliest_markers(documents(s, d), "doc_id", "text"),
        "line_facts": lambda s, d: facts.line_matches(documents(s, d), "doc_id", "text", LINE_RULES),
        "first_match_hint": lambda s, d: facts.first_hints(texts(s, d), "file_id", HINTS),
        "test_classifier": lambda s, d: texts(s, d).select("file_id", facts.test_class("path", "text").alias("test_class"), facts.is_test_path("path").alias("test_like")),
        "grep_queries": lambda s, d: facts.grep(documents(s, d), "doc_id", "text", GREP, 50),
        "fact_functions": fact_functions,
        "normalize_paths": normalize_paths,
        "redaction": redaction,
        "utf8_truncate": lambda s, d: documents(s, d).select("doc_id", text.utf8_truncate(200)("text").alias("cut")),
        "git_path_quoting": git_path_quoting,
    }


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle_sql():
    most = "list_max(list_filter(range(0, 201), lambda i: strlen(substr(text, 1, CAST(i AS INT))) <= 200))"
    place = lambda n: f"instr(lower(text), '{_sql(n)}')"
    marker_rows = " UNION ALL ".join(
        f"SELECT doc_id, text, '{kind}' AS kind, {i} AS i, '{_sql(n)}' AS marker, {place(n)} AS pos FROM documents WHERE {place(n)} > 0" for kind, needles in facts.MARKERS.items() for i, n in enumerate(needles)
    )
    has = lambda column, needles: " OR ".join(f"contains({column}, '{_sql(n)}')" for n in needles) or "false"
    classes = ""
    for name, needles in facts.CONTENT_CLASSES:
        by = f"({has('text' if name in facts.EXACT_CASE else 'lower(text)', needles)})"
        on = f"regexp_matches(lower(path), '{_sql(facts.PATH_OF_CLASS[name])}')" if name in facts.PATH_OF_CLASS else "false"
        classes += f" WHEN {by} {'AND' if name == 'node-e2e-or-integration' else 'OR'} {on} THEN '{name}'"
    rule = "CASE WHEN lower(path) LIKE '%.toml' THEN 'toml-key' WHEN regexp_matches(lower(path), '[.]ya?ml$') THEN 'yaml-key' WHEN lower(path) LIKE '%dockerfile' OR lower(path) LIKE '%dockerfile.%' THEN 'docker-instruction' WHEN lower(path) LIKE '%.sql' THEN 'sql-statement' END"
    keyed = " UNION ALL ".join(
        f"SELECT file_id, '{name}' AS rule, unnest(regexp_extract_all(text, '{_sql(p)}', 1)) AS k, unnest(regexp_extract_all(text, '{_sql(p)}', 0)) AS w, generate_subscripts(regexp_extract_all(text, '{_sql(p)}', 0), 1) AS ordinal FROM ruled WHERE rule = '{name}'"
        for name, p in facts.KEY_PATTERNS.items()
    )
    bounded = lambda e, n: f"regexp_replace(substr(regexp_replace({e}, '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), 1, {n}), '^\\s+|\\s+$', '', 'g')"
    line_rows = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, i AS line, regexp_extract(l, '{_sql(p)}', 0) AS m FROM ln WHERE regexp_matches(l, '{_sql(p)}')" for r, p in LINE_RULES)
    hint = " ".join(
        f"WHEN {' OR '.join([f'regexp_matches(path, {chr(39)}{_sql(p)}{chr(39)})'] * bool(p) + [f'regexp_matches(text, {chr(39)}{_sql(c)}{chr(39)})'] * bool(c))} THEN '{n}'" for n, p, c in HINTS
    )
    redacted = "text"
    for name, pattern in REDACTIONS:
        redacted = f"regexp_replace({redacted}, '{_sql(pattern)}', '[redacted:{name}]', 'g')"
    grep_rows = " UNION ALL ".join(f"SELECT '{q}' AS query_id, doc_id, count(*) AS n FROM ln WHERE regexp_matches(l, '{_sql(p)}') GROUP BY doc_id" for q, p in GREP)
    ln = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"
    identity = "concat_ws(':', " + ", ".join(f"coalesce(CAST(source_range.{c} AS VARCHAR), '')" for c in ("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")) + ")"
    z = "chr(0)"
    return {
        "key_value_facts": f"WITH {FILES}, ruled AS (SELECT *, {rule} AS rule FROM file), m AS ({keyed}) SELECT file_id, CAST(ordinal AS INT) AS ordinal, rule || ':' || lower(k) AS rule_id, {bounded('w', 1000)} AS match_text FROM m",
        "earliest_marker": f"""WITH m AS ({marker_rows}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos, i) AS k FROM m)
SELECT doc_id, kind, marker, CAST(length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 AS INT) AS line,
  CAST(length(string_split(substr(text, 1, pos - 1), chr(10))[-1]) + 1 AS INT) AS "column" FROM b WHERE k = 1""",
        "line_facts": f"""WITH {ln}, m AS ({line_rows}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line) AS n, count(*) OVER (PARTITION BY doc_id, rule_id) AS a FROM m)
SELECT doc_id, rule_id, CAST(line AS INT) AS line, {bounded('m', 1000)} AS match_text, a > 20 AS overflow FROM r WHERE n <= 20""",
        "first_match_hint": f"WITH {FILES}, h AS (SELECT file_id, CASE {hint} END AS rule_id FROM file) SELECT * FROM h WHERE rule_id IS NOT NULL",
        "test_classifier": f"WITH {FILES} SELECT file_id, CASE {classes} ELSE '{facts.NO_CLASS}' END AS test_class, regexp_matches(lower(path), '{_sql(facts.TEST_PATH)}') AS test_like FROM file",
        "grep_queries": f"""WITH {ln}, m AS ({grep_rows}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS k FROM m)
SELECT q.query_id, r.doc_id, r.n FROM (VALUES {', '.join(f"('{q}')" for q, _ in GREP)}) AS q(query_id) LEFT JOIN (SELECT * FROM r WHERE k <= 50) r USING (query_id)""",
        "utf8_truncate": f"SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text WHEN text IS NOT NULL THEN substr(text, 1, CAST({most} AS INT)) || chr(10) || '[truncated]' || chr(10) END AS cut FROM documents",
        "fact_functions": f"""SELECT DISTINCT fact_id, substr(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN '(none)' ELSE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) END, 1, 60) AS clean,
  {bounded('text', 40)} AS bounded, translate(coalesce(text, ''), chr(9) || chr(13) || chr(10), '   ') AS tsv,
  substr(sha256('impact-fact/v1' || {z} || provider_id || {z} || path || {z} || kind || {z} || {identity} || {z} || rule_id || {z} || provenance || {z}), 1, 16) AS stable FROM normalized_fact""",
        "normalize_paths": "SELECT entry_id, regexp_replace(regexp_replace(url_decode(replace('file://./' || replace(path, '_', '%5F'), '+', '%2B')), '^file://', ''), '^([.]/)+', '') AS normal FROM manifest_entry",
        "redaction": f"WITH r AS (SELECT doc_id, text, {redacted} AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(r) AS digest, CAST(length(r) - length(text) AS INT) AS growth, substr(r, 1, 80) AS head FROM r",
    }
