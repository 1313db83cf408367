"""Queries that run the readers over outputs and reports made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.lineage import shared_dir
from lodestrata.operators import syntax
from lodestrata.plans import fact_catalogue, graph_catalogue
from lodestrata.plans.relations import table
from lodestrata.sources import configuration, generations, reports, version_control

CHUNK = 200  # entries of one made-up output


def _outputs(s, d, entry):
    """NUL-separated outputs of the changed files, each with a tail that is cut off."""
    c = table(s, d, "candidate_file").where("path is not null").select("file_id", "path", F.when(F.coalesce(F.col("change_status").rlike("^[RC]"), F.lit(True)), "M").otherwise(F.col("change_status")).alias("status"))
    each = c.select(F.floor(F.col("file_id") / CHUNK).cast("string").alias("source"), F.struct("file_id", entry.alias("entry")).alias("e"))
    return each.groupBy("source").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["entry"]), ""), F.lit("R100\0cut")).alias("raw"))


def _entry_status():
    renamed = F.col("file_id") % 5 == 0
    return F.when(renamed, F.concat(F.lit("R090\0old/"), "path", F.lit("\0"), "path", F.lit("\0"))).otherwise(F.concat("status", F.lit("\0"), "path", F.lit("\0")))


def name_status(s, d):
    rows = version_control.name_status_decoded(_outputs(s, d, _entry_status()))
    return rows.groupBy("status", "path", "old_path", "rejected").agg(F.count("*").alias("n"))


def _entry_counts():
    head = F.concat((F.col("file_id") % 7).cast("string"), F.lit("\t"), F.when(F.col("file_id") % 3 == 0, "-").otherwise(F.col("file_id").cast("string")), F.lit("\t"))
    return F.when(F.col("file_id") % 5 == 0, F.concat(head, F.lit("\0old/"), "path", F.lit("\0"), "path", F.lit("\0"))).otherwise(F.concat(head, "path", F.lit("\0")))


def numstat(s, d):
    rows = version_control.numstat_decoded(_outputs(s, d, _entry_counts()))
    return rows.groupBy("add", "del", "path", "old_path", "rejected").agg(F.count("*").alias("n"))


def tree_listing(s, d):
    m = table(s, d, "manifest_entry").where("path is not null and content_sha256 is not null")
    tree = F.concat_ws(" ", F.coalesce("mode", F.lit("100644")), F.lit("blob"), "content_sha256")
    index = F.concat_ws(" ", F.coalesce("mode", F.lit("100644")), "content_sha256", (F.col("entry_id") % 4).cast("string"))
    raw = m.select(F.concat(F.when(F.col("entry_id") % 2 == 0, tree).otherwise(index), F.lit("\t"), "path").alias("value"))
    return version_control.tree_listing(raw).groupBy("mode", "kind", "object_id", "path", "stage", "unmerged").agg(F.count("*").alias("n"))


def hint_rules(s, d):
    f = table(s, d, "normalized_fact").select("fact_id", F.concat_ws("\t", "fact_id", "path", "kind", "provider_id", "rule_id", "confidence", "text").alias("value")).distinct()
    return configuration.test_hints(f.withColumn("ord", F.lit(0)), "value").drop("ord")


def _fixed(s, d):
    f = table(s, d, "normalized_fact").select("fact_id", "provider_id", "repo_id", "rule_id", "path", "text", "confidence", "kind", F.col("source_range.start_line").alias("start_line")).distinct()
    one = F.struct("rule_id", F.col("text").alias("message"), "path", "start_line", F.when(F.col("kind") == "storage", "error").otherwise("note").alias("severity"), "confidence")
    g = f.groupBy("provider_id", "repo_id", "path").agg(F.collect_list(one).alias("findings"))
    status = F.when(F.col("provider_id").endswith("x"), "failed").otherwise("completed")
    return g.select(F.concat_ws("@", "provider_id", "repo_id", "path").alias("report_id"), F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.lit("static-findings").alias("kind"), F.struct(F.col("provider_id").alias("name")).alias("tool"), status.alias("status"), "findings",
    )).alias("payload"))


def fixed_findings(s, d):
    both, told = reports.read_reports(_fixed(s, d))
    return both.groupBy("tool", "rule_id", "start_line", "severity", "completed").agg(F.count("*").alias("n"))


def sarif_rules(s, d):
    """Reports whose results have their level from rules, by id or by index."""
    f = table(s, d, "normalized_fact").select("fact_id", "provider_id", "repo_id", "rule_id", "path", "kind").distinct()
    result = F.struct(F.when(F.col("kind") != "storage", F.col("rule_id")).alias("ruleId"), F.when(F.col("kind") == "storage", 0).alias("ruleIndex"), F.struct(F.lit("m").alias("text")).alias("message"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.when(F.length("rule_id") % 2 == 0, "error").otherwise("note").alias("level")).alias("defaultConfiguration"))
    g = f.groupBy("provider_id", "repo_id", "path").agg(F.collect_list(result).alias("results"), F.array_sort(F.collect_set(rule)).alias("rules"))
    first = F.array(F.struct(F.lit("first").alias("id"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration")))
    run = F.struct(F.struct(F.struct(F.col("provider_id").alias("name"), F.concat(first, "rules").alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    made = g.select(F.concat_ws("@", "provider_id", "repo_id", "path").alias("report_id"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("payload"))
    return reports.sarif(made).groupBy("tool", "severity").agg(F.count("*").alias("n"))


def reconcile(s, d):
    key = generations.generation_key(1, [d, s.sparkContext.applicationId, "reconcile"])
    root = f"{shared_dir(s)}/generations"
    generations.publish({"edges": graph_catalogue.edges(s, d), "symbols": graph_catalogue.symbols(s, d)}, root, key)
    return generations.reconcile(s, root, key)


def located(s, d):
    c = table(s, d, "reviewed_baseline").select(F.concat_ws("/", "baseline_id", "platform_id").alias("generation_key"), F.col("sample_count").alias("completeness"))
    return generations.locate(c, "absent")


def queries():
    return {
        "name_status_read": name_status, "numstat_read": numstat, "tree_listing_read": tree_listing, "hint_rules_read": hint_rules, "fixed_findings_read": fixed_findings, "sarif_rules_read": sarif_rules,
        "generation_reconcile": reconcile, "generation_locate": located, "rust_imports": lambda s, d: syntax.imports(fact_catalogue.texts(s, d)),
    }


def oracle_sql():
    files = "f AS (SELECT file_id, path, CASE WHEN coalesce(regexp_matches(change_status, '^[RC]'), true) THEN 'M' ELSE change_status END AS status FROM candidate_file WHERE path IS NOT NULL)"
    tails = f"(SELECT count(DISTINCT file_id // {CHUNK}) AS n FROM f)"
    edge = graph_catalogue.oracle_sql()["adjacency_out"].split("WITH ", 1)[1].rsplit("SELECT", 1)[0].strip()
    sym = "sym AS (" + graph_catalogue.oracle_sql()["edge_endpoint_filter"].split("sym AS (", 1)[1].split(", s AS (", 1)[0]
    return {
        "name_status_read": f"""WITH {files} SELECT CASE WHEN file_id % 5 = 0 THEN 'R090' ELSE status END AS status, path, CASE WHEN file_id % 5 = 0 THEN 'old/' || path END AS old_path, CAST(NULL AS VARCHAR) AS rejected, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, 'R100' || chr(0) || 'cut', n FROM {tails}""",
        "numstat_read": f"""WITH {files} SELECT CAST(file_id % 7 AS VARCHAR) AS add, CASE WHEN file_id % 3 = 0 THEN '-' ELSE CAST(file_id AS VARCHAR) END AS del, path, CASE WHEN file_id % 5 = 0 THEN 'old/' || path END AS old_path, CAST(NULL AS VARCHAR) AS rejected, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, 'R100' || chr(0) || 'cut', n FROM {tails}""",
        "tree_listing_read": """SELECT coalesce(mode, '100644') AS mode, 'blob' AS kind, content_sha256 AS object_id, path, CAST(CASE WHEN entry_id % 2 = 0 THEN 0 ELSE entry_id % 4 END AS INT) AS stage,
  entry_id % 2 <> 0 AND entry_id % 4 > 0 AS unmerged, count(*) AS n FROM manifest_entry WHERE path IS NOT NULL AND content_sha256 IS NOT NULL GROUP BY ALL""",
        "hint_rules_read": """SELECT DISTINCT trim(fact_id) AS rule_id, trim(path) AS path_regex, trim(kind) AS content_regex, trim(provider_id) AS test_kind, trim(rule_id) AS environment_dependency, trim(confidence) AS confidence, trim(text) AS hint
FROM normalized_fact WHERE fact_id IS NOT NULL AND path IS NOT NULL AND kind IS NOT NULL AND provider_id IS NOT NULL AND rule_id IS NOT NULL AND confidence IS NOT NULL AND text IS NOT NULL AND NOT starts_with(ltrim(fact_id), '#')""",
        "fixed_findings_read": """WITH f AS (SELECT DISTINCT fact_id, provider_id, repo_id, rule_id, path, text, confidence, kind, source_range.start_line AS start_line FROM normalized_fact)
SELECT provider_id AS tool, rule_id, start_line, CASE WHEN kind = 'storage' THEN 'error' ELSE 'note' END AS severity, NOT ends_with(provider_id, 'x') AS completed, count(*) AS n FROM f GROUP BY ALL""",
        "sarif_rules_read": """WITH f AS (SELECT DISTINCT fact_id, provider_id, repo_id, rule_id, path, kind FROM normalized_fact)
SELECT provider_id AS tool, CASE WHEN kind = 'storage' THEN 'warning' WHEN length(rule_id) % 2 = 0 THEN 'error' ELSE 'note' END AS severity, count(*) AS n FROM f GROUP BY ALL""",
        "generation_reconcile": f"""WITH {edge}, {sym} SELECT 'edges' AS "table", count(*) AS rows, count(*) AS found, TRUE AS matches FROM edge UNION ALL SELECT 'symbols', count(*), count(*), TRUE FROM sym""",
        "generation_locate": "SELECT concat_ws('/', baseline_id, platform_id) AS generation_key, sample_count AS completeness FROM reviewed_baseline ORDER BY sample_count DESC NULLS LAST, generation_key LIMIT 1",
    }
