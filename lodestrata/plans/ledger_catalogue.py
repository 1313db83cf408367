"""Queries of budgets, normalised facts, coverage, validation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.functions.ranks import CONFIDENCE, sql_rank
from lodestrata.operators import budgets as b
from lodestrata.operators import coverage as cov
from lodestrata.operators import evaluation as ev
from lodestrata.operators import normalise as nm
from lodestrata.operators import validation as v
from lodestrata.plans import evidence_catalogue, graph_catalogue
from lodestrata.plans.relations import table


def docs(s, d):
    return table(s, d, "documents").where("text is not null and repo_id is not null").select("doc_id", "repo_id", F.octet_length("text").cast("bigint").alias("bytes"), "source")


DOCS = "docs AS (SELECT doc_id, repo_id, strlen(text) AS bytes, source FROM documents WHERE text IS NOT NULL AND repo_id IS NOT NULL)"


def entries(s, d):
    return table(s, d, "manifest_entry").select("entry_id", "repo_id", "path", "status", "presence", F.coalesce("content_bytes", F.lit(0)).cast("bigint").alias("bytes"), "observed_at")


ENTRIES = "entries AS (SELECT entry_id, repo_id, path, status, presence, CAST(coalesce(content_bytes, 0) AS BIGINT) AS bytes, observed_at FROM manifest_entry)"


def facts(s, d):
    return table(s, d, "normalized_fact").select("fact_id", "repo_id", "provider_id", "path", "kind", "rule_id", "confidence", "text", "provenance", F.to_json("source_range", {"ignoreNullFields": "false"}).alias("identity")).distinct()


def fact_edges(s, d):
    f = facts(s, d)
    kind = F.when(F.col("kind").isin("storage", "cache"), "import").when(F.col("kind") == "network", "call").when(F.col("kind") == "broker", "macro").otherwise(F.col("kind"))
    shaped = f.select(
        "provider_id", "path", kind.alias("kind"), F.col("rule_id").alias("name"), F.when(F.col("confidence") == "high", "pub").otherwise("private").alias("visibility"), F.col("fact_id").alias("identity"),
        nm.parse_quality(F.col("confidence") == "low", F.col("provenance") == "textual").alias("quality"),
    )
    return nm.fact_edges(shaped).select("edge_id", "edge_kind", "path", "from_symbol", "to_symbol", "unresolved_target", "resolution", "confidence")


def ledger(s, d):
    c = table(s, d, "manifest_entry")
    state = F.when(F.col("status") == "completed", "reviewed").when(F.col("status") == "skipped", "needs-split").when(F.col("status") == "truncated", "replaced-by-split-units").otherwise("pending")
    return c.where("presence <> 'gitlink'").select("repo_id", F.concat(F.lit("file:"), "path").alias("unit_id"), state.alias("state"), F.col("content_sha256").alias("fingerprint"), F.when(F.col("mode") == "100755", F.concat(F.lit("file:"), "path")).alias("parent_unit"))


def manifest(s, d):
    c = table(s, d, "candidate_file")
    return c.select("repo_id", F.concat(F.lit("file:"), "path").alias("unit_id"), F.when(F.col("change_status") == "M", "high").otherwise("medium").alias("risk")).distinct()


def coverage_report(s, d):
    c = table(s, d, "manifest_entry")
    u = c.select("repo_id", F.when(F.col("status") == "completed", "reviewed").otherwise("pending").alias("state"), (F.size("limitation_codes") == 0).alias("parsed"), F.when(F.col("path").contains("ledger"), "high").otherwise("medium").alias("risk"))
    return cov.coverage(u, ["repo_id"])


def status_fold(s, d):
    return cov.overall_status(entries(s, d), ["repo_id"]).join(cov.provider_status(entries(s, d), ["repo_id"]), "repo_id")


def violations(s, d):
    e = graph_catalogue.edges(s, d).withColumns({"unresolved_target": F.when(F.col("kind") == "exports", F.col("to_symbol")), "confidence": F.when(F.col("kind") == "references", "unsure").otherwise("high")})
    sy = graph_catalogue.symbols(s, d).where("kind <> 'region'")
    m, c = table(s, d, "manifest_entry"), table(s, d, "candidate_content")
    return v.all_of([
        v.edge_contract(e, sy), v.duplicates(m.select(F.concat_ws("|", "repo_id", "path").alias("k")), "k", "manifest-path-unique"), v.bad_digest(m, "content_sha256", "digest-shape", "entry_id"),
        v.both_ways(m.where("presence = 'present'"), c, ["repo_id", "path"], ("entry-without-content", "content-without-entry")),
        v.where(table(s, d, "candidate_file").select("file_id", F.explode("changed_ranges").alias("r")).select("file_id", "r.*"), "start_line > end_line", "range-order", "file_id"),
        v.where(m, "content_bytes < 0", "negative-bytes", "entry_id"),
    ])


def groups(s, d):
    runs = table(s, d, "baseline_run").dropDuplicates(["run_id"]).select("baseline_id", "platform_id", F.explode("samples_ms").alias("ms")).where("ms >= 0")
    return runs.groupBy("baseline_id", "platform_id").agg(F.max("ms").alias("observed"))


def cases(s, d):
    i = table(s, d, "eval_item")
    base = i.where("scenario <> 'trigger'").select("case_id", (F.length("prompt") > 700).alias("passed"))
    now = i.where("scenario <> 'routine'").select("case_id", (F.octet_length("prompt") > 690).alias("passed"))
    return ev.compare_cases(base, now)


def grading(s, d):
    i = table(s, d, "eval_item")
    return ev.grade(i.select("item_id", F.col("prompt").alias("response"), "expected.verdict", "expected.must_include", "expected.must_not_include")).select("item_id", "verdict_ok", "include_ok", "exclude_ok", "passed")


def cache_status(s, d):
    """Hit, miss or stale of each listed file against its contents by digest."""
    m = table(s, d, "manifest_entry").where("presence = 'present'").select("entry_id", "repo_id", "path", "content_sha256")
    c = table(s, d, "candidate_content").groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("sha256")).alias("held"))
    j = m.join(c, ["repo_id", "path"], "left")
    return j.select("entry_id", F.when(F.col("held").isNull(), "miss").when(F.array_contains("held", F.col("content_sha256")), "hit").otherwise("stale").alias("status"))


def authority(s, d):
    c = table(s, d, "candidate_file")
    rank = F.when(F.col("presence") == "present", 1).otherwise(2)
    return cov.first_available(c.select("repo_id", F.col("path").alias("input"), rank.alias("authority"), F.col("changed_ranges").isNotNull().alias("available")), ["repo_id"])


def queries():
    return {
        "running_budget": lambda s, d: b.prefix_budget(docs(s, d), ["repo_id"], ["doc_id"], "bytes", 20_000).select("doc_id", "running", "accepted"),
        "greedy_budget": lambda s, d: b.greedy_budget(docs(s, d), ["repo_id", "source"], ["doc_id"], "bytes", 5_000).select("doc_id", "accepted"),
        "high_water": lambda s, d: b.high_water(docs(s, d), ["repo_id"], "bytes", 4_000),
        "run_budget": lambda s, d: b.run_budget(docs(s, d), ["repo_id", "source"], ["doc_id"], "bytes", 6_000).select("doc_id", "state", "remaining"),
        "retention_evict": lambda s, d: b.evict(entries(s, d).select("repo_id", F.col("entry_id").alias("key"), F.col("observed_at").alias("modified"), "bytes"), ["repo_id"], 3, 9_000).select("key", "age_rank", "evicted"),
        "edge_budget_limitations": lambda s, d: b.edge_budget(graph_catalogue.edges(s, d).where("kind <> 'calls'"), ["kind", "edge_id"], 60)[1],
        "presentation_budget": lambda s, d: b.presentation_budget(docs(s, d).select("repo_id", F.length("source").alias("importance"), F.col("doc_id").alias("seq"), "bytes").fillna(99, ["importance"]), ["repo_id"], 30_000).select("seq", "kept"),
        "keep_best_dedup": lambda s, d: nm.keep_best(facts(s, d).select(ids.stable_id("best/v1", "repo_id", "kind").alias("id"), "confidence", "fact_id"), "id", ["fact_id"]),
        "first_wins_dedup": lambda s, d: nm.first_wins(facts(s, d).select(ids.stable_id("first/v1", "path", "kind").alias("id"), "rule_id", "fact_id"), "id", ["fact_id"]),
        "fact_union_keep_best": lambda s, d: nm.evidence_ids(facts(s, d), ["repo_id", "path", "kind"]),
        "fact_to_edges": fact_edges,
        "unit_summaries": lambda s, d: nm.unit_summaries(facts(s, d)),
        "coverage_report": coverage_report,
        "status_fold": status_fold,
        "ledger_reconcile": lambda s, d: cov.ledger_issues(manifest(s, d), ledger(s, d)),
        "split_consistency": lambda s, d: cov.split_issues(ledger(s, d)),
        "coverage_gap": lambda s, d: cov.coverage_gap(manifest(s, d), ledger(s, d)),
        "verdict_fold": lambda s, d: cov.verdicts(evidence_catalogue.assessed(s, d), cov.coverage_gap(manifest(s, d), ledger(s, d))),
        "scope_overlap": lambda s, d: table(s, d, "candidate_file").select("repo_id", "path").intersect(table(s, d, "normalized_fact").select("repo_id", "path")),
        "first_authority": authority,
        "contract_violations": violations,
        "p95_nearest_rank": lambda s, d: ev.nearest_rank(table(s, d, "events"), ["event_type"], "value", (50, 95, 99)),
        "p95_gate": lambda s, d: ev.gate(groups(s, d), table(s, d, "reviewed_baseline").select("baseline_id", "platform_id", "p95_ms"), ["baseline_id", "platform_id"]),
        "case_compare": lambda s, d: cases(s, d),
        "case_report": lambda s, d: ev.case_report(cases(s, d)),
        "term_recall": lambda s, d: table(s, d, "eval_item").select("item_id", "prompt", F.array(F.lit("the"), F.col("locale")).alias("terms")).select("item_id", ev.term_recall(None, "prompt").alias("met")),
        "response_grading": grading,
        "cache_lookup_status": cache_status,
    }


def oracle_sql():
    q = lambda order: sql_rank("confidence", CONFIDENCE)
    fact = "fact AS (SELECT DISTINCT fact_id, repo_id, provider_id, path, kind, rule_id, confidence, provenance FROM normalized_fact)"
    led = """ledger AS (SELECT repo_id, 'file:' || path AS unit_id, CASE status WHEN 'completed' THEN 'reviewed' WHEN 'skipped' THEN 'needs-split' WHEN 'truncated' THEN 'replaced-by-split-units' ELSE 'pending' END AS state,
  content_sha256 AS fingerprint, CASE WHEN mode = '100755' THEN 'file:' || path END AS parent_unit FROM manifest_entry WHERE presence <> 'gitlink')"""
    man = "manifest AS (SELECT DISTINCT repo_id, 'file:' || path AS unit_id, CASE WHEN change_status = 'M' THEN 'high' ELSE 'medium' END AS risk FROM candidate_file)"
    gap = f"""{man}, {led}, rev AS (SELECT DISTINCT repo_id, unit_id FROM ledger WHERE state = 'reviewed'),
open AS (SELECT m.* FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM rev r WHERE r.repo_id = m.repo_id AND r.unit_id = m.unit_id)),
gap AS (SELECT m.repo_id, (SELECT count(*) FROM open o WHERE o.repo_id = m.repo_id) AS gap_units, (SELECT count(*) FROM open o WHERE o.repo_id = m.repo_id AND risk = 'high') AS material_units FROM (SELECT DISTINCT repo_id FROM manifest) m),
gaps AS (SELECT *, CASE WHEN gap_units = 0 THEN 'empty' WHEN material_units = 0 THEN 'non-material' ELSE 'material' END AS gap FROM gap)"""
    compare = """b AS (SELECT case_id, length(prompt) > 700 AS was FROM eval_item WHERE scenario <> 'trigger'), c AS (SELECT case_id, strlen(prompt) > 690 AS now FROM eval_item WHERE scenario <> 'routine'),
k AS (SELECT case_id, was, now, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'regressed' WHEN NOT was AND now THEN 'fixed' ELSE 'same' END AS change FROM b FULL JOIN c USING (case_id))"""
    assess = evidence_catalogue.oracle_sql()["disposition"].rsplit("SELECT", 1)[0].strip()
    edge_sql, sym_sql = graph_catalogue.oracle_sql()["edge_endpoint_filter"].split("WITH ", 1)[1].split(", sym AS (", 1)[0], "sym AS (" + graph_catalogue.oracle_sql()["edge_endpoint_filter"].split("sym AS (", 1)[1].split(", s AS (", 1)[0]
    from lodestrata.operators.facts import SUMMARY_OF_KIND

    kinds = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in SUMMARY_OF_KIND.items())
    return {
        "running_budget": f"WITH {DOCS}, r AS (SELECT doc_id, repo_id, CAST(sum(bytes) OVER (PARTITION BY repo_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM docs) SELECT doc_id, running, running <= 20000 AS accepted FROM r",
        "greedy_budget": f"""WITH RECURSIVE {DOCS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, source ORDER BY doc_id) AS k FROM docs),
f AS (SELECT doc_id, repo_id, source, k, CASE WHEN bytes <= 5000 THEN bytes ELSE 0 END AS used, bytes <= 5000 AS accepted FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.repo_id, n.source, n.k, f.used + CASE WHEN f.used + n.bytes <= 5000 THEN n.bytes ELSE 0 END, f.used + n.bytes <= 5000 FROM f JOIN n ON n.repo_id = f.repo_id AND n.source IS NOT DISTINCT FROM f.source AND n.k = f.k + 1)
SELECT doc_id, accepted FROM f""",
        "high_water": f"WITH {DOCS} SELECT repo_id, max(least(bytes, 4000)) AS high_water, bool_or(bytes > 4000) AS exceeded FROM docs GROUP BY repo_id",
        "run_budget": f"""WITH {DOCS}, r AS (SELECT doc_id, bytes, sum(bytes) OVER (PARTITION BY repo_id, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs)
SELECT doc_id, CASE WHEN upto - bytes < 6000 THEN 'executed' ELSE 'not-run' END AS state, CAST(greatest(6000 - upto, 0) AS BIGINT) AS remaining FROM r""",
        "retention_evict": f"""WITH {ENTRIES}, r AS (SELECT entry_id AS key, CAST(row_number() OVER w AS INT) AS age_rank, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS newer FROM entries WINDOW w AS (PARTITION BY repo_id ORDER BY observed_at DESC, entry_id))
SELECT key, CAST(age_rank AS BIGINT) AS age_rank, age_rank > 3 AND newer > 9000 AS evicted FROM r""",
        "edge_budget_limitations": f"WITH {edge_sql}, k AS (SELECT *, row_number() OVER (ORDER BY kind, edge_id) AS n FROM edge WHERE kind <> 'calls') SELECT 'edge-budget-exhausted' AS code, path, kind, count(*) AS lost FROM k WHERE n > 60 GROUP BY path, kind",
        "presentation_budget": f"WITH {DOCS}, r AS (SELECT doc_id AS seq, sum(bytes) OVER (PARTITION BY repo_id ORDER BY coalesce(length(source), 99), doc_id ROWS UNBOUNDED PRECEDING) AS t FROM docs) SELECT seq, t <= 30000 AS kept FROM r",
        "keep_best_dedup": f"WITH {fact}, k AS (SELECT substr(sha256('best/v1' || chr(0) || repo_id || chr(0) || kind || chr(0)), 1, 16) AS id, confidence, fact_id FROM fact) SELECT id, arg_min(confidence, (-({q(0)}), fact_id)) AS confidence, arg_min(fact_id, (-({q(0)}), fact_id)) AS fact_id FROM k GROUP BY id",
        "first_wins_dedup": f"WITH {fact}, k AS (SELECT substr(sha256('first/v1' || chr(0) || path || chr(0) || kind || chr(0)), 1, 16) AS id, rule_id, fact_id FROM fact) SELECT id, arg_min(rule_id, fact_id) AS rule_id, min(fact_id) AS fact_id FROM k GROUP BY id",
        "fact_union_keep_best": "SELECT repo_id, path, kind, list_sort(list(DISTINCT fact_id)) AS evidence_fact_ids FROM normalized_fact GROUP BY repo_id, path, kind",
        "fact_to_edges": f"""WITH {fact},
s AS (SELECT provider_id, path, CASE WHEN kind IN ('storage', 'cache') THEN 'import' WHEN kind = 'network' THEN 'call' WHEN kind = 'broker' THEN 'macro' ELSE kind END AS kind, rule_id AS name, confidence = 'high' AS pub, fact_id AS identity,
  CASE WHEN confidence IS DISTINCT FROM 'low' THEN 'medium' ELSE 'low' END AS confidence FROM fact),
y AS (SELECT *, substr(sha256('impact-symbol/v1' || chr(0) || provider_id || chr(0) || path || chr(0) || kind || chr(0) || identity || chr(0) || chr(0) || name || chr(0)), 1, 16) AS sym FROM s),
e AS (SELECT *, 'defines' AS edge_kind, sym AS to_symbol, NULL AS unresolved_target, 'syntactic' AS resolution FROM y WHERE kind NOT IN ('import', 'call', 'macro')
  UNION ALL SELECT *, 'exports', sym, NULL, 'syntactic' FROM y WHERE kind NOT IN ('import', 'call', 'macro') AND pub
  UNION ALL SELECT *, 'imports', NULL, name, 'syntactic' FROM y WHERE kind = 'import' UNION ALL SELECT *, 'calls', NULL, name, CASE WHEN kind = 'macro' THEN 'unresolved' ELSE 'syntactic' END FROM y WHERE kind IN ('call', 'macro'))
SELECT DISTINCT substr(sha256('impact-edge/v1' || chr(0) || provider_id || chr(0) || path || chr(0) || edge_kind || chr(0) || identity || chr(0) || 'file:' || path || chr(0) || coalesce(to_symbol, unresolved_target) || chr(0) || resolution || chr(0)), 1, 16) AS edge_id,
  edge_kind, path, 'file:' || path AS from_symbol, to_symbol, unresolved_target, resolution, confidence FROM e""",
        "unit_summaries": f"""WITH {fact}, s AS (SELECT *, CASE kind {kinds} END AS summary_kind FROM fact)
SELECT substr(sha256('impact-summary/v1' || chr(0) || summary_kind || chr(0) || path || chr(0) || chr(0) || rule_id || chr(0) || fact_id || chr(0)), 1, 16) AS summary_id, summary_kind, path, confidence,
  summary_kind || ' in ' || path || ' by rule ' || rule_id AS message, fact_id FROM s WHERE summary_kind IS NOT NULL""",
        "coverage_report": """WITH u AS (SELECT repo_id, status = 'completed' AS done, len(limitation_codes) = 0 AS parsed, contains(path, 'ledger') AS high FROM manifest_entry)
SELECT repo_id, count(*) AS units, count(*) FILTER (WHERE done) AS reviewed, count(*) FILTER (WHERE NOT done) AS pending, count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE high AND NOT done) AS high_risk_open FROM u GROUP BY repo_id""",
        "status_fold": """SELECT repo_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'completed') THEN 'partial' ELSE 'unavailable' END AS status,
  CASE min(CASE WHEN status = 'completed' THEN 2 WHEN status IN ('partial', 'truncated') THEN 1 ELSE 0 END) WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unavailable' END AS completeness,
  CASE WHEN bool_or(status = 'budget-exhausted') THEN 'budget-exhausted' WHEN bool_or(status = 'partial') THEN 'partial' WHEN bool_or(status = 'completed') THEN 'completed' ELSE 'unsupported' END AS provider_status FROM manifest_entry GROUP BY repo_id""",
        "ledger_reconcile": f"""WITH {man}, {led}, per AS (SELECT repo_id, unit_id, count(DISTINCT state) AS s, count(DISTINCT fingerprint) AS f FROM ledger GROUP BY repo_id, unit_id), m AS (SELECT DISTINCT repo_id, unit_id FROM manifest)
SELECT repo_id, unit_id, 'missing-from-ledger' AS issue FROM m ANTI JOIN per USING (repo_id, unit_id) UNION ALL SELECT repo_id, unit_id, 'not-in-manifest' FROM per ANTI JOIN m USING (repo_id, unit_id)
UNION ALL SELECT repo_id, unit_id, 'several-states' FROM per WHERE s > 1 UNION ALL SELECT repo_id, unit_id, 'mixed-fingerprints' FROM per WHERE f > 1""",
        "split_consistency": f"""WITH {led}, c AS (SELECT DISTINCT repo_id, parent_unit AS unit_id FROM ledger WHERE parent_unit IS NOT NULL), r AS (SELECT DISTINCT repo_id, unit_id FROM ledger WHERE state = 'reviewed')
SELECT DISTINCT repo_id, unit_id, 'split-without-children' AS issue FROM ledger ANTI JOIN c USING (repo_id, unit_id) WHERE state = 'needs-split'
UNION ALL SELECT DISTINCT repo_id, unit_id, 'replaced-and-reviewed' FROM ledger SEMI JOIN r USING (repo_id, unit_id) WHERE state = 'replaced-by-split-units'""",
        "coverage_gap": f"WITH {gap} SELECT * FROM gaps",
        "verdict_fold": f"""{assess}, {gap}, p AS (SELECT repo_id, bool_or(disposition = 'blocking-candidate') AS blocked, bool_or(disposition IN ('note', 'priority-candidate')) AS noted FROM assessed GROUP BY repo_id)
SELECT repo_id, gap, CASE WHEN coalesce(blocked, false) OR gap = 'material' THEN 'DO_NOT_COMMIT' WHEN coalesce(noted, false) OR gap = 'non-material' THEN 'WITH_NOTES' ELSE 'SAFE' END AS verdict FROM gaps LEFT JOIN p USING (repo_id)""",
        "scope_overlap": "SELECT repo_id, path FROM candidate_file INTERSECT SELECT repo_id, path FROM normalized_fact",
        "first_authority": "SELECT repo_id, arg_min(path, (CASE WHEN presence = 'present' THEN 1 ELSE 2 END, path)) AS input FROM candidate_file WHERE changed_ranges IS NOT NULL GROUP BY repo_id",
        "contract_violations": f"""WITH {edge_sql}, {sym_sql}, y AS (SELECT symbol FROM sym WHERE kind <> 'region'), p AS (SELECT DISTINCT repo_id, path FROM manifest_entry WHERE presence = 'present'), c AS (SELECT DISTINCT repo_id, path FROM candidate_content)
SELECT 'edge-target-known' AS rule, to_symbol AS ref FROM (SELECT DISTINCT to_symbol FROM edge) WHERE to_symbol NOT IN (SELECT symbol FROM y) UNION ALL SELECT 'edge-target-xor', edge_id FROM edge WHERE kind = 'exports'
UNION ALL SELECT 'edge-confidence', edge_id FROM edge WHERE kind = 'references' UNION ALL SELECT 'manifest-path-unique', concat_ws('|', repo_id, path) FROM manifest_entry GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'digest-shape', CAST(entry_id AS VARCHAR) FROM manifest_entry WHERE NOT regexp_matches(content_sha256, '^[0-9a-f]{{64}}$')
UNION ALL SELECT 'entry-without-content', repo_id || '|' || path FROM p ANTI JOIN c USING (repo_id, path) UNION ALL SELECT 'content-without-entry', repo_id || '|' || path FROM c ANTI JOIN p USING (repo_id, path)
UNION ALL SELECT 'range-order', CAST(file_id AS VARCHAR) FROM (SELECT file_id, unnest(changed_ranges) AS r FROM candidate_file) WHERE r.start_line > r.end_line UNION ALL SELECT 'negative-bytes', CAST(entry_id AS VARCHAR) FROM manifest_entry WHERE content_bytes < 0""",
        "p95_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY event_type",
        "p95_gate": """WITH r AS (SELECT DISTINCT ON (run_id) baseline_id, platform_id, samples_ms FROM baseline_run), g AS (SELECT baseline_id, platform_id, max(ms) AS observed FROM (SELECT baseline_id, platform_id, unnest(samples_ms) AS ms FROM r) WHERE ms >= 0 GROUP BY ALL)
SELECT baseline_id, platform_id, observed, (p95_ms * 5 + 3) // 4 + 250 AS "limit", observed <= (p95_ms * 5 + 3) // 4 + 250 AS passed FROM g JOIN reviewed_baseline USING (baseline_id, platform_id)""",
        "case_compare": f"WITH {compare} SELECT * FROM k",
        "case_report": f"WITH {compare} SELECT change, count(*) AS cases, list_sort(list(case_id)) AS case_ids FROM k GROUP BY change",
        "term_recall": "SELECT item_id, contains(lower(prompt), 'the') AND contains(lower(prompt), lower(locale)) AS met FROM eval_item",
        "response_grading": """WITH g AS (SELECT item_id, coalesce(contains(lower(prompt), lower(expected.verdict)), true) AS verdict_ok, len(list_filter(coalesce(expected.must_include, []), lambda t: NOT contains(lower(prompt), lower(t)))) = 0 AS include_ok,
  len(list_filter(coalesce(expected.must_not_include, []), lambda t: contains(lower(prompt), lower(t)))) = 0 AS exclude_ok FROM eval_item) SELECT *, verdict_ok AND include_ok AND exclude_ok AS passed FROM g""",
        "cache_lookup_status": """WITH c AS (SELECT repo_id, path, list(DISTINCT sha256) AS held FROM candidate_content GROUP BY repo_id, path)
SELECT entry_id, CASE WHEN held IS NULL THEN 'miss' WHEN list_contains(held, content_sha256) THEN 'hit' ELSE 'stale' END AS status FROM manifest_entry LEFT JOIN c USING (repo_id, path) WHERE presence = 'present'""",
    }
