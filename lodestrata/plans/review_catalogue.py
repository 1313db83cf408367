"""Queries that put several operators together: ledgers, refreshed overlays, seeds, recall and stored forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import budgets, evaluation, graph, syntax, validation
from lodestrata.operators import evidence as ev
from lodestrata.plans import evidence_catalogue, graph_catalogue, ledger_catalogue
from lodestrata.plans import relations as R
from lodestrata.plans.relations import table


def coverage_ledger(s, d):
    """Each unit's first state: to be split if its group is, else pending."""
    from lodestrata.operators import change_plan as cp

    u = R.units(s, d)
    g = cp.group_units(u, R.TARGET, R.HARD).select("repo_id", "group_id", "budget_status")
    return u.join(g, ["repo_id", "group_id"]).select("file_id", F.concat(F.lit("file:"), "path").alias("unit_id"), F.when(F.col("budget_status") == "split-required", "needs-split").otherwise("pending").alias("state"), "risk")


def overlay_refresh(s, d):
    """References re-resolved after suppliers moved: replaced symbols, rewritten targets, then counted resolutions."""
    gone = graph_catalogue.removed(s, d)
    mapping = gone.select(F.col("symbol").alias("old_symbol"), F.concat(F.lit("moved:"), "symbol").alias("new_symbol"))
    edges = graph.rewrite_targets(graph_catalogue.edges(s, d), mapping)
    known = graph_catalogue.symbols(s, d).join(gone, "symbol", "left_anti").select("symbol", F.col("symbol").alias("name"))
    known = known.unionByName(mapping.where("new_symbol not like '%1'").select(F.col("new_symbol").alias("symbol"), F.col("new_symbol").alias("name")))
    r = graph.resolve(edges.select(F.col("edge_id").alias("source"), F.col("to_symbol").alias("name")), known)
    return r.groupBy("resolution").agg(F.count("*").alias("n"))


def traversal_seeds(s, d):
    """Changed files whose facts a change touches, joined with files that were removed."""
    touched = graph.overlapping(graph_catalogue.facts(s, d), graph_catalogue.changes(s, d).select("repo_id", "path", "start_line", "end_line"), ["repo_id", "path"]).where("n_touching > 0")
    gone = table(s, d, "candidate_file").where("presence = 'deleted'").select("repo_id", "path", F.concat(F.lit("file:"), "path").alias("seed"))
    return touched.select("repo_id", "path", F.col("id").alias("seed")).unionByName(gone).distinct()


def seed_limitations(s, d):
    """Changed files without any fact: one limitation each."""
    c = table(s, d, "candidate_file").select("repo_id", "path").distinct()
    return c.join(table(s, d, "normalized_fact").select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").withColumn("code", F.lit("changed-symbol-not-indexed"))


def recall_delta(s, d):
    i = table(s, d, "eval_item").select("scenario", "prompt", F.coalesce("expected.must_include", F.array().cast("array<string>")).alias("terms"))
    was = i.select("scenario", evaluation.term_recall(None, F.split_part("prompt", F.lit("\n\n"), F.lit(1))).alias("met"))
    now = i.select("scenario", evaluation.term_recall(None, "prompt").alias("met"))
    return evaluation.recall_delta(was, now, ["scenario"])


def module_tree(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target_file"))
    r = table(s, d, "region").select(F.lit("lib").alias("file"), F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target_file"))
    return syntax.module_tree(s.createDataFrame([("world", "lib")], "crate string, file string"), n.unionByName(r))


def stored_json(s, d):
    e = table(s, d, "manifest_entry").select("entry_id", "path", "content_bytes")
    kept = e.withColumn("canonical_json", F.to_json(F.struct("entry_id", "path", F.when(F.col("path").contains("ledger"), F.col("content_bytes") + 1).otherwise(F.col("content_bytes")).alias("content_bytes"))))
    return validation.json_mismatch(kept, ["entry_id", "path", "content_bytes"], "canonical_json", "row-equals-json", "entry_id")


def sorted_order(s, d):
    m = table(s, d, "manifest_entry").select("repo_id", "entry_id", "path")
    return validation.unsorted(m, "repo_id", "entry_id", "path", "manifest-paths-sorted")


def canonical_codes(s, d):
    i = table(s, d, "eval_item").select("item_id", "expected.must_include")
    return validation.not_canonical(i, "must_include", "terms-sorted", "item_id")


def counter_sums(s, d):
    c = ev.counts(evidence_catalogue.findings(s, d), evidence_catalogue.assessed(s, d))
    names = [n for n in c.columns if n != "repo_id"]
    return ev.sum_counters(c.withColumn("run", F.lit("all")), names, ["run"])


def accounting(s, d):
    """Runs charged to a budget; groups whose last remainder does not fit what was consumed."""
    r = budgets.run_budget(ledger_catalogue.docs(s, d), ["repo_id"], ["doc_id"], "bytes", 50_000)
    charged = r.select("repo_id", F.lit(50_000).alias("initial"), "remaining", F.when(F.col("state") == "executed", F.col("bytes")).otherwise(0).alias("consumed"))
    return validation.accounting(charged, "repo_id")


def presentation_cascade(s, d):
    """Facts kept for presentation per repository, and the symbols of kept files only."""
    kept = budgets.presentation_budget(ledger_catalogue.docs(s, d).select("repo_id", F.lit(1).alias("importance"), F.col("doc_id").alias("seq"), "bytes"), ["repo_id"], 8_000).where("kept").select("repo_id").distinct()
    f = table(s, d, "normalized_fact").select("fact_id", "repo_id").distinct()
    return budgets.cascade(f, kept, "repo_id").groupBy("repo_id").agg(F.count("*").alias("n"))


def queries():
    return {
        "coverage_ledger": coverage_ledger, "overlay_refresh": overlay_refresh, "traversal_seeds": traversal_seeds, "seed_limitations": seed_limitations, "recall_delta": recall_delta, "module_tree": module_tree,
        "stored_json": stored_json, "sorted_order": sorted_order, "canonical_codes": canonical_codes, "counter_sums": counter_sums, "budget_accounting": accounting, "presentation_cascade": presentation_cascade,
    }


def oracle_sql():
    e = graph_catalogue.oracle_sql()
    edge = e["adjacency_out"].split("WITH ", 1)[1].rsplit("SELECT", 1)[0].strip()
    sym = "sym AS (" + e["edge_endpoint_filter"].split("sym AS (", 1)[1].split(", s AS (", 1)[0]
    gone = "gone AS (SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal < 0)"
    counts = evidence_catalogue.oracle_sql()["evidence_counts"]
    names = ["input_findings", "reports", "deduplicated_findings", "mapped_to_units", "added_line", "blocking_candidates", "priority_candidates", "notes", "outside_scope"]
    docs = ledger_catalogue.DOCS
    return {
        "coverage_ledger": f"WITH {R.GROUPS} SELECT file_id, 'file:' || path AS unit_id, CASE WHEN budget_status = 'split-required' THEN 'needs-split' ELSE 'pending' END AS state, u.risk FROM unit u JOIN grp USING (repo_id, group_id)",
        "overlay_refresh": f"""WITH {edge}, {sym}, {gone}, t AS (SELECT edge_id, CASE WHEN g.symbol IS NULL THEN to_symbol ELSE 'moved:' || g.symbol END AS name FROM edge LEFT JOIN gone g ON g.symbol = to_symbol),
k AS (SELECT symbol AS name FROM sym WHERE symbol NOT IN (SELECT symbol FROM gone) UNION SELECT 'moved:' || symbol FROM gone WHERE symbol NOT LIKE '%1')
SELECT CASE WHEN k.name IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution, count(*) AS n FROM t LEFT JOIN k USING (name) GROUP BY 1""",
        "traversal_seeds": """WITH fact AS (SELECT DISTINCT repo_id, path, fact_id AS id, source_range.start_line AS s, source_range.end_line AS e FROM normalized_fact),
c AS (SELECT repo_id, path, r.start_line AS s, r.end_line AS e FROM (SELECT repo_id, path, unnest(changed_ranges) AS r FROM candidate_file))
SELECT DISTINCT repo_id, path, id AS seed FROM fact f WHERE EXISTS (SELECT 1 FROM c WHERE c.repo_id = f.repo_id AND c.path = f.path AND c.s <= f.e AND c.e >= f.s)
UNION SELECT repo_id, path, 'file:' || path FROM candidate_file WHERE presence = 'deleted'""",
        "seed_limitations": "SELECT repo_id, path, 'changed-symbol-not-indexed' AS code FROM (SELECT DISTINCT repo_id, path FROM candidate_file) ANTI JOIN normalized_fact USING (repo_id, path)",
        "recall_delta": """WITH i AS (SELECT scenario, prompt, coalesce(expected.must_include, []) AS terms FROM eval_item),
m AS (SELECT scenario, len(list_filter(terms, lambda t: NOT contains(lower(split_part(prompt, chr(10) || chr(10), 1)), lower(t)))) = 0 AS w, len(list_filter(terms, lambda t: NOT contains(lower(prompt), lower(t)))) = 0 AS n FROM i)
SELECT scenario, count(*) FILTER (WHERE w) * 100 // count(*) AS was, count(*) FILTER (WHERE n) * 100 // count(*) AS now, count(*) FILTER (WHERE n) * 100 // count(*) - count(*) FILTER (WHERE w) * 100 // count(*) AS delta FROM m GROUP BY scenario""",
        "module_tree": """SELECT 'world' AS module_path, 'lib' AS file UNION ALL SELECT 'world::' || r_name, 'r' || CAST(r_regionkey AS VARCHAR) FROM region
UNION ALL SELECT 'world::' || r_name || '::' || n_name, 'n' || CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "stored_json": "SELECT 'row-equals-json' AS rule, CAST(entry_id AS VARCHAR) AS ref FROM manifest_entry WHERE contains(path, 'ledger') AND content_bytes IS NOT NULL",
        "sorted_order": "WITH w AS (SELECT repo_id, path, lag(path) OVER (PARTITION BY repo_id ORDER BY entry_id) AS b FROM manifest_entry) SELECT DISTINCT 'manifest-paths-sorted' AS rule, repo_id AS ref FROM w WHERE b >= path",
        "canonical_codes": "SELECT 'terms-sorted' AS rule, CAST(item_id AS VARCHAR) AS ref FROM eval_item WHERE expected.must_include IS NOT NULL AND list_sort(list_distinct(expected.must_include)) <> expected.must_include",
        "counter_sums": f"SELECT 'all' AS run, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in names)} FROM ({counts})",
        "budget_accounting": f"""WITH {docs}, r AS (SELECT repo_id, bytes, sum(bytes) OVER (PARTITION BY repo_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs),
g AS (SELECT repo_id, sum(CASE WHEN upto - bytes < 50000 THEN bytes ELSE 0 END) AS c, min(greatest(50000 - upto, 0)) AS m FROM r GROUP BY repo_id) SELECT 'budget-accounting' AS rule, repo_id AS ref FROM g WHERE 50000 <> c + m""",
        "presentation_cascade": f"""WITH {docs}, p AS (SELECT repo_id, sum(bytes) OVER (PARTITION BY repo_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS t FROM docs), k AS (SELECT DISTINCT repo_id FROM p WHERE t <= 8000)
SELECT repo_id, count(DISTINCT fact_id) AS n FROM normalized_fact WHERE repo_id IS NULL OR repo_id IN (SELECT repo_id FROM k) GROUP BY repo_id""",
    }
