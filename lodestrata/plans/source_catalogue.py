"""Queries of sources, generations, syntax and identifiers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.lineage import shared_dir
from lodestrata.operators import graph, syntax
from lodestrata.plans import evidence_catalogue, fact_catalogue, graph_catalogue
from lodestrata.plans.relations import table
from lodestrata.sources import generations, reports, sinks, version_control


def sarif_reports(s, d):
    """One SARIF document per provider and repository, made from the facts."""
    f = table(s, d, "normalized_fact").select("fact_id", "provider_id", "repo_id", "rule_id", "path", "text", "confidence", "source_range").distinct()
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.when(F.col("confidence") == "high", "error").otherwise("note").alias("level"), F.struct("text").alias("message"),
        F.array(F.struct(F.struct(F.struct(F.concat(F.lit("file://./"), F.col("path")).alias("uri")).alias("artifactLocation"), F.struct(F.col("source_range.start_line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return f.groupBy("provider_id", "repo_id", "path").agg(F.collect_list(result).alias("results")).select(
        F.concat_ws("@", "provider_id", "repo_id", "path").alias("report_id"),
        F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.col("provider_id").alias("name")).alias("driver")).alias("tool"), F.col("results"))).alias("runs"))).alias("payload"),
    )


def sarif_roundtrip(s, d):
    return reports.sarif(sarif_reports(s, d)).select("tool", "rule_id", "path", "start_line", "severity").groupBy("tool", "rule_id", "path", "start_line", "severity").agg(F.count("*").alias("n"))


def publish_read(s, d):
    key = generations.generation_key(1, [d, s.sparkContext.applicationId])
    root = f"{shared_dir(s)}/generations"
    generations.publish({"edges": graph_catalogue.edges(s, d).sortWithinPartitions("from_symbol", "kind")}, root, key)
    return generations.read(s, root, key, "edges").groupBy("kind").agg(F.count("*").alias("n"), F.min("edge_id").alias("least"), F.max("edge_id").alias("most"))


def generation_root(s, d):
    edges = graph_catalogue.edges(s, d)
    return generations.root_hash(edges, edges.columns)


def report_sinks(s, d):
    path = f"{shared_dir(s)}/sink-{ids.__name__}-{abs(hash((d, s.sparkContext.applicationId, id(s))))}-{table(s, d, 'nation').rdd.id()}"
    sinks.write_json_lines(table(s, d, "documents").select("doc_id", "source", F.length("text").alias("length")), path)
    return s.read.schema("doc_id bigint, source string, length int").json(path)


def markdown(s, d):
    return sinks.markdown_rows(table(s, d, "reviewed_baseline").select("baseline_id", "platform_id", "p95_ms"))


def top1_locator(s, d):
    o = table(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("o_orderkey"))


def semantic_bfs(s, d):
    """Calls over documents of one repository, by time: each to the next; two steps from the first of each repository."""
    doc = table(s, d, "documents").where("repo_id is not null and created_at is not null").select("repo_id", "created_at", "doc_id")
    from lodestrata.operators.ordered import rank

    n = rank(doc, ["repo_id"], ["created_at", "doc_id"], "place")
    a = n.select("repo_id", "place", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("from_symbol"))
    b = n.select("repo_id", (F.col("place") - 1).alias("place"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("to_symbol"))
    e = a.join(b, ["repo_id", "place"]).select(F.concat_ws(">", "from_symbol", "to_symbol").alias("edge_id"), F.lit("calls").alias("kind"), "from_symbol", "to_symbol")
    found, _ = graph.bfs(e, a.where("place = 1").select(F.col("from_symbol").alias("node")), 2, ("outgoing",))
    return found.select("edge_id", "level")


def source_choice(s, d):
    c = table(s, d, "candidate_file").select("repo_id", F.when(F.col("change_status") == "A", "staged").when(F.col("change_status") == "M", "unstaged").otherwise("branch").alias("source"))
    return version_control.pick_source(c.groupBy("repo_id", "source").agg(F.count("*").alias("changes")))


def manifest_bounded(s, d):
    kept, lost = version_control.manifest(table(s, d, "manifest_entry").select("entry_id", "repo_id", "path", "content_bytes"), 12, 15_000)
    return kept.groupBy("repo_id").agg(F.count("*").alias("kept")).join(lost.select("repo_id", "lost"), "repo_id", "full_outer").select("repo_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lost", F.lit(0)).alias("lost"))


def digest_chain(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", ids.prefixed_digest(F.lit("rust-repository-module/v1"), F.lit(""), "n_name", F.col("n_regionkey").cast("string")).alias("digest"), ids.git_blob_id(F.encode("n_name", "UTF-8")).alias("blob"))


def fact_store(s, d):
    c = fact_catalogue.texts(s, d).select(ids.prefixed_digest(F.lit("file-facts/v1"), F.lit("any"), F.sha2("text", 256)).alias("fact_key"), F.sha2("path", 256).alias("payload"), F.when(F.col("path").contains("ledger"), "old").otherwise("new").alias("version"))
    store = generations.put_facts(None, c.withColumn("digest", F.when(F.col("payload").startswith("0"), F.lit("bad")).otherwise(F.sha2("payload", 256))))
    return generations.get_facts(store, c.select("fact_key").distinct().withColumn("version", F.lit("new"))).groupBy("status").agg(F.count("*").alias("n"))


def queries():
    return {
        "sarif_roundtrip": sarif_roundtrip,
        "report_formats": lambda s, d: reports.read_reports(sarif_reports(s, d).unionByName(table(s, d, "publication_raw").select(F.col("record_id").cast("string").alias("report_id"), "payload")))[1].groupBy("format").agg(F.count("*").alias("n")),
        "generation_publish_read": publish_read,
        "generation_root": generation_root,
        "report_sinks": report_sinks,
        "markdown_sink": markdown,
        "top1_locator": top1_locator,
        "semantic_bfs": semantic_bfs,
        "source_choice": source_choice,
        "manifest_bounded": manifest_bounded,
        "digest_chain": digest_chain,
        "fact_store": fact_store,
        "rust_symbols": lambda s, d: syntax.symbols(fact_catalogue.texts(s, d)),
        "rust_calls": lambda s, d: syntax.calls(fact_catalogue.texts(s, d)).groupBy("file_id", "name", "is_macro").agg(F.count("*").alias("n")),
        "evidence_by_sarif": lambda s, d: evidence_catalogue.ev.merge(reports.sarif(sarif_reports(s, d)).withColumn("repo_id", F.element_at(F.split("report_id", "@"), 2)).select("repo_id", *reports.OUT)).groupBy("severity").agg(F.count("*").alias("n")),
    }


def oracle_sql():
    files = fact_catalogue.FILES
    pre = lambda x: f"unhex(lpad(printf('%x', strlen({x})), 16, '0')) || encode({x})"
    rows = f"ln AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM file WHERE lower(path) LIKE '%.rs'), code AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '^\\s*//'))"
    sym = syntax.SYMBOL.replace("'", "''")
    not_calls = ", ".join(f"'{w}'" for w in syntax.NOT_CALLS)
    return {
        "sarif_roundtrip": """WITH f AS (SELECT DISTINCT fact_id, provider_id, repo_id, rule_id, path, text, confidence, source_range FROM normalized_fact)
SELECT provider_id AS tool, rule_id, path, source_range.start_line AS start_line, CASE WHEN confidence = 'high' THEN 'error' ELSE 'note' END AS severity, count(*) AS n FROM f GROUP BY ALL""",
        "generation_publish_read": f"WITH {graph_catalogue.oracle_sql()['adjacency_out'].split('WITH ', 1)[1].rsplit('SELECT', 1)[0].strip()} SELECT kind, count(*) AS n, min(edge_id) AS least, max(edge_id) AS most FROM edge GROUP BY kind",
        "report_sinks": "SELECT doc_id, source, CAST(length(text) AS INT) AS length FROM documents",
        "markdown_sink": "SELECT '| ' || baseline_id || ' | ' || platform_id || ' | ' || coalesce(CAST(p95_ms AS VARCHAR), '') || ' |' AS line FROM reviewed_baseline",
        "top1_locator": "SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
        "semantic_bfs": """WITH n AS (SELECT repo_id, doc_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at, doc_id) AS k FROM documents WHERE repo_id IS NOT NULL AND created_at IS NOT NULL)
SELECT 'doc:' || CAST(a.doc_id AS VARCHAR) || '>doc:' || CAST(b.doc_id AS VARCHAR) AS edge_id, CAST(a.k AS INT) AS level FROM n a JOIN n b ON a.repo_id = b.repo_id AND b.k = a.k + 1 WHERE a.k <= 2""",
        "source_choice": """WITH c AS (SELECT repo_id, CASE change_status WHEN 'A' THEN 2 WHEN 'M' THEN 3 ELSE 4 END AS k FROM candidate_file)
SELECT repo_id, CASE min(k) WHEN 2 THEN 'staged' WHEN 3 THEN 'unstaged' ELSE 'branch' END AS source FROM c GROUP BY repo_id""",
        "manifest_bounded": """WITH r AS (SELECT repo_id, row_number() OVER w AS f, sum(coalesce(content_bytes, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM manifest_entry WINDOW w AS (PARTITION BY repo_id ORDER BY path, entry_id))
SELECT repo_id, count(*) FILTER (WHERE f <= 12 AND b <= 15000) AS kept, count(*) FILTER (WHERE NOT (f <= 12 AND b <= 15000)) AS lost FROM r GROUP BY repo_id""",
        "digest_chain": f"SELECT n_nationkey, sha256({pre(repr('rust-repository-module/v1'))} || {pre(repr(''))} || {pre('n_name')} || {pre('CAST(n_regionkey AS VARCHAR)')}) AS digest, sha1('blob ' || CAST(strlen(n_name) AS VARCHAR) || chr(0) || n_name) AS blob FROM nation",
        "rust_symbols": f"WITH {files}, {rows}, m AS (SELECT file_id, line_no, regexp_extract(line, '{sym}', ['v', 'k', 'n']) AS s FROM code WHERE regexp_matches(line, '{sym}')) SELECT file_id, CAST(line_no AS INT) AS line_no, s.k AS kind, s.n AS name, CASE WHEN s.v <> '' THEN trim(s.v) END AS visibility, 'recovered' AS quality FROM m",
        "rust_calls": f"""WITH {files}, {rows}, m AS (SELECT file_id, unnest(regexp_extract_all(line, '{syntax.CALL}', 1)) AS name, unnest(regexp_extract_all(line, '{syntax.CALL}', 2)) AS b FROM code WHERE NOT regexp_matches(line, '{sym}'))
SELECT file_id, name, b = '!' AS is_macro, count(*) AS n FROM m WHERE name NOT IN ({not_calls}) GROUP BY ALL""",
        "report_formats": "SELECT 'sarif' AS format, count(*) AS n FROM (SELECT DISTINCT provider_id, repo_id, path FROM normalized_fact) UNION ALL SELECT 'unknown', count(*) FROM publication_raw",
        "evidence_by_sarif": r"""WITH f AS (SELECT DISTINCT fact_id, provider_id, repo_id, rule_id, path, text AS t, confidence, source_range.start_line AS s FROM normalized_fact),
k AS (SELECT repo_id, provider_id, rule_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS m, path, s, max(CASE WHEN confidence = 'high' THEN 4 ELSE 2 END) AS r FROM f GROUP BY repo_id, provider_id, rule_id, m, path, s)
SELECT CASE r WHEN 4 THEN 'error' ELSE 'note' END AS severity, count(*) AS n FROM k GROUP BY 1""",
        "fact_store": f"""WITH {files}, c AS (SELECT sha256(text) AS k, sha256(path) AS p, CASE WHEN contains(path, 'ledger') THEN 'old' ELSE 'new' END AS v FROM file), s AS (SELECT k, min(p) AS p, arg_min(v, p) AS v FROM c GROUP BY k)
SELECT CASE WHEN starts_with(p, '0') THEN 'corrupt' WHEN v <> 'new' THEN 'stale' ELSE 'hit' END AS status, count(*) AS n FROM s GROUP BY 1""",
    }
