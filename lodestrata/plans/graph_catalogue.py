"""Queries over a graph made of the star schema: parts, suppliers, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.lineage import cut
from lodestrata.operators import graph as g
from lodestrata.plans.relations import table

ROOTS = ("supplier:1", "nation:3", "customer:5", "absent:0")
CALLS = ("calls", "imports", "references", "exports")


def _range(line):
    """Where an edge stands in its file: by the number of what it names, so that a file has several at different places."""
    start = (F.split_part(line, F.lit(":"), F.lit(2)).cast("int") % 50 + 1).cast("int")
    return [start.alias("start_line"), (start + 1).cast("int").alias("end_line")]


def _edge(df, kind, source, target, line=None):
    line = F.col("to_symbol") if line is None else line
    e = df.select(F.lit(kind).alias("kind"), source.alias("from_symbol"), target.alias("to_symbol")).distinct()
    return e.select(ids.stable_id("edge/v1", "kind", "from_symbol", "to_symbol").alias("edge_id"), "*", F.concat(F.lit("src/"), F.replace("from_symbol", F.lit(":"), F.lit("/"))).alias("path"), *_range(line))


def _sym(kind, column):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def edges(s, d):
    parts = _edge(table(s, d, "lineitem"), "calls", _sym("part", "l_partkey"), _sym("supplier", "l_suppkey"))
    sup = _edge(table(s, d, "supplier"), "imports", _sym("supplier", "s_suppkey"), _sym("nation", "s_nationkey"))
    cus = _edge(table(s, d, "customer"), "references", _sym("customer", "c_custkey"), _sym("nation", "c_nationkey"))
    nat = _edge(table(s, d, "nation"), "exports", _sym("nation", "n_nationkey"), _sym("region", "n_regionkey"))
    return parts.unionByName(sup).unionByName(cus).unionByName(nat)


def symbols(s, d):
    parts = [("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")]
    out = None
    for kind, key, name in parts:
        one = table(s, d, kind).select(_sym(kind, key).alias("symbol"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def roots(s):
    return s.createDataFrame([(r,) for r in ROOTS], "node string")


def removed(s, d):
    return table(s, d, "supplier").where("s_acctbal < 0").select(_sym("supplier", "s_suppkey").alias("symbol"))


def replacement(s, d):
    """Imports of rich suppliers go to zones; of calls to removed suppliers every third one is retargeted at its place."""
    rich = table(s, d, "supplier").where("s_acctbal > 9000")
    zones = _edge(rich, "imports", _sym("supplier", "s_suppkey"), F.concat(F.lit("zone:"), (F.col("s_nationkey") % 7).cast("string")))
    lost = edges(s, d).where("kind = 'calls'").join(removed(s, d), F.col("to_symbol") == F.col("symbol"), "left_semi")
    key = F.split_part("to_symbol", F.lit(":"), F.lit(2)).cast("bigint")
    moved = lost.where(key % 3 == 0).select("kind", "from_symbol", F.concat(F.lit("moved:"), key.cast("string")).alias("to_symbol"), "path", "start_line", "end_line")
    return zones.unionByName(moved.select(ids.stable_id("edge/v1", "kind", "from_symbol", "to_symbol").alias("edge_id"), "*"))


def bfs_edges(depth, directions=("incoming", "outgoing"), kinds=()):
    def run(s, d):
        held = edges(s, d)
        found, _ = g.bfs(cut(held.where(F.col("kind").isin(*kinds)) if kinds else held), roots(s), depth, directions, kinds)
        return found.select("edge_id", "kind", "from_symbol", "to_symbol", "level")

    return run


def bfs_budgeted(depth, *budgets):
    def run(s, d):
        kept, limits = g.bounded_bfs(cut(edges(s, d)), roots(s), depth, *budgets)
        rows = kept.select("edge_id", "level")
        return rows.unionByName(limits.select(F.col("code").alias("edge_id"), F.lit(0).alias("level")))

    return run


def scoped_names(s, d):
    """Names in scope of a brand: parts as local names, of big ones bindings, suppliers as globs and nations as exports."""
    p = table(s, d, "part").select(F.col("p_brand").alias("scope"), F.element_at(F.split("p_name", " "), 1).alias("name"), _sym("part", "p_partkey").alias("symbol"), F.when(F.col("p_size") > 45, 0).otherwise(1).alias("tier"))
    scopes = table(s, d, "part").select(F.col("p_brand").alias("scope")).distinct()
    n = table(s, d, "nation").select(F.lower("n_name").alias("name"), _sym("nation", "n_nationkey").alias("symbol"), F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(3).alias("tier"))
    return p.unionByName(scopes.join(n, F.length("scope") > 0).select("scope", "name", "symbol", "tier"))


def scoped_calls(s, d):
    """Calls by lines: of the first and last word of the part's name, and of the nation of its supplier."""
    words = F.array(F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1), F.lower("p_type"))
    return table(s, d, "part").select(_sym("part", "p_partkey").alias("source"), F.explode(words).alias("name"), F.col("p_brand").alias("scope"), (F.col("p_partkey") % 5 == 0).alias("is_method"))


def described(s, d):
    """Symbols with whether they are public and stand in tests."""
    return symbols(s, d).select("symbol", (F.col("kind") == "nation").alias("public"), ((F.col("kind") == "part") & F.col("symbol").endswith("7")).alias("is_test"))


def survival(s, d):
    e = edges(s, d).withColumn("callee", F.col("to_symbol"))
    facts = e.join(removed(s, d), F.col("to_symbol") == F.col("symbol"), "left_anti")
    return g.surviving_edges(e, facts).groupBy("kind").agg(F.count("*").alias("n"))


def references(s, d):
    nation = table(s, d, "nation")
    sup = table(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_sym("supplier", "s_suppkey").alias("source"), F.col("n_name").alias("name"))
    part = table(s, d, "part").select(_sym("part", "p_partkey").alias("source"), F.col("p_name").alias("name"))
    cus = table(s, d, "customer").select(_sym("customer", "c_custkey").alias("source"), F.col("c_mktsegment").alias("name"))
    return sup.unionByName(part).unionByName(cus)


def replacement_map(s, d):
    p = table(s, d, "part")
    old = p.select(_sym("part", "p_partkey").alias("symbol"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("local_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    new = p.where("p_size > 25").select(F.concat(F.lit("new:"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat_ws("/", F.when(F.col("p_size") > 40, F.lit("moved")).otherwise(F.col("p_brand")), F.col("p_partkey").cast("string")).alias("local_id"), F.col("p_name").alias("name"), F.concat(F.col("p_type"), F.when(F.col("p_retailprice") > 1500, F.lit("+")).otherwise(F.lit(""))).alias("kind"))
    return g.replacements(old, new)


def facts(s, d):
    f = table(s, d, "normalized_fact")
    return f.select("repo_id", "path", F.col("fact_id").alias("id"), F.col("source_range.start_line").alias("start_line"), F.col("source_range.end_line").alias("end_line")).distinct()


def changes(s, d):
    c = table(s, d, "candidate_file").select("file_id", "repo_id", "path", F.explode("changed_ranges").alias("r"))
    return c.select("file_id", "repo_id", "path", "r.start_line", "r.end_line").distinct()


def tree(s, d):
    n = table(s, d, "nation").select(_sym("nation", "n_nationkey").alias("node"), _sym("region", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    r = table(s, d, "region").select(_sym("region", "r_regionkey").alias("node"), F.lit("world").alias("parent"), F.col("r_name").alias("name"))
    return n.unionByName(r).unionByName(s.createDataFrame([("world", None, "WORLD")], "node string, parent string, name string"))


def path_expansion(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    module = F.concat_ws("::", F.lit("app"), "r_name", "n_name")
    forms = F.array(F.lit("crate::io"), F.lit("self::io::read"), F.lit("super::peer"), F.lit("super::super::top"), F.lit("super::super::super::up"), F.lit("std::mem"))
    e = n.select("n_nationkey", module.alias("module"), F.explode(forms).alias("path"))
    return e.select("n_nationkey", "path", g.expand_path("path", "module").alias("absolute"))


def ordered_imports(s, d):
    f = table(s, d, "normalized_fact").select("repo_id", "path", F.col("source_range.start_byte").alias("start_byte"), F.col("rule_id").alias("segments"), F.concat(F.col("kind"), F.lit("/unit")).alias("name"), (F.col("resolution") == "resolved").alias("exported")).distinct()
    return g.ordered_imports(f.where("start_byte is not null").fillna(False, ["exported"]))


def nearest_root(s, d):
    m = table(s, d, "manifest_entry")
    return g.nearest_root(m.select("path").distinct(), m.select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("root")).where("root <> ''"))


def queries():
    return {
        "adjacency_out": lambda s, d: edges(s, d).groupBy("from_symbol", "kind").agg(F.count("*").alias("n"), F.min("edge_id").alias("first")),
        "adjacency_in": lambda s, d: edges(s, d).groupBy("to_symbol", "kind").agg(F.count("*").alias("n"), F.min("edge_id").alias("first")),
        "bfs_depth1": bfs_edges(1),
        "bfs_depth2": bfs_edges(2),
        "bfs_outgoing_kinds": bfs_edges(3, ("outgoing",), ("imports", "exports")),
        "bfs_budgeted": bfs_budgeted(1, 40, 30, 25, 1_000_000),
        "bfs_budgeted_deep": bfs_budgeted(3, 400, 60, 200, 30_000),
        "call_edges": lambda s, d: g.call_edges(scoped_calls(s, d), scoped_names(s, d)),
        "graph_summaries": lambda s, d: g.graph_summaries(edges(s, d), symbols(s, d).where("kind in ('supplier', 'nation')"), described(s, d)),
        "overlay_edges": lambda s, d: g.overlay(edges(s, d), removed(s, d), replacement(s, d)),
        "reverse_dependents": lambda s, d: g.reverse_dependents(edges(s, d), removed(s, d), CALLS),
        "edge_endpoint_filter": lambda s, d: g.with_endpoints(edges(s, d), symbols(s, d).where("kind <> 'customer' and name not like '%1'")).select("edge_id", "kind"),
        "endpoint_lookup": lambda s, d: g.endpoint_names(edges(s, d), symbols(s, d).where("kind = 'nation'").withColumn("name", F.concat(F.lit("overlay "), "name")), symbols(s, d)),
        "graph_summary": lambda s, d: g.change_roles(edges(s, d), symbols(s, d).where("kind in ('supplier', 'nation')")),
        "resolve_cardinality": lambda s, d: g.resolve(references(s, d), symbols(s, d)),
        "replacement_map": replacement_map,
        "target_rewrite": lambda s, d: g.rewrite_targets(edges(s, d), removed(s, d).select(F.col("symbol").alias("old_symbol"), F.concat(F.lit("moved:"), "symbol").alias("new_symbol"))).groupBy("to_symbol").agg(F.count("*").alias("n")),
        "seed_overlap_join": lambda s, d: g.overlapping(changes(s, d), facts(s, d), ["repo_id", "path"]),
        "enclosing_range": lambda s, d: g.innermost(changes(s, d), facts(s, d), ["repo_id", "path"]),
        "glob_ambiguity": lambda s, d: g.glob_ambiguity(table(s, d, "lineitem").select(F.col("l_suppkey").alias("module"), (F.col("l_returnflag") == "R").alias("glob"), F.col("l_partkey").alias("target"))),
        "first_symbol": lambda s, d: g.first_symbols(table(s, d, "part").select(F.col("p_brand").alias("module"), F.col("p_size").alias("start"), F.col("p_partkey").alias("symbol"))),
        "owner_chain": lambda s, d: g.owner_paths(tree(s, d), 3),
        "path_expansion": path_expansion,
        "ordered_imports": ordered_imports,
        "overlay_edge_survival": survival,
        "nearest_root": nearest_root,
        "graph_point_query": lambda s, d: symbols(s, d).where(F.col("symbol").isin(*ROOTS)),
    }


def oracle_sql():
    def edge(kind, a, ak, b, bk, src, where=""):
        return f"SELECT DISTINCT '{kind}' AS kind, '{a}:' || CAST({ak} AS VARCHAR) AS from_symbol, '{b}:' || CAST({bk} AS VARCHAR) AS to_symbol FROM {src} {where}"

    full = lambda q: f"SELECT substr(sha256('edge/v1' || chr(0) || kind || chr(0) || from_symbol || chr(0) || to_symbol || chr(0)), 1, 16) AS edge_id, *, 'src/' || replace(from_symbol, ':', '/') AS path, CAST(CAST(split_part(to_symbol, ':', 2) AS INT) % 50 + 1 AS INT) AS start_line, CAST(CAST(split_part(to_symbol, ':', 2) AS INT) % 50 + 2 AS INT) AS end_line FROM ({q})"
    e = "edge AS (" + full(" UNION ALL ".join([
        edge("calls", "part", "l_partkey", "supplier", "l_suppkey", "lineitem"), edge("imports", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier"),
        edge("references", "customer", "c_custkey", "nation", "c_nationkey", "customer"), edge("exports", "nation", "n_nationkey", "region", "n_regionkey", "nation"),
    ])) + ")"
    sym = """sym AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, 'part' AS kind FROM part UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), c_name, 'customer' FROM customer UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), n_name, 'nation' FROM nation
  UNION ALL SELECT 'region:' || CAST(r_regionkey AS VARCHAR), r_name, 'region' FROM region)"""
    root = "root AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}')" for r in ROOTS) + ") AS r(node))"

    def bfs(depth, both=True, kinds=()):
        only = f"WHERE kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
        link = "SELECT from_symbol AS a, to_symbol AS b FROM k" + (" UNION ALL SELECT to_symbol, from_symbol FROM k" if both else "")
        test = f"least(f.depth, {'t.depth' if both else 'f.depth'})"
        return f"""WITH RECURSIVE {e}, {root}, k AS (SELECT * FROM edge {only}), link AS ({link}),
walk AS (SELECT node, 0 AS depth FROM root UNION SELECT l.b, w.depth + 1 FROM walk w JOIN link l ON l.a = w.node WHERE w.depth < {depth}),
near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT k.edge_id, k.kind, k.from_symbol, k.to_symbol, CAST({test} + 1 AS INT) AS level FROM k LEFT JOIN near f ON f.node = k.from_symbol LEFT JOIN near t ON t.node = k.to_symbol WHERE {test} < {depth}"""

    gone = "gone AS (SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal < 0)"
    repl = "repl AS (" + full("SELECT DISTINCT 'imports' AS kind, 'supplier:' || CAST(s_suppkey AS VARCHAR) AS from_symbol, 'zone:' || CAST(s_nationkey % 7 AS VARCHAR) AS to_symbol FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'calls', from_symbol, 'moved:' || split_part(to_symbol, ':', 2) FROM edge WHERE kind = 'calls' AND to_symbol IN (SELECT symbol FROM gone) AND CAST(split_part(to_symbol, ':', 2) AS BIGINT) % 3 = 0") + ")"
    pre = lambda x: f"unhex(lpad(printf('%x', strlen({x})), 16, '0')) || encode({x})"
    facts_sql = "fact AS (SELECT DISTINCT repo_id, path, fact_id AS id, source_range.start_line AS start_line, source_range.end_line AS end_line FROM normalized_fact)"
    change = "change AS (SELECT DISTINCT file_id, repo_id, path, r.start_line AS start_line, r.end_line AS end_line FROM (SELECT file_id, repo_id, path, unnest(changed_ranges) AS r FROM candidate_file))"
    return {
        "adjacency_out": f"WITH {e} SELECT from_symbol, kind, count(*) AS n, min(edge_id) AS first FROM edge GROUP BY from_symbol, kind",
        "adjacency_in": f"WITH {e} SELECT to_symbol, kind, count(*) AS n, min(edge_id) AS first FROM edge GROUP BY to_symbol, kind",
        "bfs_depth1": bfs(1),
        "bfs_depth2": bfs(2),
        "bfs_outgoing_kinds": bfs(3, False, ("imports", "exports")),
        "bfs_budgeted": f"""WITH {e}, {root},
l AS (SELECT node, 0 AS turn, kind, edge_id, to_symbol AS other FROM edge JOIN root ON from_symbol = node UNION ALL SELECT node, 1, kind, edge_id, from_symbol FROM edge JOIN root ON to_symbol = node),
c AS (SELECT node, turn, count(*) AS n, sum(count(*)) OVER (ORDER BY node, turn ROWS UNBOUNDED PRECEDING) AS upto FROM l GROUP BY node, turn),
h AS (SELECT node, turn, 40 - (upto - n) AS most FROM c WHERE n >= 40 - (upto - n) ORDER BY node, turn LIMIT 1),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l.node, l.turn ORDER BY kind, edge_id) AS k FROM l),
got AS (SELECT r.* FROM r LEFT JOIN h ON true WHERE h.node IS NULL OR (r.node, r.turn) < (h.node, h.turn) OR (r.node = h.node AND r.turn = h.turn AND r.k <= h.most)),
one AS (SELECT edge_id, row_number() OVER (ORDER BY min((node, turn, edge_id))) AS place FROM got GROUP BY edge_id),
fresh AS (SELECT count(DISTINCT other) AS n FROM got WHERE other IS NOT NULL AND other NOT IN (SELECT node FROM root))
SELECT edge_id, 1 AS level FROM one WHERE place <= 25
UNION ALL SELECT 'index-query-row-budget-exhausted', 0 FROM h
UNION ALL SELECT 'index-edge-budget-exhausted', 0 WHERE (SELECT count(*) FROM one) > 25
UNION ALL SELECT 'index-node-budget-exhausted', 0 WHERE (SELECT n FROM fresh) + {len(ROOTS)} > 30
UNION ALL SELECT 'index-graph-depth-budget-exhausted', 0 WHERE NOT EXISTS (SELECT 1 FROM h) AND (SELECT n FROM fresh) > 0""",
        "call_edges": f"""WITH scopes AS (SELECT DISTINCT p_brand AS scope FROM part),
names AS (SELECT p_brand AS scope, string_split(p_name, ' ')[1] AS name, 'part:' || CAST(p_partkey AS VARCHAR) AS symbol, CASE WHEN p_size > 45 THEN 0 ELSE 1 END AS tier FROM part
  UNION ALL SELECT scope, lower(n_name), 'nation:' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END FROM scopes, nation),
best AS (SELECT scope, name, arg_min(n, tier) AS n, arg_min(o, tier) AS o FROM (SELECT scope, name, tier, count(DISTINCT symbol) AS n, min(symbol) AS o FROM names GROUP BY ALL) GROUP BY scope, name),
call AS (SELECT DISTINCT 'part:' || CAST(p_partkey AS VARCHAR) AS source, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[-1], lower(p_type)]) AS name, p_brand AS scope, p_partkey % 5 = 0 AS is_method FROM part),
e AS (SELECT source, name, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 OR is_method THEN 'polymorphic' ELSE 'resolved' END AS resolution, CASE WHEN n = 1 AND NOT is_method THEN o END AS target FROM call LEFT JOIN best USING (scope, name))
SELECT source, name, 'calls' AS kind, candidates, resolution, target FROM e UNION ALL SELECT source, name, 'references', candidates, resolution, target FROM e WHERE resolution = 'resolved'""",
        "graph_summaries": f"""WITH {e}, {sym}, c AS (SELECT symbol FROM sym WHERE kind IN ('supplier', 'nation')),
near AS (SELECT to_symbol AS here, from_symbol AS other, CASE WHEN kind = 'calls' THEN 'caller' ELSE 'reverse' END AS role FROM edge WHERE kind IN ('calls', 'imports', 'references') UNION SELECT from_symbol, to_symbol, 'callee' FROM edge WHERE kind = 'calls')
SELECT symbol, starts_with(symbol, 'nation:') AS interface_change, count(DISTINCT CASE WHEN role = 'caller' THEN other END) AS callers, count(DISTINCT CASE WHEN role = 'callee' THEN other END) AS callees,
  count(DISTINCT CASE WHEN role = 'reverse' THEN other END) AS reverse_dependents, count(DISTINCT CASE WHEN other LIKE 'part:%7' THEN other END) AS connected_tests FROM c LEFT JOIN near ON here = symbol GROUP BY symbol""",
        "overlay_edges": f"""WITH {e}, {gone}, {repl},
kept AS (SELECT * FROM edge WHERE from_symbol NOT IN (SELECT symbol FROM gone) AND edge_id NOT IN (SELECT edge_id FROM repl)),
broken AS (SELECT * FROM kept k WHERE to_symbol IN (SELECT symbol FROM gone) AND NOT EXISTS (SELECT 1 FROM repl t WHERE t.path = k.path AND t.kind = k.kind AND t.start_line = k.start_line AND t.end_line = k.end_line AND t.to_symbol <> k.to_symbol))
SELECT edge_id, kind, from_symbol, to_symbol, CAST(NULL AS VARCHAR) AS unresolved_target, path, start_line, end_line, 'resolved' AS resolution, 'high' AS confidence, 'base' AS origin FROM kept WHERE to_symbol NOT IN (SELECT symbol FROM gone)
UNION ALL SELECT sha256({pre("'repository-overlay-deleted-target/v1'")} || {pre('edge_id')} || {pre('to_symbol')}), kind, from_symbol, NULL, to_symbol, path, start_line, end_line, 'unresolved', 'low', 'deleted-target' FROM broken
UNION ALL SELECT edge_id, kind, from_symbol, to_symbol, NULL, path, start_line, end_line, 'resolved', 'high', 'overlay' FROM repl""",
        "reverse_dependents": f"""WITH RECURSIVE {e}, {gone}, walk AS (SELECT symbol, 0 AS round FROM gone UNION SELECT k.from_symbol, w.round + 1 FROM walk w JOIN edge k ON k.to_symbol = w.symbol WHERE w.round < 5),
near AS (SELECT symbol, min(round) AS round FROM walk GROUP BY symbol) SELECT symbol, CAST(round AS INT) AS round FROM near WHERE round > 0""",
        "edge_endpoint_filter": f"""WITH {e}, {sym}, s AS (SELECT symbol FROM sym WHERE kind <> 'customer' AND name NOT LIKE '%1')
SELECT edge_id, kind FROM edge WHERE from_symbol IN (SELECT symbol FROM s) AND (to_symbol IS NULL OR to_symbol IN (SELECT symbol FROM s))""",
        "endpoint_lookup": f"""WITH {e}, {sym}, n AS (SELECT symbol, CASE WHEN kind = 'nation' THEN 'overlay ' || name ELSE name END AS name FROM sym)
SELECT edge_id, f.name AS from_name, t.name AS to_name FROM edge LEFT JOIN n f ON f.symbol = from_symbol LEFT JOIN n t ON t.symbol = to_symbol""",
        "graph_summary": f"""WITH {e}, {sym}, c AS (SELECT symbol FROM sym WHERE kind IN ('supplier', 'nation'))
SELECT symbol, (SELECT count(*) FROM edge WHERE to_symbol = symbol AND kind <> 'imports') AS incoming, (SELECT count(*) FROM edge WHERE from_symbol = symbol) AS outgoing,
  (SELECT count(*) FROM edge WHERE to_symbol = symbol AND kind = 'imports') AS reverse_imports FROM c""",
        "resolve_cardinality": f"""WITH {sym}, ref AS (SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS source, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'part:' || CAST(p_partkey AS VARCHAR), p_name FROM part UNION SELECT 'customer:' || CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer),
per AS (SELECT name, count(DISTINCT symbol) AS c, min(symbol) AS o FROM sym GROUP BY name)
SELECT source, name, coalesce(c, 0) AS candidates, CASE WHEN c = 1 THEN 'resolved' WHEN c > 1 THEN 'polymorphic' ELSE 'unresolved' END AS resolution, CASE WHEN c = 1 THEN o END AS target FROM ref LEFT JOIN per USING (name)""",
        "replacement_map": """WITH o AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS s, p_brand || '/' || CAST(p_partkey AS VARCHAR) AS l, p_name AS n, p_type AS k FROM part),
w AS (SELECT 'new:' || CAST(p_partkey AS VARCHAR) AS s, CASE WHEN p_size > 40 THEN 'moved' ELSE p_brand END || '/' || CAST(p_partkey AS VARCHAR) AS l, p_name AS n, p_type || CASE WHEN p_retailprice > 1500 THEN '+' ELSE '' END AS k FROM part WHERE p_size > 25),
u AS (SELECT n, k, min(s) AS s FROM w GROUP BY n, k HAVING count(*) = 1)
SELECT o.s AS old_symbol, coalesce(w.s, u.s) AS new_symbol, CASE WHEN w.s IS NOT NULL THEN 'exact' WHEN u.s IS NOT NULL THEN 'unique-name' ELSE 'none' END AS tier FROM o LEFT JOIN w ON w.l = o.l LEFT JOIN u ON u.n = o.n AND u.k = o.k""",
        "target_rewrite": f"WITH {e}, {gone} SELECT CASE WHEN g.symbol IS NULL THEN to_symbol ELSE 'moved:' || g.symbol END AS to_symbol, count(*) AS n FROM edge LEFT JOIN gone g ON g.symbol = to_symbol GROUP BY 1",
        "seed_overlap_join": f"WITH {facts_sql}, {change} SELECT c.*, (SELECT CAST(count(*) AS INT) FROM fact f WHERE f.repo_id = c.repo_id AND f.path = c.path AND f.start_line <= c.end_line AND f.end_line >= c.start_line) AS n_touching FROM change c",
        "enclosing_range": f"""WITH {facts_sql}, {change} SELECT c.*, (SELECT arg_min(f.id, (f.end_line - f.start_line, f.id)) FROM fact f WHERE f.repo_id = c.repo_id AND f.path = c.path AND f.start_line <= c.start_line AND f.end_line >= c.end_line) AS owner FROM change c""",
        "glob_ambiguity": "SELECT l_suppkey AS module, count(DISTINCT l_partkey) AS globs FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1",
        "first_symbol": "SELECT p_brand AS module, arg_min(p_partkey, (p_size, p_partkey)) AS symbol FROM part GROUP BY 1",
        "owner_chain": """SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS node, 'WORLD::' || r_name || '::' || n_name AS logical_path FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'region:' || CAST(r_regionkey AS VARCHAR), 'WORLD::' || r_name FROM region UNION ALL SELECT 'world', 'WORLD'""",
        "path_expansion": """WITH m AS (SELECT n_nationkey, r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, 'crate::io' AS path, 'app::io' AS absolute FROM m UNION ALL SELECT n_nationkey, 'self::io::read', 'app::' || r || '::' || n || '::io::read' FROM m UNION ALL SELECT n_nationkey, 'super::peer', 'app::' || r || '::peer' FROM m
UNION ALL SELECT n_nationkey, 'super::super::top', 'app::top' FROM m UNION ALL SELECT n_nationkey, 'super::super::super::up', NULL FROM m UNION ALL SELECT n_nationkey, 'std::mem', 'std::mem' FROM m""",
        "overlay_edge_survival": f"WITH {e}, {gone} SELECT kind, count(*) AS n FROM edge WHERE to_symbol NOT IN (SELECT symbol FROM gone) GROUP BY kind",
        "nearest_root": """WITH p AS (SELECT DISTINCT path FROM manifest_entry), r AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS root FROM manifest_entry WHERE regexp_extract(path, '^([^/]+/[^/]+)/', 1) <> '')
SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON starts_with(path, root || '/') GROUP BY path""",
        "graph_point_query": f"WITH {sym} SELECT * FROM sym WHERE symbol IN ({', '.join(repr(r) for r in ROOTS)})",
        "ordered_imports": """WITH RECURSIVE i AS (SELECT DISTINCT repo_id, path, source_range.start_byte AS start_byte, rule_id AS segments, kind || '/unit' AS name, coalesce(resolution = 'resolved', false) AS exported
  FROM normalized_fact WHERE source_range.start_byte IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_byte, segments, name) AS r FROM i),
l AS (SELECT a.repo_id, a.r, b.r AS link FROM n a ASOF LEFT JOIN (SELECT repo_id, name, r FROM n WHERE exported) b ON a.repo_id = b.repo_id AND a.segments = b.name AND a.r > b.r),
w AS (SELECT repo_id, r, r AS at_row, link FROM l UNION ALL SELECT w.repo_id, w.r, l.r, l.link FROM w JOIN l ON l.repo_id = w.repo_id AND l.r = w.link)
SELECT n.repo_id, n.path, n.start_byte, n.name, t.segments AS target, l.link IS NOT NULL AS through_export
FROM w JOIN n USING (repo_id, r) JOIN l USING (repo_id, r) JOIN n t ON t.repo_id = w.repo_id AND t.r = w.at_row WHERE w.link IS NULL""",
    }
