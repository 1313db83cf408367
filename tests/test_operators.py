import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.operators import budgets, coverage, diffs, evaluation, graph, normalise, ordered, syntax, validation
from lodestrata.operators import change_plan as cp
from lodestrata.operators import evidence as ev
from lodestrata.sources import configuration, generations, reports, sinks, version_control


def one(spark, column, *values, name="v", kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}").orderBy("i").select(column).collect()]


def test_text_functions(spark):
    assert one(spark, text.clean_text("v", "none", 5), " a\t\nb  c ", "", None, "\0", "abcdefgh") == ["a b c", "none", "none", "none", "abcde"]
    assert one(spark, text.bounded_text("v"), "\x01 a\tb\x85 ", None) == ["a\tb", None]
    assert one(spark, text.normalize_path("v", "/repo"), "file:///repo/a%20b", "./x\\y", "", "a+b", "/C:/z", "%zz") == ["a b", "x/y", "unknown", "a+b", "C:/z", "%zz"]
    assert one(spark, text.valid_repo_path("v"), "a/b", "/a", "a/../b", "a//b", "a\\b", "", None, "C:/x", "a" * 4097) == [True] + [False] * 8
    assert one(spark, text.shell_quote("v"), "a/b.c", "it's", "a b") == ["a/b.c", "'it'\"'\"'s'", "'a b'"]
    assert one(spark, text.group_component("v"), "a/b", "db/schema/x", "x") == ["a", "db-schema", "x"]
    assert one(spark, text.hunk_part("v", "new_count"), "@@ -1 +2 @@ f", "@@ -1,2 +3,0 @@", "@@ x") == [1, 0, None]
    odd = ["plain", 'q"uo', "t\tab", "ü/ñ", "nl\n", "bell\x07", "", None]
    assert one(spark, text.unquote_git_path(text.quote_git_path("v")), *odd) == odd
    assert one(spark, text.quote_git_path("v"), "ü") == ['"\\303\\274"']
    assert one(spark, text.utf8_truncate(4, "~")("v"), "abcd", "abü~é", "", None) == ["abcd", "abü~", "", None]
    assert one(spark, text.is_binary("v"), bytearray(b"a\0"), bytearray(b"a"), bytearray(b"x" * 9000 + b"\0"), kind="binary") == [True, False, False]
    assert one(spark, text.lossy_utf8("v"), bytearray(b"a\xff"), kind="binary") == ["a\ufffd"]


def test_identifiers(spark):
    import hashlib

    assert one(spark, ids.stable_id("n/v1", "v", F.lit("x")), "é", None) == [hashlib.sha256(f"n/v1\0{v}\0x\0".encode()).hexdigest()[:16] for v in ("é", "")]
    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in ("k".encode(), "é".encode()))).hexdigest()
    assert one(spark, ids.prefixed_digest(F.lit("k"), "v"), "é") == [want]
    assert one(spark, ids.git_blob_id("v"), bytearray(b"hi\n"), kind="binary") == ["45b983be36b73c0788dc9cbcb76cbb80fc7bb057"]


@pytest.mark.parametrize("seed", range(3))
def test_running_sums_and_budgets_agree_with_plain_loops(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]) if r.random() < 0.5 else "hot", i, r.choice([0, 1, 3, 7, 20, 60])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, cost int").repartition(5)
    want_run, want_greedy = {}, {}
    for g in {x[0] for x in rows}:
        total = used = 0
        for _, i, c in [x for x in rows if x[0] == g]:
            total += c
            want_run[i] = total
            want_greedy[i] = used + c <= 100
            used += c if used + c <= 100 else 0
    assert {x.i: x.running for x in ordered.prefix_sum(df, ["g"], ["i"], "cost").collect()} == want_run
    assert {x.i: x.accepted for x in budgets.greedy_budget(df, ["g"], ["i"], "cost", 100).collect()} == want_greedy
    assert {x.i: x.accepted for x in budgets.prefix_budget(df, ["g"], ["i"], "cost", 100).collect()} == {i: t <= 100 for i, t in want_run.items()}
    ranks = ordered.rank(df, ["g"], [F.desc("cost"), "i"]).toPandas()
    assert all(sorted(p.place) == list(range(1, len(p) + 1)) for _, p in ranks.groupby("g", dropna=False))


def test_budgets_of_nothing_and_of_high_water(spark):
    empty = spark.createDataFrame([], "g string, i int, cost int")
    assert budgets.greedy_budget(empty, ["g"], ["i"], "cost", 5).collect() == []
    df = spark.createDataFrame([("a", 3), ("a", 9), ("b", None)], "g string, o int")
    assert {r.g: (r.high_water, r.exceeded) for r in budgets.high_water(df, ["g"], "o", 5).collect()}["a"] == (5, True)
    gens = spark.createDataFrame([("r", "k1", 1, 50), ("r", "k2", 2, 50), ("r", "k3", 3, 50)], "repo string, key string, modified int, bytes int")
    assert {r.key: r.evicted for r in budgets.evict(gens, ["repo"], 1, 100).collect()} == {"k1": True, "k2": False, "k3": False}


DIFF = "diff --git a/x b/x\n+++ b/x\n@@ -1,3 +1,4 @@ f\n a\n-b\n+c\n+d\r\n e\n@@ -10,2 +11,0 @@\n-y\n-z\n\\ No newline at end of file\n+@@ -1 +1 @@ no"


def test_diffs(spark):
    df = spark.createDataFrame([(1, "r", "p", DIFF), (1, "r", "p", DIFF), (2, "r", "q", None), (3, "r", "s", "")], "split_id bigint, repo_id string, path string, diff_text string")
    lines = diffs.diff_lines(df)
    assert [(r.hunk_no, r.new_start, r.new_count) for r in diffs.hunks(lines).orderBy("hunk_no").collect()] == [(1, 1, 4), (2, 11, 0)]
    assert sorted((r.hunk_no, r.new_line) for r in diffs.added_lines(lines).collect()) == [(1, 2), (1, 3), (2, 11)]
    assert [(r.start_line, r.end_line, r.deletion_anchor) for r in diffs.changed_ranges(lines).orderBy("hunk_no").collect()] == [(1, 4, False), (11, 11, True)]
    assert {r.current_file for r in diffs.current_files(lines).where("line_no > 2 and split_id = 1").collect()} == {"x"}


def test_plan_order_and_totals_do_not_depend_on_input_order(spark):
    rows = [(i, "r", p, 1, 1, n, "M") for i, (p, n) in enumerate([("auth/a.rs", 5), ("dist/b.js", 7), ("Cargo.lock", 1), ("lib/c.rs", 90), ("db/migrations/d.sql", 3)])]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id string, path string, additions int, deletions int, diff_bytes bigint, change_status string")
    plans = []
    for part in (df, df.orderBy(F.desc("file_id")).repartition(3)):
        groups = cp.group_units(cp.classify(part, F.lit(False)), 50, 80)
        plans.append(sorted(tuple(r) for r in cp.plan(groups).select("group_id", "priority", "action").collect()))
    assert plans[0] == plans[1]
    assert {(g, p, a) for g, p, a in plans[0]} == {
        ("high-risk-auth", 2, "review"), ("high-risk-db-migrations", 2, "review"), ("consistency-dist", 3, "review"), ("consistency-lockfiles", 3, "review"), ("module-lib", 1, "split"),
    }


def test_graph_cycles_unresolved_targets_and_overlays(spark):
    e = spark.createDataFrame([("e1", "calls", "a", "b", "p1"), ("e2", "calls", "b", "c", "p2"), ("e3", "calls", "c", "a", "p3"), ("e4", "imports", "b", None, "p2"), ("e5", "calls", "d", "c", "p4")], "edge_id string, kind string, from_symbol string, to_symbol string, path string")
    roots = spark.createDataFrame([("a",), ("missing",)], "node string")
    found, nodes = graph.bfs(e, roots, 5)
    assert {r.edge_id: r.level for r in found.collect()} == {"e1": 1, "e3": 1, "e2": 2, "e4": 2, "e5": 2}
    assert {r.node: r.depth for r in nodes.collect()} == {"a": 0, "missing": 0, "b": 1, "c": 1, "d": 2}
    out, _ = graph.bfs(e, roots, 1, ("outgoing",), ("calls",))
    assert [r.edge_id for r in out.collect()] == ["e1"]
    removed = spark.createDataFrame([("c",)], "symbol string")
    new = spark.createDataFrame([("n1", "calls", "d", "x", "p4")], e.schema)
    over = {r.edge_id: (r.to_symbol, r.unresolved_target, r.origin) for r in graph.overlay(e.where("to_symbol is not null"), removed, new).collect()}
    assert over["e1"] == ("b", None, "base") and over["n1"] == ("x", None, "overlay") and "e3" not in over and "e5" not in over and "e2" not in over
    assert sorted(v for v in over.values() if v[2] == "deleted-target") == [(None, "c", "deleted-target")]
    assert {r.symbol: r.round for r in graph.reverse_dependents(e, removed, ("calls",)).collect()} == {"b": 1, "d": 1, "a": 2}
    kept, limits = graph.bounded_bfs(e, spark.createDataFrame([("c",), ("b",)], "node string"), 1, 3, 100, 2, 10**6)
    assert kept.count() == 2 and {r.code for r in limits.collect()} == {"index-query-row-budget-exhausted", "index-edge-budget-exhausted"}


def test_resolution_and_ranges(spark):
    refs = spark.createDataFrame([("s", "one"), ("s", "two"), ("s", "none"), ("s", "one")], "source string, name string")
    sym = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", "two")], "symbol string, name string")
    assert {r.name: (r.resolution, r.target) for r in graph.resolve(refs, sym).collect()} == {"one": ("resolved", "x"), "two": ("polymorphic", None), "none": ("unresolved", None)}
    inner = spark.createDataFrame([("p", 5, 6), ("p", 1, 1), ("q", 1, 2)], "path string, start_line int, end_line int")
    outer = spark.createDataFrame([("p", "wide", 1, 9), ("p", "tight", 4, 6), ("p", "edge", 6, 8)], "path string, id string, start_line int, end_line int")
    assert [(r.start_line, r.owner) for r in graph.innermost(inner, outer, ["path"]).orderBy("path", "start_line").collect()] == [(1, "wide"), (5, "tight"), (1, None)]
    assert [r.n_touching for r in graph.overlapping(inner, outer, ["path"]).orderBy("path", "start_line").collect()] == [1, 3, 0]


@pytest.mark.parametrize("seed", range(3))
def test_ordered_imports_agree_with_a_loop(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(6)]
    rows = [(r.choice("xy"), f"p{i:03d}", i, r.choice(names), r.choice(names), r.random() < 0.6) for i in range(60)]
    got = {(x.repo_id, x.start_byte): (x.target, x.through_export) for x in graph.ordered_imports(spark.createDataFrame(rows, "repo_id string, path string, start_byte bigint, segments string, name string, exported boolean").repartition(4)).collect()}
    want = {}
    for repo in "xy":
        seen = {}
        for _, _, at, segments, name, exported in sorted(x for x in rows if x[0] == repo):
            target = seen.get(segments, segments)
            want[repo, at] = (target, segments in seen)
            if exported:
                seen[name] = target
    assert got == want


def test_evidence_precedence_and_counts(spark):
    f = spark.createDataFrame(
        [("r", "t", "x", "m", "p", 3, 3, "note", "low", "unknown", "unknown", False, "b"), ("r", "t", "x", "m", "p", 3, 3, "error", "high", "security", "existing", True, "a"), ("r", "t", "x", "m", "q", None, None, "error", "high", "style", "new", True, "a")],
        "repo_id string, tool string, rule_id string, message string, path string, start_line int, end_line int, severity string, confidence string, category string, baseline_state string, completed boolean, report_id string",
    )
    u = spark.createDataFrame([("r", "p", "file:p", [(2, 4)])], "repo_id string, path string, unit_id string, added array<struct<start_line:int,end_line:int>>")
    a = {x.path: x for x in ev.assess(ev.merge(f), u).collect()}
    assert (a["p"].severity, a["p"].category, a["p"].baseline_state, a["p"].report_ids, a["p"].disposition) == ("error", "security", "new", ["a", "b"], "blocking-candidate")
    assert a["q"].disposition == "outside-scope"
    c = ev.counts(f, ev.assess(ev.merge(f), u)).collect()[0]
    assert (c.input_findings, c.deduplicated_findings, c.blocking_candidates, c.outside_scope) == (3, 2, 1, 1)
    again = ev.merge(ev.merge(f).withColumn("report_id", F.element_at("report_ids", 1)).drop("report_ids"))
    assert again.drop("report_ids").exceptAll(ev.merge(f).drop("report_ids")).count() == 0


def test_normalised_duplicates_keep_the_best(spark):
    df = spark.createDataFrame([("i", "low", "b"), ("i", "high", "c"), ("i", "high", "a"), ("j", None, None)], "id string, confidence string, t string")
    assert {r.id: r.t for r in normalise.keep_best(df, "id", ["t"]).collect()} == {"i": "a", "j": None}
    assert {r.id: r.t for r in normalise.first_wins(df.where("t is not null"), "id", ["t"]).collect()} == {"i": "a"}


def test_ledger_and_verdict(spark):
    m = spark.createDataFrame([("r", "u1", "high"), ("r", "u2", "low"), ("s", "u3", "low")], "repo_id string, unit_id string, risk string")
    led = spark.createDataFrame([("r", "u1", "reviewed", "f", None), ("r", "u2", "pending", "f", None), ("r", "u9", "odd", "f", None), ("s", "u3", "needs-split", "f", None), ("s", "u3", "reviewed", "g", None)], "repo_id string, unit_id string, state string, fingerprint string, parent_unit string")
    assert {(r.unit_id, r.issue) for r in coverage.ledger_issues(m, led).collect()} == {("u9", "not-in-manifest"), ("u9", "unknown-state"), ("u3", "several-states"), ("u3", "mixed-fingerprints")}
    assert {r.unit_id for r in coverage.split_issues(led).collect()} == {"u3"}
    gaps = {r.repo_id: r.gap for r in coverage.coverage_gap(m, led).collect()}
    assert gaps == {"r": "non-material", "s": "empty"}
    none = spark.createDataFrame([], "repo_id string, disposition string")
    assert {r.repo_id: r.verdict for r in coverage.verdicts(none, coverage.coverage_gap(m, led)).collect()} == {"r": "WITH_NOTES", "s": "SAFE"}


def test_violations(spark):
    e = spark.createDataFrame([("1", "a", "b", None, "high"), ("1", "a", None, None, "odd"), ("2", "z", "b", "b", "low")], "edge_id string, from_symbol string, to_symbol string, unresolved_target string, confidence string")
    s = spark.createDataFrame([("a",), ("b",)], "symbol string")
    assert sorted(tuple(r) for r in validation.edge_contract(e, s).collect()) == [("edge-confidence", "1"), ("edge-id-unique", "1"), ("edge-source-known", "z"), ("edge-target-xor", "1"), ("edge-target-xor", "2")]
    t = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("h", 1, "a"), ("h", 2, "b")], "g string, place int, k string")
    assert [r.ref for r in validation.unsorted(t, "g", "place", "k", "sorted").collect()] == ["g"]


def test_percentiles_and_gates(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 21)] + [("b", 7), ("b", None), ("c", None)], "g string, v int")
    assert {r.g: (r.p50, r.p95, r.n) for r in evaluation.nearest_rank(df, ["g"], "v", (50, 95)).collect()} == {"a": (10, 19, 20), "b": (7, 7, 1)}
    assert one(spark, evaluation.gate_limit("v"), 100, 101, 0, kind="bigint") == [375, 377, 250]


def test_decoders(spark):
    raw = spark.createDataFrame([("s", "M\0a\0R100\0old\0new\0A\0b c\0D"), ("t", ""), ("u", None)], "source string, raw string")
    assert [(r.status, r.path, r.old_path) for r in version_control.name_status(raw).orderBy("ordinal").collect()] == [("M", "a", None), ("R100", "new", "old"), ("A", "b c", None)]
    raw = spark.createDataFrame([("s", "1\t2\ta\0-\t-\t\0old\0new\0")], "source string, raw string")
    assert [(r["add"], r["del"], r.path, r.old_path) for r in version_control.numstat(raw).orderBy("ordinal").collect()] == [("1", "2", "a", None), ("-", "-", "new", "old")]
    tree = spark.createDataFrame([("100644 blob abc\tx y",), ("100644 def 2\tz",), ("junk",)], "value string")
    assert [(r.path, r.unmerged) for r in version_control.tree_listing(tree).orderBy("path").collect()] == [("x y", False), ("z", True)]


def test_rule_files_and_packages(spark):
    rules, problems = configuration.regex_rules(["# c", "", "a+", "(", "x" * 501, *["b"] * 40])
    assert len(rules) == 32 and {p[1].split(":")[0] for p in problems} == {"invalid-pattern", "pattern-too-long", "too-many-patterns"}
    lines = spark.createDataFrame([(0, "id\tp\tc\tk\te\thigh\thint\twith tab"), (1, "# no"), (2, "too\tfew")], "ord int, value string")
    assert [(r.rule_id, r.hint) for r in configuration.test_hints(lines).collect()] == [("id", "hint\twith tab")]
    files = spark.createDataFrame([("a/Cargo.toml", "completed", '[package]\nname = "x-y"\n[[bin]]\nname = "b"\npath = "m.rs"\n[workspace]\nmembers = ["c"]'), ("bad", "completed", "["), ("no", "skipped", "[")], "path string, status string, text string")
    assert sorted((r.target_kind, r.target_name or r.workspace_member) for r in configuration.packages(files).collect()) == [("bin", "b"), ("invalid", None), ("lib", "x_y"), ("member", "a/c")]


def test_syntax_on_a_fixture(spark):
    code = "use a::{b, c::{self, d as e}, f::*};\npub use g::h;\npub(crate) async fn run(x: u8) {\n  // call(1)\n  helper(vec![1]);\n  print!(\"x\");\n}\nstruct S;"
    files = spark.createDataFrame([(1, "x.rs", code), (2, "x.py", code), (3, "y.rs", "")], "file_id bigint, path string, text string")
    assert [(r.kind, r.name, r.visibility) for r in syntax.symbols(files).orderBy("line_no").collect()] == [("fn", "run", "pub(crate)"), ("struct", "S", None)]
    assert sorted((r.name, r.is_macro) for r in syntax.calls(files).collect()) == [("helper", False), ("print", True)]
    assert sorted((r.target, r.name, r.is_glob, r.exported) for r in syntax.imports(files).collect()) == [("a::b", "b", False, False), ("a::c", "c", False, False), ("a::c::d", "e", False, False), ("a::f", "*", True, False), ("g::h", "h", False, True)]
    roots = spark.createDataFrame([("app", "lib.rs")], "crate string, file string")
    decl = spark.createDataFrame([("lib.rs", "a", "a.rs"), ("a.rs", "b", "b.rs"), ("b.rs", "again", "lib.rs")], "file string, name string, target_file string")
    assert {r.module_path for r in syntax.module_tree(roots, decl).collect()} == {"app", "app::a", "app::a::b"}


def test_sarif_and_findings(spark):
    sarif = """{"version":"2.1.0","runs":[{"tool":{"driver":{"name":" T ","rules":[{"id":"r0","properties":{"tags":["security"],"precision":"high"},"defaultConfiguration":{"level":"warning"}}]}},
      "invocations":[{"executionSuccessful":false}],"results":[{"ruleId":"r0","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file://./a%20b"},"region":{"startLine":3}}}]},
      {"ruleIndex":0,"message":{"text":"n"},"baselineState":"absent"},{"ruleIndex":0,"level":"error","message":{"text":"k"}}]}]}"""
    fixed = '{"schema_version":1,"tool":{"name":"U"},"status":"completed","findings":[{"rule_id":"x","message":"q","path":"./p","start_line":1,"severity":"HIGH","confidence":"moderate"}]}'
    df = spark.createDataFrame([("s", sarif), ("f", fixed), ("z", "{}"), ("n", None)], "report_id string, payload string")
    found, told = reports.read_reports(df)
    rows = {r.message: r for r in found.collect()}
    assert set(rows) == {"m", "k", "q"}
    assert (rows["m"].path, rows["m"].severity, rows["m"].confidence, rows["m"].category, rows["m"].completed, rows["m"].end_line) == ("a b", "warning", "high", "security", False, 3)
    assert (rows["k"].severity, rows["k"].rule_id, rows["q"].severity, rows["q"].confidence) == ("error", "result-2", "error", "medium")
    assert {r.report_id: r.format for r in told.collect()} == {"s": "sarif", "f": "findings", "z": "unknown", "n": "unknown"}


def test_generations_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    root, key = str(tmp_path / "g"), generations.generation_key(1, ["x"])
    assert generations.publish({"t": df}, root, key) == "published"
    assert generations.publish({"t": df.limit(1)}, root, key) == "reused"
    assert generations.read(spark, root, key, "t").count() == 2
    assert [r.matches for r in generations.reconcile(spark, root, key).collect()] == [True]
    assert generations.root_hash(df, ["id", "v"]).collect() == generations.root_hash(df.orderBy(F.desc("id")), ["id", "v"]).collect()
    assert generations.root_hash(df.limit(0), ["id"]).collect()[0].rows is None
    found = spark.createDataFrame([("k2", 2), ("k1", 2), ("w", 0)], "generation_key string, completeness int")
    assert generations.locate(found, "w").first().generation_key == "w" and generations.locate(found, "?").first().generation_key == "k1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb|c"), (2, None)], "id int, v string")
    sinks.write_tsv(df, str(tmp_path / "t"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert "1\ta b|c" in [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sinks.markdown_rows(df).first().line == "| 1 | a b\\|c |" and sinks.markdown_header(df).endswith("---|---|")


def test_evidence_stream(spark, tmp_path):
    from lodestrata.streaming import evidence as stream

    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "t", "x", "p", 1, "note", "low"), ("a", "t", "x", "p", 1, "note", "low"), ("b", "t", "x", "p", 1, "error", "high")]
    pd.DataFrame([(*r, "2025-01-01T00:00:00Z") for r in rows], columns=[c.split()[0] for c in stream.REPORT.split(", ")]).to_json(src / "1.json", orient="records", lines=True)
    q = stream.start(stream.merge_stream(stream.read_findings(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("severity", "confidence", "reports").distinct().collect()
    assert [tuple(r) for r in got] == [("error", "high", 2)]


def test_root_of_many_rows_in_bounded_blocks(spark):
    df = spark.range(0, 30_000).selectExpr("id", "id % 7 as v")
    roots = [generations.root_hash(x, ["id", "v"], most=20).first() for x in (df, df.orderBy(F.desc("id")).repartition(7))]  # 3,000 blocks and more, in two levels
    assert roots[0] == roots[1] and roots[0].rows == 30_000
    others = [df.where("id <> 5"), df.unionByName(df.where("id = 5")), df.withColumn("v", F.when(F.col("id") == 5, 9).otherwise(F.col("v")))]
    assert len({roots[0].root, *[generations.root_hash(x, ["id", "v"], most=20).first().root for x in others]}) == 4
