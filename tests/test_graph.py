"""Graph operators against plain loops and on data that tells places apart."""

import json
import random

import pytest

from lodestrata.operators import budgets, graph, ordered, syntax, validation

EDGE = "edge_id string, kind string, from_symbol string, to_symbol string"


def walk(edges, roots, depth, max_rows, max_nodes, max_edges, max_bytes, most):
    """The traversal as a plain loop."""
    seen, codes, frontier = [], set(), []
    for r in sorted(set(roots)):
        if len(seen) >= max_nodes:
            codes.add("index-node-budget-exhausted")
            break
        seen.append(r)
        frontier.append(r)
    rows, out, used, level, halted = 0, {}, 0, 0, False
    while frontier and level < depth and not halted:
        level += 1
        found = []
        for node in sorted(frontier):
            for d in (0, 1):
                left = max_rows - rows
                limit = min(left, most)
                got = sorted((e for e in edges if e[2 + d] == node), key=lambda e: (e[1], e[0]))[:limit]
                rows += len(got)
                if len(got) == limit and got or left == 0 and any(e[2 + d] == node for e in edges):
                    codes.add("index-query-row-budget-exhausted" if left <= most else "index-query-row-limit-reached")
                    halted = True
                for e in sorted(got, key=lambda e: e[0]):
                    if e[0] not in out:
                        size = len(json.dumps(dict(zip(("edge_id", "kind", "from_symbol", "to_symbol"), e)), separators=(",", ":")))
                        if len(out) >= max_edges:
                            codes.add("index-edge-budget-exhausted")
                        elif used + size > max_bytes:
                            codes.add("index-output-byte-budget-exhausted")
                        else:
                            out[e[0]] = level
                            used += size
                    found.append(e[3 - d])
                if halted:
                    break
            if halted:
                break
        frontier = []
        for n in found:
            if n is not None and n not in seen:
                if len(seen) >= max_nodes:
                    codes.add("index-node-budget-exhausted")
                else:
                    seen.append(n)
                    frontier.append(n)
    if frontier and not halted:
        codes.add("index-graph-depth-budget-exhausted")
    return out, codes


@pytest.mark.parametrize("budget", [
    (3, 10**6, 10**6, 10**6, 10**9, 10**6), (2, 25, 100, 100, 10**9, 10**6), (3, 200, 9, 100, 10**9, 10**6), (3, 200, 100, 12, 10**9, 10**6), (2, 200, 100, 100, 900, 10**6), (3, 10**6, 10**6, 10**6, 10**9, 4), (1, 10**6, 2, 10**6, 10**9, 10**6),
])
def test_budgets_of_traversal_are_those_of_a_plain_loop(spark, budget):
    r = random.Random(sum(budget))
    edges = [(f"e{i:03d}{'x' * r.randint(0, 9)}", r.choice(["calls", "imports"]), f"n{r.randint(0, 14)}", r.choice([f"n{r.randint(0, 14)}", "n3", "n3", None])) for i in range(60)]
    roots = ["n3", "n7", "absent"]
    kept, limits = graph.bounded_bfs(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in [*roots, "n3", None]], "node string"), *budget)
    want, codes = walk(edges, roots, *budget)
    assert {x.edge_id: x.level for x in kept.collect()} == want and {x.code for x in limits.collect()} == codes


def test_closures_and_module_trees_of_any_depth(spark):
    chain = [(f"e{i}", "calls", f"n{i + 1}", f"n{i}") for i in range(45)] + [("back", "calls", "n0", "n45")]
    rows = graph.reverse_dependents(spark.createDataFrame(chain, EDGE), spark.createDataFrame([("n0",)], "symbol string"), ("calls",)).collect()
    assert {x.symbol: x["round"] for x in rows} == {f"n{i}": i for i in range(1, 46)}
    files = [(f"f{i}", f"m{i}", f"f{i + 1}") for i in range(20)] + [("f20", "ring", "f0")]
    tree = syntax.module_tree(spark.createDataFrame([("c", "f0")], "crate string, file string"), spark.createDataFrame(files, "file string, name string, target_file string")).collect()
    assert len(tree) == 21 and max(x.module_path.count("::") for x in tree) == 20


PLACED = EDGE + ", path string, start_line int, end_line int"


def test_one_retargeted_edge_leaves_the_other_broken_ones(spark):
    base = spark.createDataFrame([("a", "calls", "f", "gone", "p", 1, 1), ("b", "calls", "f", "gone", "p", 2, 2), ("c", "calls", "f", "kept", "p", 3, 3), ("d", "calls", "f", "gone", "p", None, None), ("e", "calls", "f", "gone", "p", 5, 5)], PLACED)
    new = spark.createDataFrame([("r", "calls", "f", "other", "p", 1, 1), ("s", "calls", "f", "other", "p", None, None), ("t", "calls", "f", "gone", "p", 5, 5)], PLACED)
    rows = graph.overlay(base, spark.createDataFrame([("gone",)], "symbol string"), new).collect()
    assert sorted((x.start_line, x.unresolved_target) for x in rows if x.origin == "deleted-target") == [(2, "gone"), (5, "gone")]
    assert {x.edge_id for x in rows if x.origin == "overlay"} == {"r", "s", "t"} and {x.edge_id for x in rows if x.origin == "base"} == {"c"}


def test_edges_survive_by_place_and_callee(spark):
    kinds = PLACED + ", callee string"
    base = spark.createDataFrame([("a", "calls", "f", "g", "p", 1, 1, "g"), ("b", "calls", "f", "h", "p", 2, 2, "h"), ("c", "calls", "f", "i", "p", 3, 3, "i"), ("d", "defines", "f", "g", "p", 1, 1, "g"), ("e", "calls", "f", None, "p", 4, None, None)], kinds)
    facts = spark.createDataFrame([("p", "calls", 1, 1, "g"), ("p", "calls", 2, 2, "other"), ("p", "defines", 1, 1, "g"), ("p", "calls", 4, None, None)], "path string, kind string, start_line int, end_line int, callee string")
    assert sorted(x.edge_id for x in graph.surviving_edges(base, facts).collect()) == ["a", "e"]


def test_calls_resolve_in_scope_order(spark):
    names = spark.createDataFrame([("s", "f", "glob", 2), ("s", "f", "local", 1), ("s", "g", "a", 2), ("s", "g", "b", 2), ("s", "h", "only", 3), (None, "f", "top", 1)], "scope string, name string, symbol string, tier int")
    calls = spark.createDataFrame([("x", "f", "s", False), ("x", "g", "s", None), ("x", "h", "s", True), ("x", "i", "s", False), ("x", "f", None, False), ("x", None, "s", False), ("x", "f", "s", False)], "source string, name string, scope string, is_method boolean")
    rows = sorted((x.name or "", x.kind, x.resolution, x.target or "") for x in graph.call_edges(calls, names).collect())
    assert rows == [("", "calls", "unresolved", ""), ("f", "calls", "resolved", "local"), ("f", "calls", "resolved", "top"), ("f", "references", "resolved", "local"), ("f", "references", "resolved", "top"), ("g", "calls", "polymorphic", ""), ("h", "calls", "polymorphic", ""), ("i", "calls", "unresolved", "")]


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_greedy_budgets_of_small_and_large_groups(spark, fold_rows):
    r = random.Random(9)
    rows = [(g, i, r.choice([None, 0, 1, 7, 40, 95, 200])) for g in ("a", "hot", None) for i in range(120 if g == "hot" else 25)]
    got = budgets.greedy_budget(spark.createDataFrame(rows, "g string, i int, cost bigint"), ["g"], ["i"], "cost", 100, fold_rows).collect()
    want = {}
    for g in ("a", "hot", None):
        used = 0
        for _, i, c in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            want[g, i] = used + (c or 0) <= 100
            used += (c or 0) if want[g, i] else 0
    assert {(x.g, x.i): x.accepted for x in got} == want and len(got) == len(rows)


def test_rows_before_and_last_values_across_parts(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice([None, f"v{i}"])) for g in ("a", "hot", None) for i in range(200 if g == "hot" else 9)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    last, before = {}, {}
    for g in ("a", "hot", None):
        kept = old = None
        for _, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            kept = v or kept
            last[g, i], before[g, i], old = kept, old, v
    assert {(x.g, x.i): x["last"] for x in ordered.last_before(df, ["g"], ["i"], "v").collect()} == last
    assert {(x.g, x.i): x.before for x in ordered.before_in_order(df, ["g"], ["i"], "v").collect()} == before
    bad = validation.unsorted(spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), ("b", 1, "x"), ("b", 2, "y")], "by string, place int, key string"), "by", "place", "key", "r")
    assert [x.ref for x in bad.collect()] == ["a"]
    assert ordered.last_before(df.limit(0), ["g"], ["i"], "v").collect() == []
