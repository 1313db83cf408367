"""Relationship graphs: bounded traversal, overlays, endpoints, resolution and ordered folds.

Traversal unrolls one pair of equi-joins per level. The frontier of a level is
distinct and free of nodes already visited; edges are scanned in place and never
shuffled while the frontier is checked to be small enough to broadcast.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.lineage import cut, rows_at_most, small
from lodestrata.operators.ordered import last_before, prefix_sum

def bfs(edges: DataFrame, roots: DataFrame, depth: int, directions: tuple[str, ...] = ("incoming", "outgoing"), kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(edges with their least level, nodes with their depth) within ``depth`` steps of the roots.

    Edges without ``to_symbol`` are reported and lead nowhere. Roots that have no
    edges are nodes of depth 0.
    """
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    nodes = cut(roots.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    frontier, found = nodes.select("node"), []
    for level in range(1, depth + 1):
        held = small(frontier)
        steps = []
        if "outgoing" in directions:
            steps.append(edges.join(held, edges.from_symbol == held.node).select(*edges.columns, F.col("to_symbol").alias("next")))
        if "incoming" in directions:
            steps.append(edges.join(held, edges.to_symbol == held.node).select(*edges.columns, F.col("from_symbol").alias("next")))
        step = cut(reduce(DataFrame.unionByName, steps).withColumn("level", F.lit(level)))
        found.append(step.drop("next"))
        new = step.where("next is not null").select(F.col("next").alias("node")).distinct().join(nodes, "node", "left_anti")
        frontier = cut(new)
        nodes = nodes.unionByName(frontier.withColumn("depth", F.lit(level)))
        if not frontier.head(1):
            break
    union = reduce(DataFrame.unionByName, found)
    return union.groupBy(*edges.columns).agg(F.min("level").alias("level")), nodes


def bounded_bfs(
    edges: DataFrame, roots: DataFrame, depth: int, max_rows: int, max_nodes: int, max_edges: int, max_bytes: int, most_per_lookup: int | None = None, directions: tuple[str, ...] = ("outgoing", "incoming"),
) -> tuple[DataFrame, DataFrame]:
    """A traversal of several levels within budgets: (edges kept with their level, limitation codes).

    Lookups (node, direction) are taken by node and in the order of ``directions``; one reads edges in (kind, edge_id)
    order. The lookup that uses up ``max_rows``, or returns ``most_per_lookup`` edges, ends the traversal. Edges read
    lead to at most ``max_nodes`` nodes in all, roots included, and at most ``max_edges`` of them are kept, each only
    while it fits into ``max_bytes`` (of its JSON form); both in the order of level, node, direction and edge_id. Each
    budget that left something out is told by its code, as is a frontier left at the last level.

    Lookups are counted before edges are fetched, so a hub costs a count; what is read is bounded by ``max_rows``.
    """
    body = F.octet_length(F.to_json(F.struct(*edges.columns), {"ignoreNullFields": "false"}))
    start = roots.select("node").where("node is not null").distinct()
    seen = cut(start.orderBy("node").limit(max_nodes))
    codes = {"index-node-budget-exhausted"} if not rows_at_most(start, max_nodes) else set()
    n_seen, rows_read, frontier, read = seen.count(), 0, seen, []
    for level in range(1, depth + 1):
        if not frontier.head(1):
            break
        held = small(frontier)
        ends = {"outgoing": ("from_symbol", "to_symbol"), "incoming": ("to_symbol", "from_symbol")}
        sides = [
            edges.join(held, edges[ends[d][0]] == held.node).select("node", F.lit(i).alias("turn"), F.col(ends[d][1]).alias("next"), body.alias("bytes"), *[c for c in edges.columns])
            for i, d in enumerate(directions)
        ]
        found = reduce(DataFrame.unionByName, sides)
        lookups = prefix_sum(found.groupBy("node", "turn").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], ["node", "turn"], "n", "upto")
        room = F.lit(max_rows - rows_read) - (F.col("upto") - F.col("n"))
        most = F.least(room, F.lit(most_per_lookup if most_per_lookup is not None else max_rows))
        lookups = cut(lookups.withColumn("most", most).withColumn("by_rows", room <= (most_per_lookup if most_per_lookup is not None else max_rows)))
        halt = lookups.where("n >= most").orderBy("node", "turn").select("node", "turn", "most", "by_rows").head(1)
        if halt:
            h = halt[0]
            codes.add("index-query-row-budget-exhausted" if h.by_rows else "index-query-row-limit-reached")
            at = (F.col("node") == h.node) & (F.col("turn") == h.turn)
            before = (F.col("node") < h.node) | (F.col("node") == h.node) & (F.col("turn") < h.turn)
            step = found.where(before).unionByName(found.where(at).orderBy("kind", "edge_id").limit(max(0, h.most)))
        else:
            step = found
        step = cut(step.withColumn("level", F.lit(level)))
        read.append(step)
        order = F.struct("node", "turn", "edge_id")
        new = step.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.min(order).alias("first")).join(seen, "node", "left_anti")
        if not rows_at_most(new, max_nodes - n_seen):
            codes.add("index-node-budget-exhausted")
        frontier = cut(new.orderBy("first").limit(max(0, max_nodes - n_seen)).select("node"))
        seen = cut(seen.unionByName(frontier))
        n_seen += frontier.count()
        rows_read += step.count()
        if halt:
            break
    else:
        if frontier.head(1):
            codes.add("index-graph-depth-budget-exhausted")
    spark = edges.sparkSession
    if not read:
        return edges.where(F.lit(False)).withColumn("level", F.lit(0)), _codes(spark, codes)
    whole = reduce(DataFrame.unionByName, read)
    place = F.struct("level", "node", "turn", "edge_id")
    once = whole.groupBy("edge_id").agg(F.min(place).alias("place"), F.first("bytes").alias("bytes"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:  # at most max_rows rows
        pdf = pdf.sort_values(["level", "node", "turn", "edge_id"], kind="stable")
        kept, used, why = 0, 0, []
        for size in pdf["bytes"]:
            if kept >= max_edges:
                why.append("index-edge-budget-exhausted")
            elif used + size > max_bytes:
                why.append("index-output-byte-budget-exhausted")
            else:
                kept, used = kept + 1, used + size
                why.append("")
        return pdf.assign(why=why)[["edge_id", "level", "why"]]

    judged = cut(once.select("edge_id", "place.level", "place.node", "place.turn", "bytes", F.lit(0).alias("all")).groupBy("all").applyInPandas(fold, "edge_id string, level int, why string"))
    codes |= {r.why for r in judged.where("why <> ''").select("why").distinct().collect()}
    columns = whole.select(*edges.columns).dropDuplicates(["edge_id"])
    return columns.join(judged.where("why = ''").select("edge_id", "level"), "edge_id").select(*edges.columns, "level"), _codes(spark, codes)


def _codes(spark, codes: set[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in sorted(codes)], "code string")


PLACE = ("path", "kind", "start_line", "end_line")


def _placed(edges: DataFrame) -> DataFrame:
    """Edges with a range, missing where they have none."""
    return edges.withColumns({c: F.lit(None).cast("int") for c in ("start_line", "end_line") if c not in edges.columns})


def overlay(base: DataFrame, removed: DataFrame, replacement: DataFrame) -> DataFrame:
    """Base edges after a change.

    Edges that start in a removed symbol go; those that end in one become
    unresolved with low confidence and a new id, unless the change retargets the
    same place (path, kind and range) elsewhere; edges of the change come on top.
    A missing line of a range is equal to a missing one.
    """
    base, replacement = _placed(base), _placed(replacement)
    gone = removed.select(F.col("symbol").alias("gone")).distinct()
    kept = base.join(gone, base.from_symbol == gone.gone, "left_anti").join(replacement.select("edge_id"), "edge_id", "left_anti")
    broken = kept.join(gone, kept.to_symbol == gone.gone, "left_semi")
    elsewhere = replacement.where("to_symbol is not null").select(*[F.col(c).alias(f"r_{c}") for c in PLACE], F.col("to_symbol").alias("r_to")).distinct()
    same = broken.to_symbol != elsewhere.r_to
    for c in PLACE:
        same = same & broken[c].eqNullSafe(elsewhere[f"r_{c}"])
    orphan = broken.join(elsewhere, same, "left_anti")
    new_id = ids.prefixed_digest(F.lit("repository-overlay-deleted-target/v1"), "edge_id", "to_symbol")
    unresolved = orphan.select(
        new_id.alias("edge_id"), "kind", "from_symbol", F.lit(None).cast("string").alias("to_symbol"), F.col("to_symbol").alias("unresolved_target"), *[c for c in PLACE if c != "kind"],
        F.lit("unresolved").alias("resolution"), F.lit("low").alias("confidence"), F.lit("deleted-target").alias("origin"),
    )
    intact = kept.join(gone, kept.to_symbol == gone.gone, "left_anti")
    plain = lambda df, origin: df.select("edge_id", "kind", "from_symbol", "to_symbol", F.lit(None).cast("string").alias("unresolved_target"), *[c for c in PLACE if c != "kind"], F.lit("resolved").alias("resolution"), F.lit("high").alias("confidence"), F.lit(origin).alias("origin"))
    return plain(intact, "base").unionByName(unresolved).unionByName(plain(replacement, "overlay"))


def reverse_dependents(edges: DataFrame, changed: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(symbol, round): symbols that depend on changed ones, directly or through others; a fixpoint over incoming edges."""
    uses = edges.where(F.col("kind").isin(*kinds)).select("from_symbol", "to_symbol")
    known = cut(changed.select("symbol", F.lit(0).alias("round")).distinct())
    frontier, turn = known.select("symbol"), 0
    while True:  # each round knows at least one more symbol, so it ends
        turn += 1
        held = small(frontier)
        new = uses.join(held, uses.to_symbol == held.symbol, "left_semi").select(F.col("from_symbol").alias("symbol")).distinct()
        frontier = cut(new.join(known, "symbol", "left_anti"))
        if not frontier.head(1):
            break
        known = known.unionByName(frontier.withColumn("round", F.lit(turn)))
        known = cut(known) if turn % 16 == 0 else known
    return known.where("round > 0")


def with_endpoints(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose source is a known symbol and whose target is one or is missing."""
    s = symbols.select("symbol").distinct()
    from_known = edges.join(s, edges.from_symbol == s.symbol, "left_semi")
    return from_known.where("to_symbol is null").unionByName(from_known.join(s, from_known.to_symbol == s.symbol, "left_semi"))


def endpoint_names(edges: DataFrame, first: DataFrame, then: DataFrame) -> DataFrame:
    """(edge_id, from_name, to_name): names looked up in ``first``, else in ``then``."""
    a = first.select(F.col("symbol"), F.col("name").alias("n1"))
    b = then.select(F.col("symbol"), F.col("name").alias("n2"))
    names = a.join(b, "symbol", "full_outer").select("symbol", F.coalesce("n1", "n2").alias("name"))
    f = names.select(F.col("symbol").alias("from_symbol"), F.col("name").alias("from_name"))
    t = names.select(F.col("symbol").alias("to_symbol"), F.col("name").alias("to_name"))
    return edges.join(f, "from_symbol", "left").join(t, "to_symbol", "left").select("edge_id", "from_name", "to_name")


def change_roles(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(symbol, incoming, outgoing, reverse_imports): edges of changed symbols by role, as three equi-joins."""
    c = changed.select("symbol").distinct()
    into = edges.where("kind <> 'imports'").join(c, edges.to_symbol == c.symbol).select("symbol", F.lit("incoming").alias("role"))
    out = edges.join(c, edges.from_symbol == c.symbol).select("symbol", F.lit("outgoing").alias("role"))
    back = edges.where("kind = 'imports'").join(c, edges.to_symbol == c.symbol).select("symbol", F.lit("reverse").alias("role"))
    n = into.unionByName(out).unionByName(back).groupBy("symbol").agg(*[F.count_if(F.col("role") == r).alias(a) for r, a in (("incoming", "incoming"), ("outgoing", "outgoing"), ("reverse", "reverse_imports"))])
    return c.join(n, "symbol", "left").select("symbol", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("incoming", "outgoing", "reverse_imports")])


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, name, candidates, resolution, target): one candidate resolves, several are polymorphic, none is unresolved.

    Candidates are counted per name before the join, so that a hot name meets one row.
    """
    per = symbols.groupBy("name").agg(F.countDistinct("symbol").alias("candidates"), F.min("symbol").alias("only"))
    j = references.select("source", "name").distinct().join(per, "name", "left")
    n = F.coalesce("candidates", F.lit(0))
    resolution = F.when(n == 1, "resolved").when(n > 1, "polymorphic").otherwise("unresolved")
    return j.select("source", "name", n.alias("candidates"), resolution.alias("resolution"), F.when(n == 1, F.col("only")).alias("target"))


def replacements(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_symbol, new_symbol, tier): by local id, else by (name, kind) if exactly one new symbol has it."""
    o = old.select(F.col("symbol").alias("old_symbol"), "local_id", "name", "kind")
    exact = new.select("local_id", F.col("symbol").alias("exact"))
    unique = new.groupBy("name", "kind").agg(F.count("*").alias("n"), F.min("symbol").alias("named")).where("n = 1").drop("n")
    j = o.join(exact, "local_id", "left").join(unique, ["name", "kind"], "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("named").isNotNull(), "unique-name").otherwise("none")
    return j.select("old_symbol", F.coalesce("exact", "named").alias("new_symbol"), tier.alias("tier"))


def rewrite_targets(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with their targets sent through the replacement map; targets without one stay."""
    m = mapping.where("new_symbol is not null").select(F.col("old_symbol").alias("to_symbol"), "new_symbol")
    return edges.join(m, "to_symbol", "left").withColumn("to_symbol", F.coalesce("new_symbol", "to_symbol")).drop("new_symbol").select(*edges.columns)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with the number of ``right`` ranges on the same keys that touch theirs; bounds are inclusive.

    The ranges of a key are gathered as one array per key and tested in the row,
    so no pair of ranges is ever shuffled.
    """
    spans = right.groupBy(*keys).agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    j = left.join(spans, keys, "left")
    n = F.size(F.filter(F.coalesce("spans", F.array().cast("array<struct<start_line:int,end_line:int>>")), lambda r: (r["start_line"] <= F.col("end_line")) & (r["end_line"] >= F.col("start_line"))))
    return j.withColumn("n_touching", n).drop("spans")


def innermost(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """``inner`` with ``owner``: the narrowest range of ``outer`` on the same keys that contains it; ties by id."""
    spans = outer.groupBy(*keys).agg(F.collect_list(F.struct((F.col("end_line") - F.col("start_line")).alias("width"), "id", "start_line", "end_line")).alias("spans"))
    j = inner.join(spans, keys, "left")
    around = F.filter(F.col("spans"), lambda r: (r["start_line"] <= F.col("start_line")) & (r["end_line"] >= F.col("end_line")))
    return j.withColumn("owner", F.array_min(around)["id"]).drop("spans")


def glob_ambiguity(imports: DataFrame) -> DataFrame:
    """(module, globs): modules with more than one glob import."""
    return imports.where("glob").groupBy("module").agg(F.countDistinct("target").alias("globs")).where("globs > 1")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """(module, symbol): the first of each module by start, then id."""
    return symbols.groupBy("module").agg(F.min(F.struct("start", "symbol")).alias("f")).select("module", F.col("f.symbol").alias("symbol"))


def owner_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, logical_path): names of owners joined with ``::`` from the root, found by ``depth`` joins to the parent."""
    parents = nodes.select(F.col("node").alias("p"), F.col("parent").alias("next"), F.col("name").alias("p_name"))
    walk = nodes.select("node", F.col("parent").alias("at"), F.col("name").alias("logical_path"))
    for _ in range(depth):
        j = walk.join(parents, walk.at == parents.p, "left")
        walk = j.select("node", F.col("next").alias("at"), F.when(F.col("p_name").isNull(), F.col("logical_path")).otherwise(F.concat_ws("::", "p_name", "logical_path")).alias("logical_path"))
    return walk.select("node", "logical_path")


def expand_path(path: str, module: str):
    """Absolute segments of a ``crate``/``self``/``super`` relative path within a module path, both joined with ``::``."""
    parts, base = F.split(path, "::"), F.split(module, "::")
    ups = F.size(F.filter(parts, lambda s: s == "super"))
    rest = F.filter(parts, lambda s: ~s.isin("crate", "self", "super"))
    head = F.element_at(parts, 1)
    absolute = (
        F.when(head == "crate", F.concat(F.slice(base, 1, 1), rest)).when(head == "self", F.concat(base, rest))
        .when(head == "super", F.when(ups < F.size(base), F.concat(F.slice(base, F.lit(1), F.size(base) - ups), rest))).otherwise(parts)
    )
    return F.array_join(absolute, "::")


def ordered_imports(imports: DataFrame) -> DataFrame:
    """Bindings per repository in the order (path, start_byte, segments): an export shows to later imports only.

    ``imports``: repo_id, path, start_byte, segments (``::`` joined), name, exported; unique in their order. Each import
    is linked to the last earlier export of that name: rows are spread by range over tasks, the last export before
    each part is a small table, and a window runs within parts only, so a name that very many imports use meets no
    single task. Chains of links are then followed by pointer jumping, which halves them in each round.
    """
    order = F.struct("path", "start_byte", "segments", "name")
    rows = cut(imports.withColumn("ord", order))
    kind = rows.schema["ord"].dataType
    asks = rows.select("repo_id", F.col("segments").alias("key"), "ord", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("export"))
    tells = rows.where("exported").select("repo_id", F.col("name").alias("key"), "ord", F.lit(1).alias("turn"), F.col("ord").alias("export"))
    linked = last_before(asks.unionByName(tells), ["repo_id", "key"], ["ord", "turn"], "export", "link").where("turn = 0").select("repo_id", "ord", "link")
    state = cut(linked.withColumn("target", F.when(F.col("link").isNull(), F.col("ord.segments"))).withColumn("through_export", F.col("link").isNotNull()))
    while state.where("target is null").head(1):
        there = state.select(F.col("repo_id").alias("r"), F.col("ord").alias("o"), F.col("link").alias("next"), F.col("target").alias("known"))
        j = state.join(there, state.repo_id.eqNullSafe(there.r) & (state.link == there.o), "left")
        state = cut(j.select("repo_id", "ord", F.coalesce("next", "link").alias("link"), F.coalesce("target", "known").alias("target"), "through_export"))
    return state.select("repo_id", "ord.path", "ord.start_byte", "ord.name", "target", "through_export")


def surviving_edges(base: DataFrame, facts: DataFrame) -> DataFrame:
    """Base edges that the new facts still hold: same path, kind, range and callee; definitions and implementations are never kept.

    ``base`` and ``facts`` have path, kind, start_line, end_line and callee, the name used there.
    """
    f = facts.select(*[F.col(c).alias(f"f_{c}") for c in (*PLACE, "callee")]).distinct()
    same = F.lit(True)
    for c in (*PLACE, "callee"):
        same = same & base[c].eqNullSafe(f[f"f_{c}"])
    return base.where(~F.col("kind").isin("defines", "implements", "overrides")).join(f, same, "left_semi")


def call_edges(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(source, name, kind, candidates, resolution, target): edges of calls whose names were looked up in scope order.

    ``calls``: source, name, scope, is_method. ``names``: scope, name, symbol, tier (0 bindings, 1 local names, 2 globs,
    3 exports): of a name's candidates in the call's scope those of the least tier count, and hide the others. One
    candidate resolves and also gives a ``references`` edge to it; several are polymorphic; a method call is never more
    than polymorphic, as its receiver is not known; a plain call without a candidate is unresolved, a reference without
    one gives no edge. Candidates are counted per (scope, name) before the join, so a hot name meets one row.
    """
    least = names.where("symbol is not null").groupBy("scope", "name", "tier").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("only"))
    per = least.groupBy("scope", "name").agg(F.min_by(F.struct("n", "only"), "tier").alias("best")).select(F.col("scope").alias("k_scope"), F.col("name").alias("k_name"), "best.n", "best.only")
    c = calls.select("source", "name", "scope", F.coalesce("is_method", F.lit(False)).alias("is_method")).distinct()
    j = c.join(per, c.scope.eqNullSafe(per.k_scope) & (c.name == per.k_name), "left")
    n = F.coalesce("n", F.lit(0))
    resolution = F.when(n == 0, "unresolved").when((n > 1) | F.col("is_method"), "polymorphic").otherwise("resolved")
    edges = j.select("source", "name", F.lit("calls").alias("kind"), n.alias("candidates"), resolution.alias("resolution"), F.when(resolution == "resolved", F.col("only")).alias("target"))
    return edges.unionByName(edges.where("resolution = 'resolved'").withColumn("kind", F.lit("references")))


def graph_summaries(edges: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, interface_change, callers, callees, reverse_dependents, connected_tests) of changed symbols.

    ``changed``: symbol. ``symbols``: symbol, path, public, is_test. An interface change is a changed public symbol;
    connected tests are different neighbours by calls, imports or references that lie in test files. Roles are
    equi-joins on the changed side; neighbours are looked up by one more.
    """
    c = changed.select(F.col("symbol").alias("at")).distinct()
    into = edges.join(c, edges.to_symbol == c["at"]).select("at", F.col("from_symbol").alias("other"), F.when(F.col("kind") == "calls", "caller").when(F.col("kind").isin("imports", "references"), "reverse").alias("role"))
    out = edges.where("kind = 'calls'").join(c, edges.from_symbol == c["at"]).select("at", F.col("to_symbol").alias("other"), F.lit("callee").alias("role"))
    near = into.unionByName(out).where("role is not null").distinct()
    tests = symbols.where("is_test").select(F.col("symbol").alias("other"), F.lit(True).alias("test")).distinct()
    counted = near.join(tests, "other", "left").groupBy("at").agg(
        *[F.countDistinct(F.when(F.col("role") == r, F.col("other"))).alias(a) for r, a in (("caller", "callers"), ("callee", "callees"), ("reverse", "reverse_dependents"))],
        F.countDistinct(F.when(F.col("test"), F.col("other"))).alias("connected_tests"),
    )
    public = symbols.groupBy(F.col("symbol").alias("at")).agg(F.bool_or("public").alias("public"))
    j = c.join(public, "at", "left").join(counted, "at", "left")
    return j.select(F.col("at").alias("symbol"), F.coalesce("public", F.lit(False)).alias("interface_change"), *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("callers", "callees", "reverse_dependents", "connected_tests")])


def nearest_root(added: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root folder that holds an added path; prefixes are made per path and joined, never compared pairwise."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = added.select("path", F.explode(prefixes).alias("root")).join(roots.select("root").distinct(), "root", "left_semi")
    return each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
