"""Nested records to flat tables with parent-child links, by shared inlining.

The schema graph is found from the data in aggregating passes, never assumed:

1. fields of list items, per element name. They tell a single item written
   without its list (``{"path": ..}``) from a map of items keyed by data
   (``{"legal/NOTICE": {..}}``);
2. edges parent element -> child element with their multiplicity and kind, and
   the kinds of scalars, which give the columns their types. An object element
   with very many distinct keys holds data in its keys and is read as a map of
   items; the pass is repeated while it shows further maps inside known ones. The
   root is never a map, so all of its edges stay however many there are.

An element gets a table of its own if it is the root, repeated (under a list or
a map), shared (reached from more than one parent element) or recursive; every
other element is a singleton descendant and is inlined into the columns of its
nearest ancestor that has a table. A last pass emits all rows with their keys.
``FlatTables.relation`` gives an element's rows wherever the graph has put them.

Defined results: a null or incomplete payload gives no row in any table and one
in ``rejected()``; an empty input gives empty tables; the same record delivered
again gives the same row ids and is counted once; a JSON document wrapped in a
JSON string, or a nested one in a string, is decoded; a byte order mark is
skipped; a missing or null element gives no row; of repeated keys in one object
the last holds, as JSON readers do.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut

ROOT = "document"
LONG = (
    "root_id string, table string, row_id string, parent_table string, parent_id string, ordinal int, "
    "item_key string, item_value string, cols map<string,string>"
)


def decoded(text: str | None):
    """The JSON value in ``text``, with wrapping strings undone; raises ValueError."""
    if text is None:
        raise ValueError("no payload")
    value = json.loads(text.lstrip("﻿ \t\r\n"))
    while isinstance(value, str):
        value = json.loads(value)
    return value


def opened(value):
    """A string that holds a whole JSON object or array, decoded; else ``value``."""
    if isinstance(value, str) and value[:1] in "[{" and value[-1:] in "]}" and value:
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


KEYS = ["root_id", "row_id", "parent_table", "parent_id", "ordinal", "item_key", "item_value"]


def scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


TEXT, BOOLEAN, WHOLE, FLOATING, OVER_DOUBLE, OVER_LONG = 1, 2, 4, 8, 16, 32


def kind_bit(value) -> int:
    """The kind of a scalar as a bit, so that kinds add up by bitwise or."""
    if value is None or isinstance(value, (dict, list)):
        return 0
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return WHOLE | (OVER_DOUBLE if abs(value) > 1 << 53 else 0) | (OVER_LONG if not -(1 << 63) <= value < 1 << 63 else 0)
    return FLOATING if isinstance(value, float) else TEXT


def column_type(bits: int) -> str:
    """The narrowest type that holds all kinds seen without loss; text else."""
    if bits == BOOLEAN:
        return "boolean"
    if bits in (WHOLE, WHOLE | OVER_DOUBLE):
        return "bigint"
    return "double" if bits in (FLOATING, WHOLE | FLOATING) else "string"


@dataclass
class SchemaGraph:
    """What the two passes found. ``edges``: (parent, child) -> (complex?, repeated?)."""

    item_fields: dict[str, set[str]] = field(default_factory=dict)
    maps: set[str] = field(default_factory=set)
    edges: dict[tuple[str, str], tuple[bool, bool]] = field(default_factory=dict)
    kinds: dict[tuple[str, str], int] = field(default_factory=dict)
    forced: frozenset[str] = frozenset()

    def is_map(self, element: str, value: dict) -> bool:
        fields = self.item_fields.get(element)
        if element in self.maps:
            return True
        return bool(fields) and bool(value) and not any(k in fields for k in value) and element != ROOT

    def tables(self) -> list[str]:
        parents, repeated = defaultdict(set), set()
        children = defaultdict(set)
        for (parent, child), (deep, many) in self.edges.items():
            if many:
                repeated.add(child)
            if deep or many:
                parents[child].add(parent)
                children[parent].add(child)
        shared = {c for c, ps in parents.items() if len(ps) > 1}
        recursive = {c for c in parents if self._reaches(children, c, c)}
        known = set(parents) | {ROOT}
        return [ROOT, *sorted((repeated | shared | recursive | (self.forced & known)) - {ROOT})]

    @staticmethod
    def _reaches(children: dict[str, set[str]], start: str, goal: str) -> bool:
        seen, todo = set(), list(children[start])
        while todo:
            at = todo.pop()
            if at == goal:
                return True
            if at not in seen:
                seen.add(at)
                todo.extend(children.get(at, ()))
        return False

    def columns(self, table: str) -> dict[str, str]:
        """Scalar columns of ``table`` with their types, those of inlined descendants with their path.

        An inlined element that is also written as a scalar has a column for that, of its own name.
        """
        own, out = set(self.tables()), {}
        children = defaultdict(list)
        for (parent, child), (deep, many) in sorted(self.edges.items()):
            if not many:
                children[parent].append((child, deep))

        def walk(element: str, prefix: str, on_way: tuple[str, ...]) -> None:
            for child, deep in children[element]:
                bits = self.kinds.get((element, child), 0)
                if not deep or bits and child not in own:
                    out[prefix + child] = column_type(bits)
                if deep and child not in own and child not in on_way:
                    walk(child, f"{prefix}{child}.", (*on_way, child))

        walk(table, "", (table,))
        return dict(sorted(out.items()))


def _items(graph: SchemaGraph, element: str, value) -> tuple[list[tuple[str | None, object]], str]:
    """The occurrences of ``element`` in ``value`` with their map keys, and their form: ``many``, ``listed`` or ``bare``.

    A list of one may be a singleton written as a list; the element repeats if it
    is ever listed otherwise, or never written bare.
    """
    value = opened(value)
    if value is None:
        return [], ""
    if isinstance(value, list):
        return [(None, opened(v)) for v in value if v is not None], "many" if len(value) > 1 else "listed"
    if isinstance(value, dict) and graph.is_map(element, value):
        return [(k, opened(v)) for k, v in value.items()], "many"
    return [(None, value)], "bare"


def _fields_of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: set[tuple[str, str]] = set()
        for text in batch["payload"]:
            try:
                todo = [(ROOT, decoded(text))]
            except (ValueError, RecursionError):
                continue
            while todo:
                name, value = todo.pop()
                if isinstance(value, dict):
                    todo.extend((k, opened(v)) for k, v in value.items())
                elif isinstance(value, list):
                    for item in map(opened, value):
                        if isinstance(item, dict):
                            found.update((name, k) for k in item)
                        todo.append((name, item))
        yield pd.DataFrame(sorted(found), columns=["element", "field"], dtype=object)


def _edges(graph: SchemaGraph):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for text in batch["payload"]:
                try:
                    todo = [(ROOT, decoded(text))]
                except (ValueError, RecursionError):
                    continue
                while todo:
                    name, value = todo.pop()
                    if isinstance(value, list):
                        todo.extend((name, opened(v)) for v in value)
                        continue
                    if not isinstance(value, dict):
                        continue
                    for child, inner in value.items():
                        inner = opened(inner)
                        items, form = _items(graph, child, inner)
                        seen = found.setdefault((name, child), [False, False, False, False, 0])
                        seen[0] |= any(isinstance(v, (dict, list)) for _, v in items)
                        seen[1] |= form == "many"
                        seen[2] |= form == "listed"
                        seen[3] |= form == "bare"
                        for _, v in items:
                            seen[4] |= kind_bit(v)
                        todo.extend((child, v) for _, v in items if isinstance(v, (dict, list)))
            rows = [(p, c, *seen) for (p, c), seen in found.items()]
            yield pd.DataFrame(rows, columns=["parent", "child", "deep", "many", "listed", "bare", "kinds"])

    return run


def _shred(graph: SchemaGraph):
    tables = frozenset(graph.tables())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["root_id"], batch["payload"]):
                try:
                    value = decoded(text)
                except (ValueError, RecursionError):
                    digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, "_rejected", digest[:32], None, None, 0, None, None, {}))
                    continue
                stamp = hashlib.sha256(f"{key}\0{json.dumps(value, sort_keys=True)}".encode()).hexdigest()[:24]
                top = value if isinstance(value, list) else [value]
                for i, record in enumerate(top):
                    _emit(rows, graph, tables, key, ROOT, f"{stamp}/{i}", None, None, i, None, record)
            yield pd.DataFrame(
                rows,
                columns=["root_id", "table", "row_id", "parent_table", "parent_id", "ordinal", "item_key", "item_value", "cols"],
            )

    return run


def _emit(rows, graph, tables, key, table, row_id, parent_table, parent_id, ordinal, item_key, value) -> None:
    todo = [(table, row_id, parent_table, parent_id, ordinal, item_key, value)]
    while todo:
        table, row_id, parent_table, parent_id, ordinal, item_key, value = todo.pop()
        cols: dict[str, str | None] = {}
        inline = [(table, "", value)]
        while inline:
            element, prefix, node = inline.pop()
            if not isinstance(node, dict):
                continue
            for child, inner in node.items():
                items, _ = _items(graph, child, inner)
                deep, many = graph.edges.get((element, child), (False, False))
                if child in tables and (deep or many):
                    for n, (k, v) in enumerate(items):
                        todo.append((child, f"{row_id}/{prefix}{child}.{n}", table, row_id, n, k, v))
                elif deep:
                    inline.extend((child, f"{prefix}{child}.", v) for _, v in items if isinstance(v, dict))
                    for _, v in items:
                        if not isinstance(v, (dict, list)):
                            cols[prefix + child] = scalar(v)
                else:
                    cols[prefix + child] = scalar(opened(inner)) if not items else scalar(items[0][1])
        text = None if isinstance(value, dict) else scalar(value)
        rows.append((key, table, row_id, parent_table, parent_id, ordinal, item_key, text, cols))


@dataclass
class FlatTables:
    """The result: the graph, and one DataFrame per table."""

    graph: SchemaGraph
    long: DataFrame

    def names(self) -> list[str]:
        return self.graph.tables()

    def table(self, name: str) -> DataFrame:
        """Columns root_id, row_id, parent_table, parent_id, ordinal, item_key, item_value, then the element's own with their types."""
        own = self.long.where(F.col("table") == name).dropDuplicates(["root_id", "row_id"])
        return own.select(*KEYS, *[F.col("cols")[c].cast(kind).alias(c) for c, kind in self.graph.columns(name).items()])

    def relation(self, name: str) -> DataFrame:
        """The rows of an element: those of its table, or those inlined into the tables of its ancestors.

        An inlined row has its ancestor's row as parent and a row_id made from it. The columns are ``table``'s.
        """
        if name in self.names():
            return self.table(name)
        parts = []
        for table in self.names():
            for path in sorted({c[:c.index(f".{name}.") + len(name) + 1] if f".{name}." in c else name for c in self.graph.columns(table) if c.startswith(f"{name}.") or f".{name}." in c or c == name}):
                held = self.long.where(F.col("table") == table).dropDuplicates(["root_id", "row_id"])
                mine = {c[len(path) + 1:]: kind for c, kind in self.graph.columns(table).items() if c.startswith(f"{path}.")}
                present = F.coalesce(F.col("cols")[path].isNotNull(), F.lit(False)) | F.exists(F.map_keys("cols"), lambda k: k.startswith(f"{path}."))
                parts.append(held.where(present).select(
                    "root_id", F.concat("row_id", F.lit(f"/{path}.0")).alias("row_id"), F.col("table").alias("parent_table"), F.col("row_id").alias("parent_id"),
                    F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("item_key"), F.col("cols")[path].alias("item_value"),
                    *[F.col("cols")[f"{path}.{c}"].cast(kind).alias(c) for c, kind in mine.items()],
                ))
        if not parts:
            return self.long.where(F.lit(False)).select(*KEYS)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def rejected(self) -> DataFrame:
        return self.long.where(F.col("table") == "_rejected").select("root_id").distinct()


def _narrow(pairs: DataFrame, key: str, max_fields: int, most: int) -> tuple[list, list[str]]:
    """Rows of ``pairs`` whose key has at most ``max_fields`` of them or is the root, and the other keys.

    The driver gets the schema, never data: beyond ``most`` rows it refuses.
    """
    sizes = pairs.groupBy(key).agg(F.count("*").alias("n_of_key"))
    narrow = (F.col("n_of_key") <= max_fields) | (F.col(key) == ROOT)
    wide = [r[0] for r in sizes.where(~narrow).select(key).limit(most + 1).collect()]
    kept = pairs.join(sizes.where(narrow), key).limit(most + 1).collect()
    if len(kept) > most or len(wide) > most:
        raise ValueError(f"the schema has more than {most} elements; name its maps by a lower max_fields")
    return kept, wide


def shared_inlining(
    df: DataFrame, id_col: str, payload_col: str, force_tables: tuple[str, ...] = (), max_fields: int = 400, item_hints: dict[str, set[str]] | None = None, most: int = 50_000,
) -> FlatTables:
    """Shred ``df[payload_col]`` (JSON) into flat tables keyed by ``df[id_col]``.

    ``force_tables``: elements that keep a table even if they could be inlined.
    ``item_hints``: fields of an element's items that are known beforehand; they
    tell its maps apart even where these data hold no list of it.
    ``max_fields``: an object element (but the root) with more distinct keys than
    that holds data in its keys and is read as a map of items, one row each. What
    the driver collects is the schema graph only; with more than ``most`` edges it
    refuses with a ValueError.
    """
    source = df.select(F.col(id_col).cast("string").alias("root_id"), F.col(payload_col).cast("string").alias("payload"))
    payloads = source.select("payload")
    listed = payloads.mapInPandas(_fields_of_items, "element string, field string").distinct()
    graph = SchemaGraph(forced=frozenset(force_tables))
    for row in _narrow(listed, "element", max_fields, most)[0]:
        graph.item_fields.setdefault(row.element, set()).add(row.field)
    for element, fields in (item_hints or {}).items():
        graph.item_fields.setdefault(element, set()).update(fields)
    while True:  # a map inside a map inside .. shows only once the outer one is known; each round knows one more
        edges = payloads.mapInPandas(_edges(graph), "parent string, child string, deep boolean, many boolean, listed boolean, bare boolean, kinds int")
        edges = edges.groupBy("parent", "child").agg(*[F.max(c).alias(c) for c in ("deep", "many", "listed", "bare")], F.bit_or("kinds").alias("kinds"))
        found, wide = _narrow(edges, "parent", max_fields, most)
        if not set(wide) - graph.maps:
            break
        graph.maps |= set(wide)
    if wide:  # items of a map that have very many different keys themselves: their edges are kept as well
        found = edges.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"items of {sorted(wide)[:3]} have more than {most} different keys")
    graph.edges = {(r.parent, r.child): (r.deep, r.many or r.listed and not r.bare) for r in found}
    graph.kinds = {(r.parent, r.child): r.kinds for r in found}
    return FlatTables(graph, cut(source.mapInPandas(_shred(graph), LONG)))


def column_or_null(table: DataFrame, name: str):
    """``table[name]``, or null where these data have no such field."""
    return F.col(f"`{name}`") if name in table.columns else F.lit(None).cast("string")


#: What names the items of maps in publications; all else is found in the data.
PUBLICATION_NAMES = {"platforms": {"platform_id"}, "packs": {"platform_id"}, "license_files": {"path"}}


def publication_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """records, platforms, license_files, bindings and executables of publication payloads.

    Each keeps ``row_id`` and ``parent_id``; platforms and packs are one table.
    License files, bindings and executables are those that a platform or pack
    itself lists, not those quoted deeper inside its attestations. Sizes are
    bigint and flags boolean, null where they are written as something else.
    """
    flat = shared_inlining(raw, "record_id", "payload", item_hints=PUBLICATION_NAMES)
    own = F.col("parent_table").isin("platforms", "packs")

    def of(name: str, **columns: str) -> DataFrame:
        rows = flat.relation(name)
        picked = {new: column_or_null(rows, new).cast("string").try_cast(kind) for new, kind in columns.items()}
        return rows.select(
            F.col("root_id").cast("bigint").alias("record_id"), "row_id", "parent_id", "parent_table", "ordinal",
            "item_key", "item_value", *[c.alias(n) for n, c in picked.items()],
        )

    platform_cols = {"platform_id": "string", "published": "boolean", "state": "string", "pack_sha256": "string"}
    platforms = of("platforms", **platform_cols).withColumn("kind", F.lit("platform")).unionByName(
        of("packs", **platform_cols).withColumn("kind", F.lit("pack"))
    )
    platforms = platforms.withColumn("platform_id", F.coalesce("platform_id", "item_key"))
    file_cols = {"path": "string", "size": "bigint", "sha256": "string"}
    licenses = of("license_files", **file_cols).where(own)
    licenses = licenses.withColumn("path", F.coalesce("path", "item_key", "item_value"))
    executables = of("executable", **file_cols).where(own)
    executables = executables.withColumn("path", F.coalesce("path", "item_value"))
    bindings = of("baseline_binding", fixture_id="string", runner_class="string", toolchain="string").where(own)
    top = flat.table(ROOT)
    either = lambda name: F.coalesce(column_or_null(top, name).cast("string"), column_or_null(top, f"record.{name}").cast("string"))
    records = top.select(
        F.col("root_id").cast("bigint").alias("record_id"), "row_id", "ordinal", either("artifact_id").alias("artifact_id"),
        either("kind").alias("record_kind"), either("pack_version").alias("pack_version"), either("commit").alias("commit"),
    )
    drop = ("item_key", "item_value")
    return {
        "records": records,
        "platforms": platforms.drop(*drop),
        "license_files": licenses.drop(*drop),
        "executables": executables.drop(*drop),
        "bindings": bindings.drop(*drop),
    }


def license_links(raw: DataFrame) -> DataFrame:
    """One row per license file with its platform's fixture and executable digest (empty string where absent)."""
    t = publication_tables(raw)
    one = lambda df, column: df.groupBy("parent_id").agg(F.min_by(column, "ordinal").alias(column))
    lic = t["license_files"].where("path is not null").select("record_id", "parent_id", F.col("path").alias("license_path"))
    plat = t["platforms"].select(F.col("row_id").alias("parent_id"), "platform_id")
    fixture = one(t["bindings"], "fixture_id")
    digest = one(t["executables"], "sha256")
    joined = lic.join(plat, "parent_id").join(fixture, "parent_id", "left").join(digest, "parent_id", "left")
    return joined.select(
        "record_id", "platform_id", "license_path",
        F.coalesce("fixture_id", F.lit("")).alias("fixture_id"),
        F.coalesce("sha256", F.lit("")).alias("executable_sha256"),
    ).distinct()


def link_counts(raw: DataFrame) -> DataFrame:
    """(record_id, platforms, license_files, bindings, executables): different ones of each record, counted along the parent links."""
    t = publication_tables(raw)
    plat = t["platforms"].select(F.col("row_id").alias("parent_id"), "record_id", "platform_id")
    of = lambda name, *keys: t[name].drop("record_id", "platform_id").join(plat, "parent_id").select("record_id", F.lit(name).alias("what"), F.struct("platform_id", *keys).alias("key"))
    parts = [plat.select("record_id", F.lit("platforms").alias("what"), F.struct("platform_id", F.lit("").alias("path")).alias("key")), of("license_files", "path")]
    parts += [of("bindings", F.lit("").alias("path")), of("executables", F.lit("").alias("path"))]
    found = reduce(DataFrame.unionByName, parts).where("what <> 'license_files' or key.path is not null").distinct()
    return found.groupBy("record_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("platforms", "license_files", "bindings", "executables")])
