import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import nested

RECORDS = [
    (1, json.dumps({"kind": "a", "platforms": [
        {"platform_id": "p1", "license_files": [{"path": "L1"}, {"path": None}, {"path": "L1"}], "executable": {"sha256": "e1"}, "baseline_binding": {"fixture_id": "f1"}},
        {"platform_id": "p2", "license_files": ["L2"], "executable": "bin/x", "baseline_binding": [{"fixture_id": "f2"}]},
    ]})),
    (2, "\ufeff" + json.dumps({"record": {"kind": "b", "packs": {"p3": {"license_files": {"legal/L3": {"size": 3}}, "executable": None}}}})),
    (3, json.dumps(json.dumps({"kind": "c", "platforms": [{"platform_id": "p4", "license_files": json.dumps([{"path": "Lé"}]), "subjects": [{"predicate": {"license_files": [{"path": "quoted"}]}}]}]}))),
    (4, '{"kind": "d", "platforms": [{"platform_id": "p5", "license_fi'),
    (5, None), (6, ""), (7, "[]"), (8, json.dumps({"platforms": None})),
    (9, json.dumps({"platforms": [{"platform_id": "p6", "license_files": {"path": "single"}, "extra": {"deep": {"er": [1, 2]}}}]})),
]
WANT = {(1, "p1", "L1", "f1", "e1"), (1, "p2", "L2", "f2", ""), (2, "p3", "legal/L3", "", ""), (3, "p4", "Lé", "", ""), (9, "p6", "single", "", "")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, payload string").withColumn("parent_id", F.lit("clash")).withColumn("root_id", F.lit("clash"))


def test_shapes_wrappers_nulls_and_repeats(spark):
    got = {tuple(r) for r in nested.license_links(frame(spark, RECORDS + RECORDS[:1])).collect()}
    assert got == WANT
    assert len(nested.license_links(frame(spark, RECORDS + RECORDS)).collect()) == len(WANT)


def test_keys_link_children_to_parents(spark):
    t = nested.publication_tables(frame(spark, RECORDS))
    for child in ("license_files", "executables", "bindings"):
        orphans = t[child].join(t["platforms"].select(F.col("row_id").alias("parent_id")), "parent_id", "left_anti")
        assert orphans.count() == 0
    assert t["platforms"].count() == 5
    assert "quoted" not in {r.path for r in t["license_files"].collect()}


def test_schema_graph_decides_tables(spark):
    flat = nested.shared_inlining(frame(spark, RECORDS), "record_id", "payload")
    names = flat.names()
    assert {"platforms", "license_files", "er", "subjects"} <= set(names)
    assert "extra.deep" not in flat.graph.columns("platforms") and "deep" not in names
    assert {r.root_id for r in flat.rejected().collect()} == {"4", "5", "6"}


def test_recursive_elements_get_a_table(spark):
    rows = [(1, json.dumps({"node": {"v": 1, "node": {"v": 2, "node": {"v": 3}}}}))]
    flat = nested.shared_inlining(frame(spark, rows), "record_id", "payload")
    assert "node" in flat.names()
    assert sorted(r.v for r in flat.table("node").collect()) == [1, 2, 3]


def test_objects_with_too_many_keys_are_maps(spark):
    rows = [(i, json.dumps({"by_key": {f"k{i}-{j}": {"n": j} for j in range(20)}})) for i in range(5)]
    flat = nested.shared_inlining(frame(spark, rows), "record_id", "payload", max_fields=30)
    assert flat.table("by_key").count() == 100
    assert {r.item_key for r in flat.table("by_key").collect()} == {f"k{i}-{j}" for i in range(5) for j in range(20)}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_gives_nothing(spark, rows):
    assert nested.license_links(frame(spark, rows)).collect() == []


def test_the_root_keeps_all_edges_however_many(spark):
    wide = {f"f{i}": i for i in range(450)} | {"platforms": [{"platform_id": "p", "n": 1}, {"platform_id": "q", "n": 2}]}
    flat = nested.shared_inlining(frame(spark, [(1, json.dumps(wide))]), "record_id", "payload")
    assert {r.platform_id for r in flat.table("platforms").collect()} == {"p", "q"} and len(flat.graph.columns("document")) == 450
    assert flat.table("document").first().f449 == 449
    with pytest.raises(ValueError):
        nested.shared_inlining(frame(spark, [(1, json.dumps(wide))]), "record_id", "payload", most=300)


def test_maps_within_maps_of_any_depth(spark):
    def deep(level):
        return {f"k{level}-{i}": {"inner": deep(level - 1)} if level else {"v": i} for i in range(3)}

    value = {"m": 1}
    for level in range(10):
        value = {f"x{level}-{i}": {f"c{level}": value} for i in range(3)}
    rows = [(1, json.dumps({"top": value})), (2, json.dumps({"top": {f"y{i}": {"c9": {"z": {"c8": {}}}} for i in range(5)}}))]
    flat = nested.shared_inlining(frame(spark, rows), "record_id", "payload", max_fields=2)
    assert flat.graph.maps >= {"top", "c9", "c8", "c5", "c1"}
    assert flat.table("top").count() == 8 and flat.table("c9").count() == 9 + 5


def test_columns_have_types_and_inlined_elements_are_relations(spark):
    rows = [
        (1, json.dumps({"items": [{"n": 1, "x": 1.5, "ok": True, "s": "a", "mixed": 1, "big": 1 << 70, "part": {"q": 7}}, {"n": 2, "x": 2, "mixed": "b"}]})),
        (2, json.dumps({"items": [{"n": (1 << 63) - 1, "part": "bare"}, {"n": None}]})),
    ]
    flat = nested.shared_inlining(frame(spark, rows), "record_id", "payload")
    kinds = dict(flat.table("items").dtypes)
    assert {c: kinds[c] for c in ("n", "x", "ok", "s", "mixed", "big")} == {"n": "bigint", "x": "double", "ok": "boolean", "s": "string", "mixed": "string", "big": "string"}
    assert {r.n for r in flat.table("items").collect()} == {1, 2, (1 << 63) - 1, None} and {r.big for r in flat.table("items").collect()} == {str(1 << 70), None}
    assert "part" not in flat.names()
    part = flat.relation("part").collect()
    assert sorted((r.q or 0, r.item_value or "") for r in part) == [(0, "bare"), (7, "")] and {r.parent_table for r in part} == {"items"}
    assert {r.parent_id for r in part} <= {r.row_id for r in flat.table("items").collect()}
    assert flat.relation("nowhere").collect() == []
