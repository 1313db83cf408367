"""Readers: what cannot be read is told, rules of reports are found by their keys, patterns are those of the engine."""

import json

from lodestrata.sources import configuration, reports, version_control


def test_tails_that_cannot_be_read_are_rejected_rows(spark):
    raw = spark.createDataFrame([("a", "M\0x\0R100\0old\0new\0R100\0only"), ("b", "A\0y\0"), ("c", None), ("d", ""), ("e", "M\0\0A\0z\0")], "source string, raw string")
    rows = [(r.source, r.ordinal, r.status, r.path, r.old_path, r.rejected) for r in version_control.name_status_decoded(raw).orderBy("source", "ordinal").collect()]
    assert rows == [("a", 1, "M", "x", None, None), ("a", 2, "R100", "new", "old", None), ("a", 3, None, None, None, "R100\0only"), ("b", 1, "A", "y", None, None), ("e", 1, None, None, None, "M\0\0A\0z")]
    counts = spark.createDataFrame([("a", "1\t2\tx\0-\t-\t\0old\0new\0" + "3\t4\t\0old"), ("b", "junk")], "source string, raw string")
    rows = [(r.source, r["add"], r["del"], r.path, r.old_path, r.rejected) for r in version_control.numstat_decoded(counts).orderBy("source", "ordinal").collect()]
    assert rows == [("a", "1", "2", "x", None, None), ("a", "-", "-", "new", "old", None), ("a", None, None, None, None, "3\t4\t\0old"), ("b", None, None, None, None, "junk")]
    assert version_control.name_status(raw).count() == 3


def test_results_find_their_rule_by_id_or_index(spark):
    rule = lambda i, level: {"id": i, "defaultConfiguration": {"level": level}}
    run = {"tool": {"driver": {"name": "t", "rules": [rule("r0", "error"), rule("r1", "warning"), rule("r1", "note")]}}, "results": [
        {"ruleId": "r1", "message": {"text": "a"}}, {"ruleIndex": 0, "message": {"text": "b"}}, {"ruleId": "none", "ruleIndex": 1, "message": {"text": "c"}}, {"ruleId": "none", "message": {"text": "d"}}, {"ruleId": "r0", "level": "note", "message": {"text": "e"}},
        {"ruleIndex": -1, "message": {"text": "f"}}, {"ruleIndex": 99, "message": {"text": "g"}},
    ]}
    bare = {"tool": {"driver": {"name": "u"}}, "results": [{"ruleId": "r1", "message": {"text": "h"}}]}
    df = spark.createDataFrame([("x", json.dumps({"version": "2.1.0", "runs": [run, bare]})), ("y", None), ("z", "no json")], "report_id string, payload string")
    assert {r.message: r.severity for r in reports.sarif(df).collect()} == {"a": "warning", "b": "error", "c": "warning", "d": "unknown", "e": "note", "f": "unknown", "g": "unknown", "h": "unknown"}


def test_patterns_are_those_of_the_engine_that_runs_them(spark):
    rules, problems = configuration.regex_rules(["a+", "(?P<x>a)", "(?<x>a)", "[a&&[b]]", "("])
    assert [p for _, p in rules] == ["a+", "(?<x>a)", "[a&&[b]]"] and [p for p, _ in problems] == ["(?P<x>a)", "("]
