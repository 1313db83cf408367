"""Findings of analysers: merged, mapped to changed units and lines, ranked and counted.

Merging is one grouped aggregation by the finding's key with partial maxima. The
join to units is on (repo_id, path); added lines stay an array on the unit, so
the test of touched lines is a function of the row and not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import ids, ranks
from lodestrata.operators import ordered
from lodestrata.functions.ranks import BASELINE, CONFIDENCE, DISPOSITION, SEVERITY, rank, word

KEY = ["repo_id", "tool", "rule_id", "message", "path", "start_line", "end_line"]
# Words of severity and confidence, categories with their words in order, and categories that matter.
SEVERITY_WORDS = {"fatal": "critical", "critical": "critical", "high": "error", "error": "error", "medium": "warning", "warning": "warning", "low": "note", "info": "note", "information": "note", "note": "note", "none": "none"}
CONFIDENCE_WORDS = {"veryhigh": "very-high", "very-high": "very-high", "high": "high", "moderate": "medium", "medium": "medium", "low": "low"}
CATEGORIES = {
    "privacy": ("privacy", "pii", "personal-data"),
    "security": ("security", "cwe-", "owasp", "injection", "xss", "ssrf", "auth", "vulnerability"),
    "build": ("compiler", "compile", "type-check", "typecheck", "type-error", "type error", "rustc", "tsc", "mypy", "pyright", "javac"),
    "data": ("data-loss", "migration", "database", "corruption"),
    "compatibility": ("compatibility", "breaking", "api-contract"),
    "reliability": ("reliability", "deadlock", "race-condition", "resource-leak"),
    "performance": ("performance", "complexity", "n+1"),
    "correctness": ("correctness", "null-deref", "use-after-free", "logic-error", "bug"),
    "maintainability": ("maintainability", "style", "format", "documentation"),
}
MATERIAL = ("security", "privacy", "build", "correctness", "data", "compatibility", "reliability")


def _word(value: Column | str, words: dict[str, str]) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    low = F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), low), F.lit("unknown"))


def severity(value: Column | str) -> Column:
    return _word(value, SEVERITY_WORDS)


def confidence(value: Column | str) -> Column:
    return _word(value, CONFIDENCE_WORDS)


def category(*parts: Column | str) -> Column:
    """The first category of which a word occurs in the parts, joined by spaces."""
    corpus = F.lower(F.concat_ws(" ", *parts))
    out = None
    for name, needles in CATEGORIES.items():
        test = F.lit(False)
        for n in needles:
            test = test | F.contains(corpus, F.lit(n))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def merge(findings: DataFrame) -> DataFrame:
    """One row per key: greatest severity and confidence, first known category by report, new over existing over unknown, any report completed, sorted report ids."""
    known = F.when(F.col("category") != "unknown", F.struct("report_id", "category"))
    grouped = findings.groupBy(*KEY).agg(
        F.max(rank("severity", SEVERITY)).alias("s"), F.max(rank("confidence", CONFIDENCE)).alias("c"), F.min(known).alias("k"),
        F.max(rank("baseline_state", BASELINE)).alias("b"), F.bool_or("completed").alias("completed"),
        F.array_sort(F.collect_set("report_id")).alias("report_ids"),
    )
    return grouped.select(
        *KEY, word("s", SEVERITY).alias("severity"), word("c", CONFIDENCE).alias("confidence"), F.coalesce("k.category", F.lit("unknown")).alias("category"),
        word("b", BASELINE).alias("baseline_state"), "completed", "report_ids",
    )


def assess(merged: DataFrame, units: DataFrame) -> DataFrame:
    """Findings with their unit, line scope, blocking mark and disposition. ``units``: repo_id, path, unit_id, added (array of start_line, end_line)."""
    j = merged.join(units, ["repo_id", "path"], "left")
    touches = F.exists("added", lambda r: (r["start_line"] <= F.coalesce("end_line", "start_line")) & (r["end_line"] >= F.col("start_line")))
    scope = F.when(F.col("unit_id").isNull(), "outside-scope").when(F.col("start_line").isNull(), "unknown").when(F.coalesce(touches, F.lit(False)), "added").otherwise("unchanged")
    j = j.withColumn("line_scope", scope)
    j = j.withColumn("baseline_state", F.when(F.col("line_scope") == "added", "new").otherwise(F.col("baseline_state")))
    material = F.col("category").isin(*MATERIAL)
    blocking = F.col("completed") & (F.col("line_scope") == "added") & material & F.col("severity").isin("critical", "error") & F.col("confidence").isin("very-high", "high")
    priority = F.col("completed") & material & F.col("severity").isin("critical", "error", "warning") & (
        F.col("line_scope").isin("added", "unknown") | (F.col("baseline_state") == "new")
    )
    disposition = F.when(F.col("line_scope") == "outside-scope", "outside-scope").when(blocking, "blocking-candidate").when(priority, "priority-candidate").otherwise("note")
    finding_id = ids.bare_id("tool", "rule_id", "message", "path", F.coalesce(F.col("start_line").cast("string"), F.lit("None")), F.coalesce(F.col("end_line").cast("string"), F.lit("None")))
    return j.withColumns({"blocking_candidate": blocking, "disposition": disposition, "finding_id": finding_id}).drop("added")


def ranked(assessed: DataFrame) -> DataFrame:
    """Each finding's place per repository: disposition, severity, confidence, path, line, tool, rule, message."""
    order = [
        rank("disposition", DISPOSITION), F.desc(rank("severity", SEVERITY)), F.desc(rank("confidence", CONFIDENCE)), F.col("path"), F.coalesce("start_line", F.lit(0)), F.col("tool"), F.col("rule_id"), F.col("message"),
        F.coalesce("end_line", F.lit(0)),
    ]
    return ordered.rank(assessed, ["repo_id"], order, "place")


def counts(findings: DataFrame, assessed: DataFrame) -> DataFrame:
    """Counters per repository, over all findings and not only those shown."""
    raw = findings.groupBy("repo_id").agg(F.count("*").alias("input_findings"), F.countDistinct("report_id").alias("reports"))
    each = assessed.groupBy("repo_id").agg(
        F.count("*").alias("deduplicated_findings"), F.count("unit_id").alias("mapped_to_units"), F.count_if(F.col("line_scope") == "added").alias("added_line"),
        *[F.count_if(F.col("disposition") == d).alias(n) for d, n in (("blocking-candidate", "blocking_candidates"), ("priority-candidate", "priority_candidates"), ("note", "notes"), ("outside-scope", "outside_scope"))],
    )
    return raw.join(each, "repo_id")


def truncated(ranked_findings: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings per repository, each with whether more were left out; count before this."""
    last = ranked_findings.groupBy("repo_id").agg((F.max("place") > most).alias("truncated"))
    return ranked_findings.where(F.col("place") <= most).join(last, "repo_id")


def union_evidence(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """All findings of several executions, ids keyed anew by execution so that none fall together."""
    out = None
    for execution, part in parts:
        keyed = part.withColumn("execution_id", F.lit(execution)).withColumn("finding_id", ids.bare_id(F.lit("orchestration-finding-v1"), F.lit(execution), "finding_id"))
        out = keyed if out is None else out.unionByName(keyed)
    return out


def report_union(reports: DataFrame) -> DataFrame:
    """(report_id, copies, collision): identical deliveries of a report count once; differing contents under one id are a collision."""
    return reports.groupBy("report_id").agg(F.count("*").alias("copies"), (F.countDistinct("content") > 1).alias("collision"))


def orchestration_status(runs: DataFrame, by: str) -> DataFrame:
    """completed if all runs were accepted, partial if some, else unavailable."""
    n = F.count_if("accepted")
    return runs.groupBy(by).agg(F.when(n == F.count("*"), "completed").when(n > 0, "partial").otherwise("unavailable").alias("status"), n.alias("accepted_runs"))


def sum_counters(parts: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    """Counter-wise sums over runs; a missing counter is 0."""
    return parts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
