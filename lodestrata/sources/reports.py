"""Readers of analyser reports: SARIF 2.1.0 and the fixed findings format, told apart by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import clean_text, normalize_path
from lodestrata.operators import evidence as ev

MOST_BYTES = 10_000_000

_RULE = "struct<id:string,properties:struct<tags:array<string>,precision:string,`problem.severity`:string>,defaultConfiguration:struct<level:string>>"
_RESULT = (
    "struct<ruleId:string,ruleIndex:int,level:string,baselineState:string,message:struct<text:string,markdown:string>,properties:struct<tags:array<string>,precision:string,severity:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>"
)
SARIF = (
    f"struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,version:string,semanticVersion:string,rules:array<{_RULE}>>>,"
    f"invocations:array<struct<executionSuccessful:boolean>>,results:array<{_RESULT}>>>>"
)
FINDINGS = (
    "struct<schema_version:int,kind:string,scope_fingerprint:string,tool:struct<name:string,version:string>,status:string,"
    "findings:array<struct<rule_id:string,message:string,path:string,start_line:int,end_line:int,severity:string,category:string,confidence:string,baseline_state:string>>>"
)
OUT = ["report_id", "tool", "rule_id", "message", "path", "start_line", "end_line", "severity", "confidence", "category", "baseline_state", "completed"]


def report_format(payload) -> F.col:
    """sarif, findings, too-large or unknown."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return (
        F.when(F.octet_length(c) > MOST_BYTES, "too-large").when(F.get_json_object(c, "$.runs").isNotNull(), "sarif").when(F.get_json_object(c, "$.findings").isNotNull(), "findings").otherwise("unknown")
    )


def sarif(reports: DataFrame, repository: str = "") -> DataFrame:
    """Findings of (report_id, payload): one per location; absent ones are dropped.

    A result's rule is the run's first of its id, else the one at its index; rules are joined by their keys, never carried along with results.
    """
    run = reports.select("report_id", F.from_json("payload", SARIF).alias("p")).select("report_id", F.posexplode("p.runs").alias("run_no", "run"))
    failed = F.exists(F.coalesce("run.invocations", F.array().cast("array<struct<executionSuccessful:boolean>>")), lambda i: ~F.coalesce(i["executionSuccessful"], F.lit(True)))
    each = run.select("report_id", "run_no", clean_text("run.tool.driver.name", "unknown-sarif-tool", 200).alias("tool"), (~failed).alias("completed"), F.posexplode("run.results").alias("result_no", "r"))
    each = each.where(F.coalesce(F.col("r.baselineState") != "absent", F.lit(True)))
    rule_id = clean_text(F.coalesce(F.col("r.ruleId"), F.concat(F.lit("result-"), F.col("result_no").cast("string"))), "result", 200)
    listed = run.select("report_id", "run_no", F.posexplode("run.tool.driver.rules").alias("rule_no", "rule")).where("rule is not null")
    by_id = listed.where("rule.id is not null").groupBy("report_id", "run_no", F.col("rule.id").alias("k_id")).agg(F.min_by("rule", "rule_no").alias("by_id"))
    by_index = listed.groupBy("report_id", "run_no", F.col("rule_no").alias("k_no")).agg(F.first("rule").alias("by_index"))
    keyed = each.withColumns({"k_id": F.col("r.ruleId"), "k_no": F.col("r.ruleIndex")})
    found = keyed.join(by_id, ["report_id", "run_no", "k_id"], "left").join(by_index, ["report_id", "run_no", "k_no"], "left")
    located = found.select("report_id", "run_no", "tool", "completed", "r", rule_id.alias("rule_id"), F.coalesce("by_id", "by_index").alias("rule"), F.explode_outer("r.locations").alias("loc"))
    level = F.coalesce("r.level", "r.properties.severity", "rule.defaultConfiguration.level")
    precision = F.coalesce("r.properties.precision", "rule.properties.precision")
    base = F.when(F.col("r.baselineState").isin("new"), "new").when(F.col("r.baselineState").isin("unchanged", "updated"), "existing").otherwise("unknown")
    tags = F.array_join(F.coalesce("r.properties.tags", "rule.properties.tags", F.array().cast("array<string>")), " ")
    message = clean_text(F.coalesce("r.message.text", "r.message.markdown"), "no message", 1000)
    place = F.col("loc.physicalLocation")
    return located.select(
        F.concat_ws("#", "report_id", F.col("run_no").cast("string")).alias("report_id"), "tool", "rule_id", message.alias("message"), normalize_path(F.coalesce(place["artifactLocation"]["uri"], F.lit("")), repository).alias("path"),
        place["region"]["startLine"].alias("start_line"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"),
        ev.severity(level).alias("severity"), ev.confidence(precision).alias("confidence"), ev.category("rule_id", message, "tool", tags).alias("category"), base.alias("baseline_state"), "completed",
    )


def findings(reports: DataFrame, repository: str = "") -> DataFrame:
    """Findings of (report_id, payload) in the fixed format; a report of another version or kind gives none."""
    p = reports.select("report_id", F.from_json("payload", FINDINGS).alias("p")).where("p.schema_version = 1")
    f = p.select("report_id", F.col("p.tool.name").alias("tool"), (F.col("p.status") == "completed").alias("completed"), F.explode("p.findings").alias("f"))
    return f.select(
        "report_id", "tool", "f.rule_id", clean_text("f.message", "no message", 1000).alias("message"), normalize_path("f.path", repository).alias("path"), "f.start_line", F.coalesce("f.end_line", "f.start_line").alias("end_line"),
        ev.severity("f.severity").alias("severity"), ev.confidence("f.confidence").alias("confidence"),
        F.coalesce("f.category", ev.category("f.rule_id", "f.message", "tool")).alias("category"), F.coalesce("f.baseline_state", F.lit("unknown")).alias("baseline_state"), "completed",
    )


def read_reports(reports: DataFrame, repository: str = "") -> tuple[DataFrame, DataFrame]:
    """(findings of all readable reports, what became of each report)."""
    told = reports.withColumn("format", report_format("payload"))
    both = sarif(told.where("format = 'sarif'"), repository).select(*OUT).unionByName(findings(told.where("format = 'findings'"), repository).select(*OUT))
    return both, told.select("report_id", "format")
