"""Coverage ledgers, statuses and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a ledger.
STATES = ("pending", "reviewed", "needs-split", "replaced-by-split-units", "unreviewable-with-limit")


def coverage(units: DataFrame, by: list[str]) -> DataFrame:
    """Conditional counts over units (state, parsed, risk)."""
    return units.groupBy(*by).agg(
        F.count("*").alias("units"), F.count_if(F.col("state") == "reviewed").alias("reviewed"), F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if("parsed").alias("parsed"), F.count_if((F.col("risk") == "high") & (F.col("state") != "reviewed")).alias("high_risk_open"),
    )


def provider_status(units: DataFrame, by: list[str]) -> DataFrame:
    """The status that comes first of: budget-exhausted, partial, completed, unsupported."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    status = F.when(has("budget-exhausted"), "budget-exhausted").when(has("partial"), "partial").when(has("completed"), "completed").otherwise("unsupported")
    return units.groupBy(*by).agg(status.alias("provider_status"))


def overall_status(units: DataFrame, by: list[str]) -> DataFrame:
    """completed if every unit is, partial if some is, else unavailable; and the meet of completeness."""
    done = F.col("status") == "completed"
    least = F.min(F.when(F.col("status") == "completed", 2).when(F.col("status").isin("partial", "truncated"), 1).otherwise(0))
    return units.groupBy(*by).agg(
        F.when(F.every(done), "completed").when(F.some(done), "partial").otherwise("unavailable").alias("status"),
        F.element_at(F.array(F.lit("unavailable"), F.lit("partial"), F.lit("complete")), least + 1).alias("completeness"),
    )


def ledger_issues(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(repo_id, unit_id, issue): units missing from the ledger, unknown to the manifest, in several states, in an unknown state, or of mixed fingerprints."""
    m, one = manifest.select("repo_id", "unit_id").distinct(), ["repo_id", "unit_id"]
    per = ledger.groupBy(*one).agg(F.countDistinct("state").alias("states"), F.count_if(~F.col("state").isin(*STATES)).alias("odd"), F.countDistinct("fingerprint").alias("prints"))
    tag = lambda df, issue: df.select(*one, F.lit(issue).alias("issue"))
    return (
        tag(m.join(per, one, "left_anti"), "missing-from-ledger").unionByName(tag(per.join(m, one, "left_anti"), "not-in-manifest")).unionByName(tag(per.where("states > 1"), "several-states"))
        .unionByName(tag(per.where("odd > 0"), "unknown-state")).unionByName(tag(per.where("prints > 1"), "mixed-fingerprints"))
    )


def split_issues(ledger: DataFrame) -> DataFrame:
    """Units that need a split but have no children, and replaced units that are also reviewed."""
    needs = ledger.where("state = 'needs-split'").select("repo_id", "unit_id").distinct()
    children = ledger.where("parent_unit is not null").select("repo_id", F.col("parent_unit").alias("unit_id")).distinct()
    replaced = ledger.where("state = 'replaced-by-split-units'").select("repo_id", "unit_id").distinct()
    reviewed = ledger.where("state = 'reviewed'").select("repo_id", "unit_id").distinct()
    return needs.join(children, ["repo_id", "unit_id"], "left_anti").withColumn("issue", F.lit("split-without-children")).unionByName(
        replaced.join(reviewed, ["repo_id", "unit_id"], "left_semi").withColumn("issue", F.lit("replaced-and-reviewed"))
    )


def coverage_gap(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(repo_id, gap_units, material_units, gap): units not reviewed; a gap with high-risk units is material."""
    reviewed = ledger.where("state = 'reviewed'").select("repo_id", "unit_id").distinct()
    open_ = manifest.join(reviewed, ["repo_id", "unit_id"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("gap_units"), F.count_if(F.col("risk") == "high").alias("material_units"))
    all_ = manifest.select("repo_id").distinct().join(open_, "repo_id", "left").fillna(0, ["gap_units", "material_units"])
    return all_.withColumn("gap", F.when(F.col("gap_units") == 0, "empty").when(F.col("material_units") == 0, "non-material").otherwise("material"))


def verdicts(findings: DataFrame, gaps: DataFrame) -> DataFrame:
    """DO_NOT_COMMIT with a blocker or a material gap, else WITH_NOTES with any note, else SAFE."""
    per = findings.groupBy("repo_id").agg(F.bool_or(F.col("disposition") == "blocking-candidate").alias("blocked"), F.bool_or(F.col("disposition").isin("note", "priority-candidate")).alias("noted"))
    j = gaps.join(per, "repo_id", "left")
    verdict = F.when(F.coalesce("blocked", F.lit(False)) | (F.col("gap") == "material"), "DO_NOT_COMMIT").when(F.coalesce("noted", F.lit(False)) | (F.col("gap") == "non-material"), "WITH_NOTES").otherwise("SAFE")
    return j.select("repo_id", "gap", verdict.alias("verdict"))


def first_available(inputs: DataFrame, by: list[str]) -> DataFrame:
    """The available input of the highest authority (least rank) per group; ties by name."""
    return inputs.where("available").groupBy(*by).agg(F.min_by("input", F.struct("authority", "input")).alias("input"))
