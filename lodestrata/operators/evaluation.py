"""Latency gates, case comparison and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ordered import _same, prefix_sum


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Value at rank ceil(n p / 100) per group; null values do not count.

    Values are counted first; the rank is looked up in running counts, so that no
    task holds all values of a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    running = prefix_sum(counted, by, ["__value"], "__n", "__upto")
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("n")).select(*[F.col(b).alias(f"{b}__k") for b in by], "n")
    j = running.join(totals, _same(running, totals, by))
    at = {f"p{p}": F.min(F.when(F.col("__upto") * 100 >= F.col("n") * p, F.col("__value"))) for p in percents}
    return j.groupBy(*by).agg(*[c.alias(k) for k, c in at.items()], F.max("n").alias("n"))


def gate_limit(p95: Column | str) -> Column:
    """ceil(p95 * 5 / 4) + 250, in whole numbers."""
    c = F.col(p95) if isinstance(p95, str) else p95
    return F.floor((c * 5 + 3) / 4).cast("bigint") + 250


def gate(observed: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, observed, limit, passed) of groups with a reviewed figure."""
    j = observed.join(reviewed, keys)
    return j.select(*keys, "observed", gate_limit("p95_ms").alias("limit"), (F.col("observed") <= gate_limit("p95_ms")).alias("passed"))


def compare_cases(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer join on case_id: added, removed, fixed, regressed or same."""
    b = baseline.select("case_id", F.col("passed").alias("was"))
    c = current.select("case_id", F.col("passed").alias("now"))
    j = b.join(c, "case_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was") & F.col("now"), "fixed").otherwise("same")
    return j.select("case_id", "was", "now", change.alias("change"))


def case_report(compared: DataFrame) -> DataFrame:
    return compared.groupBy("change").agg(F.count("*").alias("cases"), F.array_sort(F.collect_list("case_id")).alias("case_ids"))


def term_recall(findings: DataFrame, text: Column | str) -> Column:
    """Whether all terms of a finding occur in the text, in any case; no terms are met."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.forall("terms", lambda t: F.contains(low, F.lower(t)))


def grade(responses: DataFrame) -> DataFrame:
    """Verdict equal, all of must_include present, none of must_not_include present. Missing lists ask nothing, a missing verdict is not compared."""
    low = F.lower("response")
    empty = F.array().cast("array<string>")
    inside = F.forall(F.coalesce("must_include", empty), lambda t: F.contains(low, F.lower(t)))
    outside = ~F.exists(F.coalesce("must_not_include", empty), lambda t: F.contains(low, F.lower(t)))
    verdict = F.coalesce(F.contains(low, F.lower("verdict")), F.lit(True))
    return responses.withColumns({"verdict_ok": verdict, "include_ok": inside, "exclude_ok": outside, "passed": verdict & inside & outside})


def recall_by(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, cases, met, recall in percent, rounded down): how many cases had all their terms."""
    met = F.count_if("met")
    return results.groupBy(*by).agg(F.count("*").alias("cases"), met.alias("n_met"), F.expr("count_if(met) * 100 div count(*)").alias("recall"))


def recall_delta(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(by, was, now, delta) of two recalls; a group on one side only has the other null and no delta."""
    b = recall_by(baseline, by).select(*by, F.col("recall").alias("was"))
    c = recall_by(current, by).select(*by, F.col("recall").alias("now"))
    return b.join(c, by, "full_outer").withColumn("delta", F.col("now") - F.col("was"))
