"""Facts to symbols, edges and summaries, deduplicated by content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.functions.ranks import CONFIDENCE, rank
from lodestrata.operators.facts import summary_kind

# Confidence of symbols and of edges by the quality of parsing.
SYMBOL_CONFIDENCE = {"clean": "high", "recovered": "medium", "degraded": "low"}
EDGE_CONFIDENCE = {"clean": "medium", "recovered": "low", "degraded": "low"}


def keep_best(rows: DataFrame, key: str, tiebreak: list[str]) -> DataFrame:
    """One row per id: greatest confidence, ties to the least canonical form. A grouped maximum, no sort."""
    others = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(-rank("confidence", CONFIDENCE), *tiebreak))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per id, the first in order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def parse_quality(errors: Column, touched: Column) -> Column:
    """clean without errors, degraded if an error touches a change, else recovered."""
    return F.when(~errors, "clean").when(touched, "degraded").otherwise("recovered")


def by_quality(quality: Column | str, table: dict[str, str]) -> Column:
    c = F.col(quality) if isinstance(quality, str) else quality
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c)


def edge_id(provider: str, path: str, kind: Column, identity: Column, source: Column, target: Column, resolution: Column) -> Column:
    return ids.stable_id("impact-edge/v1", provider, path, kind, identity, source, target, resolution)


def fact_edges(facts: DataFrame) -> DataFrame:
    """Edges of facts: a file defines each symbol, exports public ones, imports and calls by name.

    ``facts``: provider_id, path, kind, name, visibility, identity, quality.
    """
    file = F.concat(F.lit("file:"), F.col("path"))
    symbol = ids.stable_id("impact-symbol/v1", "provider_id", "path", "kind", "identity", F.lit(""), "name")
    is_symbol = ~F.col("kind").isin("import", "call", "macro")
    rows = F.array_compact(F.array(
        F.when(is_symbol, F.struct(F.lit("defines").alias("edge_kind"), symbol.alias("to_symbol"), F.lit(None).cast("string").alias("unresolved_target"), F.lit("syntactic").alias("resolution"))),
        F.when(is_symbol & F.coalesce(F.col("visibility").startswith("pub"), F.lit(False)), F.struct(F.lit("exports").alias("edge_kind"), symbol.alias("to_symbol"), F.lit(None).cast("string").alias("unresolved_target"), F.lit("syntactic").alias("resolution"))),
        F.when(F.col("kind") == "import", F.struct(F.lit("imports").alias("edge_kind"), F.lit(None).cast("string").alias("to_symbol"), F.col("name").alias("unresolved_target"), F.lit("syntactic").alias("resolution"))),
        F.when(F.col("kind").isin("call", "macro"), F.struct(F.lit("calls").alias("edge_kind"), F.lit(None).cast("string").alias("to_symbol"), F.col("name").alias("unresolved_target"), F.when(F.col("kind") == "macro", "unresolved").otherwise("syntactic").alias("resolution"))),
    ))
    each = facts.select("*", file.alias("from_symbol"), F.explode(rows).alias("e")).select("provider_id", "path", "identity", "from_symbol", by_quality("quality", EDGE_CONFIDENCE).alias("confidence"), "e.*")
    target = F.coalesce("to_symbol", "unresolved_target")
    keyed = each.withColumn("edge_id", edge_id("provider_id", "path", F.col("edge_kind"), F.col("identity"), F.col("from_symbol"), target, F.col("resolution")))
    return keep_best(keyed, "edge_id", ["path", "from_symbol"])


def unit_summaries(facts: DataFrame) -> DataFrame:
    """One summary per fact whose kind leads to one. ``facts``: fact_id, kind, path, rule_id, confidence."""
    kind = summary_kind("kind")
    message = F.format_string("%s in %s by rule %s", kind, F.col("path"), F.col("rule_id"))
    s = facts.withColumn("summary_kind", kind).where("summary_kind is not null")
    sid = ids.stable_id("impact-summary/v1", "summary_kind", "path", F.lit(""), "rule_id", "fact_id")
    return first_wins(s.select(sid.alias("summary_id"), "summary_kind", "path", "confidence", message.alias("message"), "fact_id"), "summary_id", ["fact_id"])


def evidence_ids(facts: DataFrame, by: list[str]) -> DataFrame:
    """Sorted distinct fact ids per group."""
    return facts.groupBy(*by).agg(F.array_sort(F.collect_set("fact_id")).alias("evidence_fact_ids"))
