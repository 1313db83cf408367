"""Contract checks: each gives rows of violations, never an exception, so that all are seen at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ordered import before_in_order


def _rule(df: DataFrame, rule: str, ref) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(ref).cast("string").alias("ref") if isinstance(ref, str) else ref.cast("string").alias("ref"))


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Ids that occur more than once."""
    return _rule(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), rule, key)


def dangling(df: DataFrame, column: str, known: DataFrame, key: str, rule: str) -> DataFrame:
    """References to ids that do not exist; null references are allowed."""
    k = known.select(F.col(key).alias("known_id")).distinct()
    return _rule(df.where(F.col(column).isNotNull()).join(k, df[column] == k.known_id, "left_anti").select(column).distinct(), rule, column)


def where(df: DataFrame, test: str, rule: str, ref: str) -> DataFrame:
    """Rows that meet the SQL test of a violation."""
    return _rule(df.where(test), rule, ref)


def unsorted(df: DataFrame, by: str, place: str, key: str, rule: str) -> DataFrame:
    """Groups whose ids do not rise strictly in the order of ``place``; compared within parts of a group and across their edges."""
    return _rule(before_in_order(df.select(by, place, key), [by], [place], key, "before").where(F.col("before") >= F.col(key)).select(by).distinct(), rule, by)


def bad_digest(df: DataFrame, column: str, rule: str, ref: str) -> DataFrame:
    """Values that are not 64 lower-case hex digits."""
    return _rule(df.where(F.col(column).isNotNull() & ~F.col(column).rlike("^[0-9a-f]{64}$")), rule, ref)


def both_ways(left: DataFrame, right: DataFrame, keys: list[str], rules: tuple[str, str]) -> DataFrame:
    """Keys on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    ref = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return _rule(a.join(b, keys, "left_anti"), rules[0], ref).unionByName(_rule(b.join(a, keys, "left_anti"), rules[1], ref))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def edge_contract(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """A graph before publishing: unique ids, known ends, exactly one of target and unresolved target, known confidence."""
    return all_of([
        duplicates(edges, "edge_id", "edge-id-unique"), dangling(edges, "from_symbol", symbols, "symbol", "edge-source-known"), dangling(edges, "to_symbol", symbols, "symbol", "edge-target-known"),
        where(edges, "(to_symbol is null) = (unresolved_target is null)", "edge-target-xor", "edge_id"), where(edges, "confidence not in ('high', 'medium', 'low')", "edge-confidence", "edge_id"),
    ])


def accounting(runs: DataFrame, by: str) -> DataFrame:
    """Groups in which what was consumed and what remains do not add up to the initial budget."""
    return _rule(runs.groupBy(by).agg(F.max("initial").alias("i"), F.sum("consumed").alias("c"), F.min("remaining").alias("r")).where("i <> c + r"), "budget-accounting", by)


def json_mismatch(df: DataFrame, columns: list[str], json_column: str, rule: str, ref: str) -> DataFrame:
    """Rows whose columns differ from their stored canonical JSON."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    stored = F.from_json(json_column, schema)
    differs = ~stored.eqNullSafe(F.struct(*columns))
    return _rule(df.where(differs), rule, ref)


def not_canonical(df: DataFrame, array_column: str, rule: str, ref: str) -> DataFrame:
    """Rows whose array is not sorted and distinct."""
    return _rule(df.where(F.col(array_column).isNotNull() & (F.array_sort(F.array_distinct(array_column)) != F.col(array_column))), rule, ref)
