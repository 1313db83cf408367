"""Orderings of closed vocabularies, encoded once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of severity, confidence, disposition and completeness.
SEVERITY = {"critical": 5, "error": 4, "warning": 3, "note": 2, "none": 1, "unknown": 0}
CONFIDENCE = {"very-high": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}
DISPOSITION = {"blocking-candidate": 0, "priority-candidate": 1, "note": 2, "outside-scope": 3}
BASELINE = {"new": 2, "existing": 1, "unknown": 0}
COMPLETENESS = {"complete": 2, "partial": 1, "unavailable": 0}


def rank(value: Column | str, order: dict[str, int]) -> Column:
    """The rank of a word; the least for null and unknown words."""
    column = F.col(value) if isinstance(value, str) else value
    out = F.lit(min(order.values()))
    for word, n in order.items():
        out = F.when(column == word, F.lit(n)).otherwise(out)
    return out


def word(value: Column | str, order: dict[str, int]) -> Column:
    """The word of a rank."""
    column = F.col(value) if isinstance(value, str) else value
    return F.element_at(F.create_map(*[x for w, n in order.items() for x in (F.lit(n), F.lit(w))]), column.cast("int"))


def sql_rank(expression: str, order: dict[str, int]) -> str:
    """The same rank in SQL."""
    return "CASE " + " ".join(f"WHEN {expression} = '{w}' THEN {n}" for w, n in order.items()) + f" ELSE {min(order.values())} END"
