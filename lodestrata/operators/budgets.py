"""Running budgets with honest partiality: what was left out is told.

Prefix budgets are running sums per group, spread over tasks by range. Greedy
budgets depend on every earlier choice: small groups are folded in a task, large
ones take rounds of running sums, each of which settles all groups up to their
next rejection and drops what can no longer fit.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, small
from lodestrata.operators.ordered import _same, prefix_sum, rank


def prefix_budget(rows: DataFrame, by: list[str], order: list[str], cost: str, limit: int) -> DataFrame:
    """Rows with ``running`` and ``accepted``: in order while the running cost is within the limit; costs are not negative."""
    return prefix_sum(rows, by, order, cost).withColumn("accepted", F.col("running") <= limit)


FOLD_ROWS = 200_000  # a group of so many rows is folded in one task, beyond it budgets take rounds


def greedy_budget(rows: DataFrame, by: list[str], order: list[str], cost: str, limit: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rows with ``accepted``: in order, each that still fits; a rejected cost is not consumed, later cheaper rows may fit.

    Groups counted to have at most ``fold_rows`` rows are folded each in a task,
    keys and costs only. Larger ones take rounds of running sums: a round accepts
    the pending rows up to the first that does not fit; that one is rejected, as
    are all later ones dearer than what remains. What then pends fits, so each
    round but the last accepts rows, and the budget bounds their number. A missing
    cost is 0.
    """
    keys = [*by, *order]
    narrow = rows.select(*keys, F.coalesce(F.col(cost).cast("bigint"), F.lit(0)).alias("__cost")).where(F.col("__cost") <= limit)
    large = cut(narrow.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > fold_rows).select(*[F.col(b).alias(f"{b}__k") for b in by]))
    few = narrow if not large.head(1) else narrow.join(small(large), _same(narrow, large, by), "left_anti")
    taken = [_folded(few, by, order, limit)]
    if large.head(1):
        taken += _in_rounds(narrow.join(small(large), _same(narrow, large, by), "left_semi"), by, order, limit)
    accepted = reduce(DataFrame.unionByName, taken).select(*[F.col(k).alias(f"{k}__k") for k in keys], F.lit(True).alias("__yes"))
    return rows.join(accepted, _same(rows, accepted, keys), "left").select(*rows.columns, F.coalesce("__yes", F.lit(False)).alias("accepted"))


def _folded(few: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Keys of accepted rows of groups that fit a task."""
    numbered = few.withColumn("__row", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__row", "__cost"))).alias("__rows"))

    @F.pandas_udf("array<boolean>")
    def fold(costs: pd.Series) -> pd.Series:
        def one(group):
            used, out = 0, []
            for c in group:
                fits = used + c <= limit
                out.append(fits)
                used += c if fits else 0
            return out

        return costs.map(one)

    marked = numbered.withColumn("__fits", fold(F.col("__rows")["__cost"]))
    each = marked.select(*by, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__fits").alias("f"))).alias("x")).where("x.f")
    return each.select(*by, *[F.col(f"x.r.__row.c{i}").alias(c) for i, c in enumerate(order)])


def _in_rounds(pending: DataFrame, by: list[str], order: list[str], limit: int) -> list[DataFrame]:
    """Keys of accepted rows of groups of any size."""
    keys, taken = [*by, *order], []
    pending = pending.withColumn("__left", F.lit(limit).cast("bigint"))
    while True:
        run = cut(prefix_sum(pending, by, order, "__cost", "__run"))
        taken.append(run.where("__run <= __left").select(*keys))
        state = run.groupBy(*by).agg(
            F.min(F.when(F.col("__run") > F.col("__left"), F.struct(*order))).alias("__first"), (F.max("__left") - F.coalesce(F.max(F.when(F.col("__run") <= F.col("__left"), F.col("__run"))), F.lit(0))).alias("__rest"),
        ).where("__first is not null")
        state = state.select(*[F.col(b).alias(f"{b}__k") for b in by], "__first", "__rest")
        later = run.join(state, _same(run, state, by)).where((F.struct(*order) > F.col("__first")) & (F.col("__cost") <= F.col("__rest")))
        pending = cut(later.select(*keys, "__cost", F.col("__rest").alias("__left")))
        if not pending.head(1):
            return taken


def high_water(rows: DataFrame, by: list[str], observed: str, limit: int) -> DataFrame:
    """(by, high_water, exceeded): the greatest observation up to the limit, and whether any was above."""
    return rows.groupBy(*by).agg(F.max(F.least(F.col(observed), F.lit(limit))).alias("high_water"), F.coalesce(F.bool_or(F.col(observed) > limit), F.lit(False)).alias("exceeded"))


def run_budget(runs: DataFrame, by: list[str], order: list[str], cost: str, limit: int) -> DataFrame:
    """Runs with ``state``: executed while earlier runs have not used up the budget, then not-run; and what remains after each."""
    upto = prefix_sum(runs, by, order, cost, "__upto")
    before = F.col("__upto") - F.coalesce(F.col(cost), F.lit(0))
    return upto.withColumns({"state": F.when(before < limit, "executed").otherwise("not-run"), "remaining": F.greatest(F.lit(limit) - F.col("__upto"), F.lit(0))}).drop("__upto")


def evict(generations: DataFrame, by: list[str], retain: int, most_bytes: int) -> DataFrame:
    """Generations with ``evicted``: oldest first while the rest is over ``most_bytes``, never one of the ``retain`` newest.

    When the turn of a generation comes, what is left is it and all newer ones, so
    a running sum from the newest decides.
    """
    order = [F.desc("modified"), F.col("key")]
    ranked = prefix_sum(rank(generations, by, order, "age_rank"), by, order, "bytes", "__newer")
    return ranked.withColumn("evicted", (F.col("age_rank") > retain) & (F.col("__newer") > most_bytes)).drop("__newer")


def edge_budget(edges: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` edges in order, and one limitation per (path, kind) that lost some."""
    kept = edges.orderBy(*order).limit(limit)
    lost = edges.join(kept.select("edge_id"), "edge_id", "left_anti").groupBy("path", "kind").agg(F.count("*").alias("lost"))
    return kept, lost.select(F.lit("edge-budget-exhausted").alias("code"), "path", "kind", "lost")


def presentation_budget(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Rows with ``kept``: those of least ``importance`` go first, from the tail, until the sizes fit.

    ``rows``: by, importance (0 most important), seq, bytes. A row stays if it and
    all more important ones fit.
    """
    return prefix_sum(rows, by, ["importance", "seq"], "bytes", "__upto").withColumn("kept", F.col("__upto") <= limit).drop("__upto")


def cascade(children: DataFrame, kept_parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent was kept, or that have none."""
    return children.where(F.col(key).isNull()).unionByName(children.join(kept_parents.select(key).distinct(), key, "left_semi").select(*children.columns))
