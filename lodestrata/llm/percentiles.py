"""Percentiles of very large numeric columns by exact bisection.

Every (group, percentile) keeps an interval of values that holds its target
rank. Each pass counts, for all of them at once, the rows in equal sections of
the interval, sums the counts from below and keeps the one section that holds
the rank, shrunk to the least and greatest value found in it. ``sections=2`` is
plain bisection; more sections mean fewer passes.

Counts are additive: rows of separate days, partitions or deliveries are united
before a pass, or counted apart and put together by ``merge_weights``, with the
same result as one run over all rows.

No value is ever shuffled. A pass moves one partial count per interval, section
and map task, so a group that holds a third of all rows costs no more than any
other. The first two passes read the source; from then on only the rows that lie
in an open section are kept, about one in ``sections``. Intervals are joined by
broadcast only while their number is checked to be small, otherwise by a shuffle
that adaptive execution may split.

Defined results: whole numbers of 64 bits, decimals and floating values alike,
with the type of the column; a null group column is a group of its own; null and
NaN values, and values under ``least``, do not count; a group without values
gives no row; ties and repeated values count each; the percentile is the value
at rank ceil(p n), exact with ``error=0`` and else within the relative ``error``.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.lineage import BROADCAST_ROWS, cut, small

SECTIONS = 16


def counting(df: DataFrame, groups: Sequence[str], value: str, part: str | None = None, least: int | None = None) -> DataFrame:
    """(groups, [part], value) of the rows that count."""
    kind = df.schema[value].dataType
    v = F.col(value).cast("bigint") if isinstance(kind, T.IntegralType) else F.col(value).cast("double") if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col(value)
    kept = df.select(*groups, *([part] if part else []), v.alias("value")).where("value is not null")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        kept = kept.where(~F.isnan("value"))
    return kept if least is None else kept.where(F.col("value") >= least)


def weights(df: DataFrame, groups: Sequence[str], value: str, part: str | None = None, least: int | None = None) -> DataFrame:
    """(groups, [part], value, n): how often each value occurs in each part; what a part may store to be put together later."""
    kept = counting(df, groups, value, part, least)
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


def merge_weights(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Weights of all parts put together."""
    return parts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _same(left: DataFrame, right: DataFrame, groups: Sequence[str]):
    on = F.lit(True)
    for g in groups:
        on = on & left[g].eqNullSafe(right[f"k_{g}"])
    return on


def _distance(kind: T.DataType, log: bool):
    """How far b lies above a, as a double that never falls while b rises."""
    if isinstance(kind, T.DoubleType):
        bound = F.lit(1.7e308)
        flat = lambda c: F.greatest(F.least(c, bound), -bound)
        if log:
            flat = lambda c: F.signum(c) * F.log1p(F.abs(F.greatest(F.least(c, bound), -bound)) * F.lit(1e150))
        return lambda a, b: flat(b) / 2 - flat(a) / 2
    return lambda a, b: F.coalesce(F.try_subtract(b, a).cast("double"), b.cast("double") - a.cast("double"))


def _section(kind: T.DataType, sections: int, log: bool) -> Column:
    """The section of ``value`` within [lo, hi]; the ends have one of their own each, so that every pass narrows."""
    far = _distance(kind, log)
    share = far(F.col("lo"), F.col("value")) / far(F.col("lo"), F.col("hi")) * sections
    inner = F.least(F.greatest(F.floor(F.when(far(F.col("lo"), F.col("hi")) > 0, share).otherwise(F.lit(0.0))), F.lit(0)), F.lit(sections - 1))
    return F.when(F.col("value") == F.col("lo"), F.lit(-1)).when(F.col("value") == F.col("hi"), F.lit(sections)).otherwise(inner).cast("int")


def percentiles(rows: DataFrame, groups: Sequence[str], wanted: Sequence[str], sections: int = SECTIONS, error: float = 0.0) -> DataFrame:
    """One row (groups, pct, value, n) per group and wanted percentile.

    ``rows``: (groups, value), or weights with ``n``. ``wanted``: percentiles as
    decimal text (``"0.95"``), so that the rank ceil(p n) is computed in whole
    numbers.
    """
    ratios = [(p, Fraction(p)) for p in wanted]
    if any(not 0 < q <= 1 for _, q in ratios):
        raise ValueError("a percentile lies in (0, 1]")
    rows = rows.select(*groups, "value", F.col("n").cast("bigint").alias("m") if "n" in rows.columns else F.lit(1).cast("bigint").alias("m"))
    kind = rows.schema["value"].dataType
    targets = F.array(*[
        F.struct(F.lit(p).alias("pct"), F.expr(f"(n * {q.numerator} + {q.denominator - 1}) div {q.denominator}").alias("rank"))
        for p, q in ratios
    ])
    spans = rows.groupBy(*groups).agg(F.sum("m").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = cut(spans.withColumn("gid", F.monotonically_increasing_id())).select(*groups, "gid", "n", "lo", "hi", F.explode(targets).alias("t"))
    state = state.select(*groups, "gid", "n", "lo", "hi", "t.pct", F.col("t.rank").alias("rank"))  # rank: within [lo, hi]
    far = _distance(kind, False)
    wide = F.col("lo") < F.col("hi")
    if error:
        wide = wide & (far(F.col("lo"), F.col("hi")) > F.abs(F.col("lo").cast("double")) * F.lit(error / (2 if isinstance(kind, T.DoubleType) else 1)))
    held, turn = None, 0
    while n_open := state.where(wide).count():
        turn += 1
        open_ = state.where(wide)
        sent = F.broadcast if n_open <= BROADCAST_ROWS else (lambda df: df)
        # the intervals of a group are the same or apart, so a value lies in at most one
        spaces = open_.select(*[F.col(g).alias(f"k_{g}") for g in groups], F.col("gid").alias("k_gid"), "lo", "hi").distinct()
        source = rows if turn <= 2 else held
        on = _same(rows, spaces, groups) if turn <= 2 else held["gid"] == spaces["k_gid"]
        placed = source.join(sent(spaces), on & F.col("value").between(F.col("lo"), F.col("hi"))).select(F.col("k_gid").alias("gid"), "lo", "hi", "value", "m")
        if turn == 2:
            placed = cut(placed)
            held = placed.select("gid", "value", "m")
        at = placed.groupBy("gid", "lo", _section(kind, sections, log=turn % 2 == 0).alias("section")).agg(F.sum("m").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
        order = Window.partitionBy("gid", "lo").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
        below = at.withColumn("upto", F.sum("m").over(order)).select(F.col("gid").alias("k_gid"), F.col("lo").alias("k_lo"), "m", "least", "most", "upto")
        hit = open_.join(below, (open_.gid == below.k_gid) & (open_.lo == below.k_lo) & (open_["rank"] <= below.upto) & (open_["rank"] > below.upto - below.m))
        moved = hit.select(*groups, "gid", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), "pct", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
        state = cut(state.where(~wide).unionByName(moved))
    return state.select(*groups, "pct", F.col("lo").alias("value"), "n")


def run_samples(runs: DataFrame) -> DataFrame:
    """(baseline_id, platform_id, run_date, sample) of runs, each run_id once, failed probes left out.

    Deliveries of a run carry the same samples; the earliest received one counts.
    Only run ids are shuffled to find those delivered more than once; samples move
    for those alone. Rows without a run_id cannot be told apart and count each.
    """
    runs = runs.select("run_id", "received_at", "baseline_id", "platform_id", "run_date", "samples_ms")
    again = cut(runs.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("deliveries")).where("deliveries > 1").select("run_id"))
    once = runs.join(small(again), "run_id", "left_anti").select("baseline_id", "platform_id", "run_date", "samples_ms")
    run = F.struct("received_at", "baseline_id", "platform_id", "run_date", "samples_ms")
    several = runs.join(small(again), "run_id", "left_semi").groupBy("run_id").agg(F.min(run).alias("run"))
    first = cut(several.select("run.baseline_id", "run.platform_id", "run.run_date", "run.samples_ms"))
    return once.unionByName(first).select("baseline_id", "platform_id", "run_date", F.explode("samples_ms").alias("sample"))


def daily_weights(runs: DataFrame) -> DataFrame:
    """Weights per (baseline_id, platform_id, run_date): the part that days contribute."""
    return weights(run_samples(runs), ["baseline_id", "platform_id"], "sample", "run_date", least=0)


def group_percentiles(runs: DataFrame, wanted: Sequence[str] = ("0.5", "0.9", "0.95", "0.99")) -> DataFrame:
    """Percentiles per (baseline_id, platform_id) over the samples of all days."""
    groups = ["baseline_id", "platform_id"]
    return percentiles(counting(run_samples(runs), groups, "sample", least=0), groups, wanted)


def wrong_baselines(reviewed: DataFrame, runs: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """(baseline_id, platform_id) whose reviewed p95_ms is more than ``tolerance`` away from the 95th percentile.

    A reviewed row without p95_ms or without samples is not decided and gives no row.
    """
    t = Fraction(tolerance)
    p95 = group_percentiles(runs, ["0.95"]).select("baseline_id", "platform_id", F.col("value").alias("actual"))
    both = reviewed.select("baseline_id", "platform_id", "p95_ms").join(p95, ["baseline_id", "platform_id"])
    away = F.abs(F.col("p95_ms").cast("decimal(20,0)") - F.col("actual")) * t.denominator > F.col("actual") * t.numerator
    return both.where(away).select("baseline_id", "platform_id").distinct()
