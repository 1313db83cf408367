"""Running sums and ranks of groups of any size.

A window sorts a whole group in one task, which a group that holds a third of
all rows does not survive. Here rows are range-partitioned by group and order
instead, so that a large group spreads over many tasks. Each task sums its part;
the sums before a part are a small table (one row per group and part it touches);
a window then runs within a part only. Order keys are unique within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.lineage import cut, small


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = left[keys[0]].eqNullSafe(right[f"{keys[0]}__k"])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[f"{k}__k"])
    return on


def prefix_sum(rows: DataFrame, by: list[str], order: list[str | Column], value: str | Column, name: str = "running") -> DataFrame:
    """Rows with the sum of ``value`` over their group up to and with them; null values add nothing."""
    v = F.col(value) if isinstance(value, str) else value
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("__v", F.coalesce(v, F.lit(0)).cast("bigint")).repartitionByRange(parts, *by, *order)
    held = cut(spread.withColumn("__part", F.spark_partition_id()))
    sums = held.groupBy(*by, "__part").agg(F.sum("__v").alias("__s"))
    sums = cut(sums)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(b).alias(f"{b}__k") for b in by], F.col("__part").alias("__part__k"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("__local", F.sum("__v").over(within))
    joined = local.join(small(before), _same(local, before, [*by, "__part"]))
    return joined.withColumn(name, F.col("__before") + F.col("__local")).select(*rows.columns, name)


def rank(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Rows with their number in their group, from 1."""
    return prefix_sum(rows, by, order, F.lit(1), name)


def last_before(rows: DataFrame, by: list[str], order: list[str | Column], value: str, name: str = "last") -> DataFrame:
    """Rows with the last non-null ``value`` of their group up to and with them, by parts as in ``prefix_sum``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    lasts = cut(held.where(F.col(value).isNotNull()).groupBy(*by, "__part").agg(F.max_by(F.struct(value), at).alias("__own")))
    touched = held.select(*by, "__part").distinct().join(lasts.select(*[F.col(b).alias(f"{b}__k") for b in by], F.col("__part").alias("__part__k"), "__own"), _same_named(by), "left")
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = touched.select(*[F.col(b).alias(f"{b}__k") for b in by], F.col("__part").alias("__part__k"), F.last("__own", ignorenulls=True).over(earlier).alias("__before"))
    before = cut(before.select(*[f"{b}__k" for b in by], "__part__k", F.col("__before")[value].alias("__before")))
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("__local", F.last(F.col(value), ignorenulls=True).over(within))
    joined = local.join(small(before), _same(local, before, [*by, "__part"]))
    return joined.withColumn(name, F.coalesce("__local", "__before")).select(*rows.columns, name)


def _same_named(by: list[str]) -> Column:
    on = F.col("__part") == F.col("__part__k")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    return on


def before_in_order(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Rows with the ``value`` of the row before them in their group, null for the first, by parts as in ``prefix_sum``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    lasts = held.groupBy(*by, "__part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__own"))
    earlier = Window.partitionBy(*by).orderBy("__part")
    before = lasts.select(*[F.col(b).alias(f"{b}__k") for b in by], F.col("__part").alias("__part__k"), F.lag("__own").over(earlier)[value].alias("__before"))
    before = cut(before)
    within = Window.partitionBy(*by, "__part").orderBy(*order)
    local = held.withColumns({"__first": F.row_number().over(within) == 1, "__local": F.lag(value).over(within)})
    joined = local.join(small(before), _same(local, before, [*by, "__part"]))
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__local"))).select(*rows.columns, name)
