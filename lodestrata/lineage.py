"""Cutting lineage so that a lost executor costs one stage, not the whole plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many (narrow) rows, after they were counted.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that name nothing is
    written there. Only on one machine (a local master), as in tests, a temporary
    folder is made where it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made.

    A checkpointed frame still carries the size that was estimated for the plan
    behind it, and joins multiply estimates: over the rounds of a loop they grow
    beyond any memory. The frame returned here has no such estimate.
    """
    shared_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    frame = df.sparkSession._jsparkSession.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False)
    return DataFrame(frame, df.sparkSession)


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; stops counting there."""
    return df.select().limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it was counted to have at most ``limit`` rows."""
    return F.broadcast(df) if rows_at_most(df, limit) else df
