"""Diff text to lines, hunks, numbered added lines and changed ranges.

All are one explode and windows over the lines of one diff, so a diff is the
largest thing one task holds; the number of diffs is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import hunk_part

HEADER = "^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+(?:,[0-9]+)? @@"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(split_id, repo_id, path, line_no, line) of (split_id, repo_id, path, diff_text); repeated diffs count once."""
    once = diffs.select("split_id", "repo_id", "path", "diff_text").where("diff_text is not null").distinct()
    lines = F.posexplode(F.split("diff_text", "\n"))
    return once.select("split_id", "repo_id", "path", lines.alias("at", "line")).select(
        "split_id", "repo_id", "path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line")
    )


def numstat(lines: DataFrame) -> DataFrame:
    """(split_id, additions, deletions)."""
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++ ")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("--- ")
    return lines.groupBy("split_id").agg(F.count_if(plus).alias("additions"), F.count_if(minus).alias("deletions"))


def current_files(lines: DataFrame) -> DataFrame:
    """Lines with the file of the last ``+++ b/`` header above them, carried forward; the diff's own path before any."""
    order = Window.partitionBy("split_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)"))
    return lines.withColumn("current_file", F.coalesce(F.last(header, ignorenulls=True).over(order), "path"))


def hunk_lines(lines: DataFrame) -> DataFrame:
    """Lines within hunks: hunk_no from 1, its header and starts, and the line's offset in it."""
    order = Window.partitionBy("split_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("line").rlike(HEADER)
    numbered = lines.withColumn("hunk_no", F.sum(begins.cast("int")).over(order).cast("int"))
    numbered = numbered.withColumn("hunk_header", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(order))
    return numbered.where("hunk_no > 0")


def hunks(lines: DataFrame) -> DataFrame:
    """One row per hunk: ordinal, header, its four numbers, and its bytes with line ends."""
    inside = hunk_lines(lines)
    parts = {p: hunk_part("hunk_header", p) for p in ("old_start", "old_count", "new_start", "new_count")}
    return inside.groupBy("split_id", "hunk_no", "hunk_header").agg(
        F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("hunk_bytes")
    ).select("split_id", "hunk_no", "hunk_header", "n_lines", "hunk_bytes", *[c.alias(p) for p, c in parts.items()])


def added_lines(lines: DataFrame) -> DataFrame:
    """(split_id, path, hunk_no, new_line): number on the new side of each added line."""
    inside = hunk_lines(lines).where(~F.col("line").rlike(HEADER))
    counts = ~(F.col("line").startswith("-") | F.col("line").startswith("\\"))
    before = Window.partitionBy("split_id", "hunk_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    number = hunk_part("hunk_header", "new_start") + F.coalesce(F.sum(counts.cast("int")).over(before), F.lit(0))
    return inside.withColumn("new_line", number.cast("int")).where(F.col("line").startswith("+")).select(
        "split_id", "path", "hunk_no", "new_line"
    )


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(split_id, start_line, end_line, deletion_anchor) of each hunk; a hunk without new lines anchors at max(start, 1)."""
    h = hunks(lines)
    empty = F.col("new_count") == 0
    start = F.when(empty, F.greatest("new_start", F.lit(1))).otherwise(F.col("new_start"))
    end = F.when(empty, start).otherwise(F.col("new_start") + F.col("new_count") - 1)
    return h.select("split_id", "hunk_no", start.alias("start_line"), end.alias("end_line"), empty.alias("deletion_anchor"))
