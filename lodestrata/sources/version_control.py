"""Listings and diffs of version control as relations: decoders of NUL-separated output, blobs, and the choice of a diff source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import is_binary, valid_repo_path
from lodestrata.operators.ordered import prefix_sum


def _decoded(raw: DataFrame, column: str, read, fields: str) -> DataFrame:
    """Rows that ``read`` makes of each output's tokens, and one with ``rejected`` for a tail it cannot read."""
    names = ["source", "ordinal", *[f.split()[0] for f in fields.split(", ")], "rejected"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, text in zip(batch["source"], batch["raw"]):
                tokens = (text or "").split("\0")
                if tokens[-1] == "":
                    tokens.pop()  # the end of the last entry
                at = n = 0
                while at < len(tokens):
                    entry, used = read(tokens, at)
                    if not used:
                        break
                    n += 1
                    rows.append((source, n, *entry, None))
                    at += used
                if at < len(tokens):
                    rows.append((source, n + 1, *[None] * (len(names) - 3), "\0".join(tokens[at:])))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return raw.select("source", F.col(column).alias("raw")).mapInPandas(run, f"source string, ordinal int, {fields}, rejected string")


def _status_entry(tokens: list[str], at: int):
    two = tokens[at][:1] in ("R", "C")
    paths = tokens[at + 1:at + 2 + two]
    if not tokens[at] or len(paths) < 1 + two or not all(paths):
        return None, 0
    return (tokens[at], paths[-1], paths[0] if two else None), 2 + two


def _count_entry(tokens: list[str], at: int):
    if tokens[at].count("\t") < 2:
        return None, 0
    add, gone, path = tokens[at].split("\t", 2)
    if path:
        return (add, gone, path, None), 1
    if at + 2 >= len(tokens):
        return None, 0
    return (add, gone, tokens[at + 2], tokens[at + 1]), 3


def name_status_decoded(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``name_status`` with a further row for each output whose tail cannot be read: ``rejected`` holds the tail, the rest is null."""
    return _decoded(raw, column, _status_entry, "status string, path string, old_path string")


def name_status(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(source, ordinal, status, path, old_path) of NUL-separated name-status output; renames and copies take two paths.

    ``raw``: source and the output as text. Tails that cannot be read are in ``name_status_decoded``.
    """
    return name_status_decoded(raw, column).where("rejected is null").drop("rejected")


def numstat_decoded(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``numstat`` with a further row for each output whose tail cannot be read."""
    return _decoded(raw, column, _count_entry, "add string, del string, path string, old_path string")


def numstat(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(source, ordinal, add, del, path, old_path) of NUL-separated numstat output; an empty path announces a rename's two paths."""
    return numstat_decoded(raw, column).where("rejected is null").drop("rejected")


def tree_listing(raw: DataFrame) -> DataFrame:
    """(mode, kind, object_id, path, stage) of lines ``mode kind id TAB path`` or ``mode id stage TAB path``; unmerged stages are marked."""
    head, path = F.split(F.col("value"), "\t", 2)[0], F.try_element_at(F.split(F.col("value"), "\t", 2), F.lit(2))
    part = F.split(head, " +")
    tree = F.element_at(part, 2).isin("blob", "tree", "commit")
    rows = raw.where(path.isNotNull() & (F.size(part) == 3)).select(
        F.element_at(part, 1).alias("mode"), F.when(tree, F.element_at(part, 2)).otherwise("blob").alias("kind"), F.when(tree, F.element_at(part, 3)).otherwise(F.element_at(part, 2)).alias("object_id"),
        path.alias("path"), F.when(tree, 0).otherwise(F.element_at(part, 3).try_cast("int")).alias("stage"),
    )
    return rows.withColumn("unmerged", F.col("stage") > 0)


def pick_source(sources: DataFrame) -> DataFrame:
    """Per repository the first source that has changes: an explicit one, then staged, unstaged, branch."""
    # The order of sources.
    order = F.array_position(F.array(*map(F.lit, ("explicit", "staged", "unstaged", "branch"))), F.col("source"))
    return sources.where((F.col("changes") > 0) & (order > 0)).groupBy("repo_id").agg(F.min_by("source", order).alias("source"))


def blobs(spark, path: str, most_bytes: int) -> DataFrame:
    """(path, bytes, size, truncated, binary) of files read in place, each cut to ``most_bytes``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring("content", 1, most_bytes).alias("bytes"), F.col("length").alias("size"), (F.col("length") > most_bytes).alias("truncated"), is_binary("content").alias("binary"))


def manifest(entries: DataFrame, most_files: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Valid entries within the budgets of files and bytes per repository, in path order, and a limitation per repository that lost some."""
    good = entries.where(valid_repo_path("path")).withColumn("__size", F.coalesce("content_bytes", F.lit(0)))
    running = prefix_sum(prefix_sum(good, ["repo_id"], ["path", "entry_id"], F.lit(1), "__files"), ["repo_id"], ["path", "entry_id"], "__size", "__bytes")
    kept = running.where((F.col("__files") <= most_files) & (F.col("__bytes") <= most_bytes))
    lost = running.where((F.col("__files") > most_files) | (F.col("__bytes") > most_bytes)).groupBy("repo_id").agg(F.count("*").alias("lost"))
    return kept.drop("__size", "__files", "__bytes"), lost.select(F.lit("manifest-budget-exhausted").alias("code"), "repo_id", "lost")
