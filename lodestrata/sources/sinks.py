"""Report sinks and scoped retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import tsv_field


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; tabs and line ends within fields become spaces."""
    flat = df.select(*[tsv_field(F.col(c).cast("string")).alias(c) for c in df.columns])
    flat.write.mode("errorifexists").option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line) of a Markdown table row per row; pipes are escaped. The header is ``markdown_header``."""
    cells = [F.replace(tsv_field(F.col(c).cast("string")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)


def of_group(units: DataFrame, group_id: str) -> DataFrame:
    return units.where(F.col("group_id") == group_id)


def of_path(units: DataFrame, path: str) -> DataFrame:
    return units.where(F.col("path") == path)
