"""Rust source read by patterns: symbols, imports, calls and attributes.

There is no grammar here, so what it finds is labelled ``recovered``: names
within strings or comments may be taken for code, and spans are lines. Where
facts of a real parser are given, the resolver takes those instead.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut
from pyspark.sql import types as T

SYMBOL = r"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*(fn|struct|enum|trait|mod|const|static|type|union)\s+([A-Za-z_][A-Za-z0-9_]*)"
CALL = r"([A-Za-z_][A-Za-z0-9_]*)(!?)\("
# Words before a bracket that are no calls.
NOT_CALLS = ("if", "while", "for", "match", "return", "fn", "loop", "in", "as", "impl", "where")


def lines_of(files: DataFrame) -> DataFrame:
    """(file_id, path, line_no, line) of Rust files without whole-line comments."""
    each = files.where(F.lower("path").endswith(".rs")).select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return each.select("file_id", "path", (F.col("at") + 1).alias("line_no"), "line").where(~F.col("line").rlike(r"^\s*//"))


def symbols(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, name, visibility, quality) of declared symbols."""
    m = lambda g: F.regexp_extract("line", SYMBOL, g)
    found = lines_of(files).where(F.col("line").rlike(SYMBOL))
    return found.select("file_id", "line_no", m(2).alias("kind"), m(3).alias("name"), F.when(m(1) != "", F.trim(m(1))).alias("visibility"), F.lit("recovered").alias("quality"))


def calls(files: DataFrame) -> DataFrame:
    """(file_id, line_no, name, is_macro) of calls and macro uses."""
    plain = lines_of(files).where(~F.col("line").rlike(SYMBOL))
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(CALL), 1).alias("n"), F.regexp_extract_all("line", F.lit(CALL), 2).alias("m"))
    return plain.select("file_id", "line_no", F.explode(pairs).alias("c")).select("file_id", "line_no", F.col("c.n").alias("name"), (F.col("c.m") == "!").alias("is_macro")).where(~F.col("name").isin(*NOT_CALLS))


def flatten_use(tree: str) -> list[tuple[str, str, bool]]:
    """(path, bound name, is_glob) of each leaf of a use tree such as ``a::{b, c as d, e::*, self}``."""
    out: list[tuple[str, str, bool]] = []
    stack, prefix, word = [], [], ""

    def leaf() -> None:
        nonlocal word
        text = word.strip()
        word = ""
        if not text:
            return
        name, _, alias = (s.strip() for s in re.sub(r"\s+as\s+", "\0", text).partition("\0"))
        parts = [*prefix, *[p.strip() for p in name.split("::") if p.strip()]]
        if parts and parts[-1] == "*":
            out.append(("::".join(parts[:-1]), "*", True))
            return
        if len(parts) > 1 and parts[-1] == "self":
            parts.pop()
        if parts:
            out.append(("::".join(parts), alias or parts[-1], False))

    for c in tree:
        if c == "{":
            stack.append(prefix)
            prefix = [*prefix, *[p.strip() for p in word.split("::") if p.strip()]]
            word = ""
        elif c in ",}":
            leaf()
            if c == "}" and stack:
                prefix = stack.pop()
        else:
            word += c
    leaf()
    return out


LEAVES = T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("name", T.StringType()), T.StructField("is_glob", T.BooleanType())]))


@F.pandas_udf(LEAVES)
def _use_leaves(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: [{"target": a, "name": b, "is_glob": g} for a, b, g in flatten_use(t or "")])


def imports(files: DataFrame) -> DataFrame:
    """(file_id, exported, target, name, is_glob): a row per leaf of each use declaration."""
    pattern = r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"
    rust = files.where(F.lower("path").endswith(".rs"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("v"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("t"))
    each = rust.select("file_id", F.explode(pairs).alias("u")).select("file_id", (F.col("u.v") != "").alias("exported"), F.explode(_use_leaves("u.t")).alias("i"))
    return each.select("file_id", "exported", "i.target", "i.name", "i.is_glob")


def module_tree(roots: DataFrame, declarations: DataFrame) -> DataFrame:
    """(module_path, file): modules reached from crate roots by ``mod`` declarations, level by level to the last.

    A file counts at the least depth it is reached at, so declarations in a ring end. ``roots``: crate, file. ``declarations``: file, name, target_file.
    """
    level = out = cut(roots.select(F.col("crate").alias("module_path"), "file"))
    d = declarations.select(F.col("file").alias("in_file"), "name", "target_file")
    while True:
        level = level.join(d, level.file == d.in_file).select(F.concat_ws("::", "module_path", "name").alias("module_path"), F.col("target_file").alias("file"))
        level = cut(level.join(out.select("file"), "file", "left_anti").select("module_path", "file"))
        if not level.head(1):
            break
        out = out.unionByName(level)
    return out
