"""Readers of rule files and package manifests; what cannot be used is reported, not dropped."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_QUERIES, MOST_CHARS = 32, 500


def regex_rules(lines: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(rules as (id, pattern), problems as (line, reason)) of a file with a pattern per line; blank lines and ``#`` are skipped."""
    rules, problems = [], []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if len(line) > MOST_CHARS:
            problems.append((line[:60], "pattern-too-long"))
        elif len(rules) >= MOST_QUERIES:
            problems.append((line[:60], "too-many-patterns"))
        else:
            problem = pattern_problem(line)
            if problem:
                problems.append((line[:60], f"invalid-pattern: {problem}"))
            else:
                rules.append((f"query-{len(rules) + 1}", line))
    return rules, problems


def pattern_problem(pattern: str) -> str | None:
    """Why a pattern is not one: by the JVM's engine, which runs it, where a session is active, else by Python's."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        if sc is None:
            re.compile(pattern)
        else:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
    except re.error as e:
        return e.msg
    except IllegalArgumentException as e:
        return str(e).partition("\n")[0]
    return None


def test_hints(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ord, rule_id, path_regex, content_regex, test_kind, environment_dependency, confidence, hint) of tab-separated lines.

    At least seven fields; what follows the sixth is the hint, tabs and all.
    ``lines``: ord and the line.
    """
    parts = F.split(column, "\t", 7)
    good = lines.where((F.trim(column) != "") & ~F.startswith(F.ltrim(F.col(column)), F.lit("#")) & (F.size(parts) >= 7))
    names = ["rule_id", "path_regex", "content_regex", "test_kind", "environment_dependency", "confidence", "hint"]
    return good.select("ord", *[F.trim(F.element_at(parts, i + 1)).alias(n) for i, n in enumerate(names)])


def rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a rule file with their order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))


def packages(files: DataFrame) -> DataFrame:
    """(path, package, target_kind, target_name, target_path, workspace_member) of package manifests in TOML; ``files``: path, status, text.

    Only completed files are read; one that does not parse gives one row of kind ``invalid``.
    """
    schema = "path string, package string, target_kind string, target_name string, target_path string, workspace_member string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                folder = path.rpartition("/")[0]
                at = lambda p: f"{folder}/{p}" if folder else p  # noqa: E731, B023
                try:
                    doc = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    rows.append((path, None, "invalid", None, None, None))
                    continue
                name = (doc.get("package") or {}).get("name")
                found = []
                if isinstance(doc.get("lib"), dict) or name:
                    lib = doc.get("lib") if isinstance(doc.get("lib"), dict) else {}
                    found.append((path, name, "lib", (lib.get("name") or (name or "")).replace("-", "_"), at(lib.get("path", "src/lib.rs")), None))
                for kind in ("bin", "example", "test", "bench"):
                    for t in doc.get(kind) or []:
                        if isinstance(t, dict):
                            found.append((path, name, kind, t.get("name"), at(t.get("path", f"src/{kind}/{t.get('name')}.rs")), None))
                for member in (doc.get("workspace") or {}).get("members") or []:
                    found.append((path, name, "member", None, None, at(str(member))))
                rows += found
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.where("status = 'completed'").select("path", "text").mapInPandas(run, schema)
