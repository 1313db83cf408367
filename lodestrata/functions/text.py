"""Text and path expressions. All are built-ins but the three pandas functions at the end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str, fallback: str, limit: int) -> Column:
    """NUL removed, white space collapsed, the fallback where nothing is left, at most ``limit`` characters."""
    bare = F.regexp_replace(F.coalesce(col(value), F.lit("")), "\\x00", "")
    one = F.trim(F.regexp_replace(bare, "\\s+", " "))
    return F.substring(F.when(one == "", F.lit(fallback)).otherwise(one), 1, limit)


def bounded_text(value: Column | str, limit: int = 1000) -> Column:
    """Control characters but tab removed, the first ``limit`` characters, trimmed."""
    kept = F.regexp_replace(col(value), "[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x9F]", "")
    return F.regexp_replace(F.substring(kept, 1, limit), "^\\s+|\\s+$", "")


def normalize_path(value: Column | str, repository: str = "") -> Column:
    """Percent-decoded, slashes forward, without file scheme, drive slash, leading ``./`` and repository prefix."""
    raw = col(value)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    path = F.replace(F.trim(decoded), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(path, "^file://", "")
    path = F.regexp_replace(path, "^/(?=.:)", "")
    if repository:
        prefix = repository.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    path = F.regexp_replace(path, "^(?:\\./)+", "")
    return F.when(path == "", F.lit("unknown")).otherwise(path)


def valid_repo_path(value: Column | str) -> Column:
    """A relative path of at most 4,096 bytes without NUL, backslash, empty, ``.`` or ``..`` parts."""
    p = col(value)
    bad = p.rlike("(^|/)(\\.{1,2})?(/|$)") | p.contains("\\") | p.contains("\0") | p.rlike("^[A-Za-z]:")
    return F.coalesce((p != "") & (F.octet_length(p) <= 4096) & ~bad, F.lit(False))


def tsv_field(value: Column | str) -> Column:
    """Tabs and line ends as single spaces, so that a field stays one field."""
    return F.translate(F.coalesce(col(value), F.lit("")), "\t\r\n", "   ")


def shell_quote(value: Column | str) -> Column:
    """As one shell word: bare if harmless, else in single quotes."""
    p = col(value)
    return F.when(p.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), p).otherwise(F.concat(F.lit("'"), F.replace(p, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def group_component(path: Column | str) -> Column:
    """The first path segment, joined with the second if that is a migration or schema folder."""
    p = col(path)
    parts = F.split(p, "/")
    first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    joined = F.when(second.isin("migration", "migrations", "schema", "schemas"), F.concat_ws("-", first, second)).otherwise(first)
    return F.when(F.size(parts) >= 2, joined).otherwise(p)


def safe_component(value: Column | str) -> Column:
    return F.regexp_replace(col(value), "[^A-Za-z0-9._-]", "_")


def contains_any(value: Column | str, needles: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col(value), F.lit(needle))
    return out


def line_of(text: Column | str, position: Column) -> Column:
    """Line (from 1) of a position (code points from 1)."""
    prefix = F.substring(col(text), F.lit(1), position - 1)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column | str, position: Column) -> Column:
    """Column (code points from 1) of a position (code points from 1)."""
    prefix = F.substring(col(text), F.lit(1), position - 1)
    return F.length(F.substring_index(prefix, "\n", -1)) + 1


def lossy_utf8(content: Column | str) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(col(content).cast("string"))


def is_binary(content: Column | str, window: int = 8192) -> Column:
    """A NUL byte among the first bytes."""
    return F.contains(F.substring(col(content), 1, window), F.lit(bytearray(b"\0")))


def redact(value: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Each rule's matches replaced by ``[redacted:<rule>]``, in order."""
    out = col(value)
    for name, pattern in rules:
        out = F.regexp_replace(out, pattern, f"[redacted:{name}]")
    return out


def hunk_part(header: Column | str, part: str) -> Column:
    """``old_start``, ``old_count``, ``new_start`` or ``new_count`` of ``@@ -a,b +c,d @@``; a missing count is 1."""
    pattern = "^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@"
    group = {"old_start": 1, "old_count": 2, "new_start": 3, "new_count": 4}[part]
    found = F.regexp_extract(col(header), pattern, group)
    return F.when(~col(header).rlike(pattern), None).otherwise(F.when(found == "", F.lit(1)).otherwise(found.try_cast("int")))


@F.pandas_udf(T.StringType())
def quote_git_path(paths: pd.Series) -> pd.Series:
    """C-style quoting of a path with special or non-ASCII bytes; others stay bare."""
    escapes = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def one(path: str | None) -> str | None:
        if path is None:
            return None
        raw = path.encode("utf-8", "surrogatepass")
        if all(32 <= b < 127 and b not in escapes for b in raw):
            return path
        return '"' + "".join(escapes.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in raw) + '"'

    return paths.map(one)


@F.pandas_udf(T.StringType())
def unquote_git_path(paths: pd.Series) -> pd.Series:
    """The reverse of ``quote_git_path``; bare paths stay."""
    back = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}

    def one(path: str | None) -> str | None:
        if path is None or len(path) < 2 or path[0] != '"' or path[-1] != '"':
            return path
        out, at, body = bytearray(), 0, path[1:-1]
        while at < len(body):
            c = body[at]
            if c != "\\" or at + 1 >= len(body):
                out += c.encode()
                at += 1
            elif body[at + 1] in "01234567":
                digits = body[at + 1:at + 4]
                out.append(int(digits, 8) & 255)
                at += 1 + len(digits)
            else:
                nxt = body[at + 1]
                out += bytes([back[nxt]]) if nxt in back else nxt.encode()
                at += 2
        return out.decode("utf-8", "replace")

    return paths.map(one)


def utf8_truncate(limit: int, marker: str = "\n[truncated]\n"):
    """A function that cuts text to ``limit`` bytes between code points and then adds ``marker``."""

    @F.pandas_udf(T.StringType())
    def cut(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            raw = None if text is None else text.encode("utf-8", "surrogatepass")
            return text if raw is None or len(raw) <= limit else raw[:limit].decode("utf-8", "ignore") + marker

        return values.map(one)

    return cut
