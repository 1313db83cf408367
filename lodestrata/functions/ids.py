"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def _text(value: Column | str) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def stable_id(namespace: str, *fields: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over the namespace and the fields, each ended by NUL; null counts as empty."""
    parts = [F.lit(namespace), F.lit(NUL)]
    for field in fields:
        parts += [_text(field), F.lit(NUL)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def bare_id(*fields: Column | str) -> Column:
    """``stable_id`` without a namespace."""
    parts: list[Column] = []
    for field in fields:
        parts += [_text(field), F.lit(NUL)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def prefixed_digest(*fields: Column | str) -> Column:
    """SHA-256 (64 hex) over fields that each follow their length in bytes as 8 bytes, big-endian."""
    parts: list[Column] = []
    for field in fields:
        value = _text(field)
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")), F.encode(value, "UTF-8")]
    return F.sha2(F.concat(*parts), 256)


def git_blob_id(content: Column | str) -> Column:
    """SHA-1 of ``blob <length> NUL <bytes>``, as version control names contents."""
    data = F.col(content) if isinstance(content, str) else content
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.lit(NUL)), "UTF-8")
    return F.sha1(F.concat(head, data))


def range_identity(*parts: Column | str) -> Column:
    """Six range parts joined by colons."""
    return F.concat_ws(":", *[_text(p) for p in parts])
