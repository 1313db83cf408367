"""Configuration texts as key paths with the places of their values.

JSON (with comments), YAML (block and flow style, folded, literal and quoted
scalars over several lines), TOML and INI (sections, dotted keys, inline tables,
texts over several lines), properties and dotenv, and XML (elements, attributes,
key and value pairs) are read in one pass each, in time linear in the text.
Nothing is rejected: what does not parse gives no value, and reading goes on.

A value has the names above it, the span of each of its lines without quotes,
and whether it was quoted. A pair of ``name`` and ``value`` beside each other
reads as the value under that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass
class Value:
    path: tuple[str, ...]
    spans: list[tuple[int, int]]
    quoted: bool


# Suffixes and names of files by format.
FORMATS = (
    ("json", re.compile(r"(?i)\.(?:json[c5]?|jsonl|ndjson|tfstate|ipynb|webmanifest)$|(?:^|/)\.(?:babelrc|eslintrc)$")),
    ("yaml", re.compile(r"(?i)\.ya?ml$")),
    ("toml", re.compile(r"(?i)\.(?:toml|ini|cfg|conf|properties|env|service|editorconfig|tfvars)$|(?:^|/)\.(?:env[\w.-]*|npmrc|pypirc|gitconfig)$")),
    ("xml", re.compile(r"(?i)\.(?:xml|plist|config|csproj|props|xaml|svg|xsd)$")),
)
ANY_SUFFIX = re.compile(r"\.[A-Za-z0-9_+-]+$")
# Keys that name their neighbour, and keys of the value they name.
NAMING = frozenset("name key".split())
NAMED = frozenset("value".split())


def format_of(text: str, path: str) -> str | None:
    """The format by the file's name, else by how the text begins if the name has no suffix."""
    for name, pattern in FORMATS:
        if pattern.search(path):
            return name
    if ANY_SUFFIX.search(path):
        return None
    head = text.lstrip("\ufeff \t\r\n")
    if head[:1] == "{" or re.match(r"\[\s*[{\[\"]", head):
        return "json"
    if head[:1] == "<":
        return "xml"
    if re.match(r"(?:[#;][^\n]*\n\s*)*\[[\w.\" -]+\]\s*(?:\n|$)", head):
        return "toml"
    if re.match(r"(?:#[^\n]*\n\s*)*(?:---\s*\n\s*)?(?:- )?[\w.\"'-]+:(?:\s|$)", head) and "{" not in head.partition("\n")[0]:
        return "yaml"
    return None


def values(text: str, form: str) -> Iterator[Value]:
    return {"json": _json, "yaml": _yaml, "toml": _toml, "xml": _xml}[form](text)


# --- JSON and the flow style of YAML and TOML ------------------------------------------------------------------

FLOW = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.|'')*'|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?<![^\s,\[{])#[^\n]*|[{}\[\]:,=]|[^\s{}\[\]:,=\"'#/][^\n{}\[\],\"']*?(?=\s*(?:[:=](?=[\s\"'\[{])|[{}\[\],\n]|$))|\S", re.S)


class _Flow:
    """Reads tokens of nested braces; ``base`` are the names above."""

    def __init__(self, base: tuple[str, ...]):
        self.stack: list[list] = []  # [is object, key, pending (name, value)]
        self.path = list(base)

    def scalar(self, start: int, end: int, text: str, quoted: bool) -> Iterator[Value]:
        raw = text[start:end]
        top = self.stack[-1] if self.stack else None
        if top and top[0] and top[1] is None:
            top[1] = raw
            return
        key = top[1] if top and top[0] else None
        if key is not None and key.lower() in NAMING | NAMED:
            top[2].append((key.lower(), raw, start, end, quoted))
        yield Value((*self.path, key) if key is not None else tuple(self.path), [(start, end)], quoted)

    def open(self, is_object: bool) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top[0] and top[1] is not None:
            self.path.append(top[1])
            self.stack.append([is_object, None, [], True])
        else:
            self.stack.append([is_object, None, [], False])

    def close(self) -> Iterator[Value]:
        if not self.stack:
            return
        _, _, pairs, named = self.stack.pop()
        yield from _paired(tuple(self.path), pairs)
        if named:
            self.path.pop()
        if self.stack:
            self.stack[-1][1] = None if self.stack[-1][0] else self.stack[-1][1]


def _paired(path: tuple[str, ...], pairs: list[tuple[str, str, int, int, bool]]) -> Iterator[Value]:
    names = [p for p in pairs if p[0] in NAMING]
    found = [p for p in pairs if p[0] in NAMED]
    if len(names) == 1 and len(found) == 1:
        yield Value((*path, names[0][1]), [(found[0][2], found[0][3])], found[0][4])


def _flow(text: str, at: int, base: tuple[str, ...], whole: bool) -> tuple[list[Value], int]:
    """Values from ``at`` on, and where the outermost brace closes (or the text ends)."""
    state, out = _Flow(base), []
    end = len(text)
    for m in FLOW.finditer(text, at):
        t = m[0]
        c = t[0]
        if c in "{[":
            state.open(c == "{")
        elif c in "}]":
            out += state.close()
            if not state.stack and not whole:
                return out, m.end()
        elif c == "," and len(t) == 1:
            if state.stack and state.stack[-1][0]:
                state.stack[-1][1] = None
        elif c in ":=" and len(t) == 1 or t[:2] in ("//", "/*") or c == "#":
            continue
        elif c in "\"'" and len(t) > 1 and t[-1] == c:
            out += state.scalar(m.start() + 1, m.end() - 1, text, True)
        elif c not in "\"'":
            out += state.scalar(m.start(), m.start() + len(t.rstrip()), text, False)
    while state.stack:
        out += state.close()
    return out, end


def _json(text: str) -> Iterator[Value]:
    return iter(_flow(text, 0, (), True)[0])


# --- YAML ------------------------------------------------------------------------------------------------------

YAML_KEY = re.compile(r"(?:(\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')|([^\s\"'#\[\]{}&*!|>%@`,?][^:#\n]*?(?:[:#][^\s:#][^:#\n]*?)*))[ \t]*:(?=[ \t\r\n]|$)")
BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?\r?$")
DECORATION = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+")


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while True:
        end = text.find("\n", at)
        if end < 0:
            out.append((at, len(text)))
            return out
        out.append((at, end))
        at = end + 1


def _yaml(text: str) -> Iterator[Value]:
    lines = _lines(text)
    stack: list[list] = []  # [column, name or None for an item, pairs]
    i, skip_to = 0, 0

    def path() -> tuple[str, ...]:
        return tuple(s[1] for s in stack if s[1] is not None)

    def shut(column: int, item: bool = False) -> Iterator[Value]:
        while stack and (stack[-1][0] > column or stack[-1][0] == column and not (item and stack[-1][1] is not None)):
            gone = stack.pop()
            if gone[2]:
                yield from _paired(path() + ((gone[1],) if gone[1] is not None else ()), gone[2])

    while i < len(lines):
        start, stop = lines[i]
        i += 1
        if start < skip_to:
            continue
        at = start
        while at < stop and text[at] in " \t":
            at += 1
        if at >= stop or text[at] in "#\r" or text.startswith(("---", "..."), at) and at == start:
            continue
        while text.startswith("- ", at) or text[at:stop].rstrip("\r") == "-":
            yield from shut(at - start, item=True)
            stack.append([at - start, None, []])
            at += 1
            while at < stop and text[at] in " \t":
                at += 1
            if at >= stop:
                break
        column = at - start
        if at >= stop or text[at] in "#\r":
            continue
        key, m = None, YAML_KEY.match(text, at, stop)
        if m:
            yield from shut(column)
            key = m[2] if m[2] is not None else m[1][1:-1]
            at = m.end()
            while at < stop and text[at] in " \t":
                at += 1
            holder = stack[-1] if stack else None
        names = path() + ((key,) if key is not None else ())
        if d := DECORATION.match(text, at, stop):
            at = d.end()
        rest = text[at:stop]
        if not rest.strip() or rest.lstrip()[:1] == "#":
            if key is not None:
                stack.append([column, key, []])
            continue
        value: Value | None = None
        if BLOCK.match(rest):
            spans = []
            floor = column if key is not None else (stack[-1][0] if stack else -1)
            while i < len(lines):
                a, b = lines[i]
                body = text[a:b]
                indent = len(body) - len(body.lstrip(" \t"))
                if body.strip() and indent <= floor:
                    break
                if body.strip():
                    spans.append((a + indent, a + len(body.rstrip())))
                i += 1
            if spans:
                value = Value(names, spans, True)
        elif rest[0] in "{[":
            found, skip_to = _flow(text, at, names, False)
            yield from found
            continue
        elif rest[0] in "\"'":
            quote = re.compile(r"\"(?:[^\"\\]|\\.)*\"" if rest[0] == '"' else r"'(?:[^']|'')*'", re.S).match(text, at)
            if quote:
                skip_to = quote.end()
                inner = text[at + 1:quote.end() - 1]
                spans, a = [], at + 1
                for part in inner.split("\n"):
                    lead = len(part) - len(part.lstrip()) if a > at + 1 else 0
                    if part.strip():
                        spans.append((a + lead, a + len(part.rstrip("\r"))))
                    a += len(part) + 1
                if spans:
                    value = Value(names, spans, True)
        else:
            end = at + len(re.split(r"[ \t]#", rest)[0].rstrip())
            value = Value(names, [(at, end)], False)
        if value:
            if key is not None and key.lower() in NAMING | NAMED and len(value.spans) == 1:
                if holder is not None:
                    holder[2].append((key.lower(), text[slice(*value.spans[0])], *value.spans[0], value.quoted))
            yield value
    yield from shut(-1)


# --- TOML, INI, properties, dotenv -----------------------------------------------------------------------------

SECTION = re.compile(r"[ \t]*\[{1,2}[ \t]*([^\[\]\n]+?)[ \t]*\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?$")
SETTING = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+)?([\w.\-\"' /\\]+?)[ \t]*[=:][ \t]*")
LONG_TEXT = re.compile(r"\"\"\"(.*?)\"\"\"|'''(.*?)'''", re.S)
SHORT_TEXT = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'")


def _toml(text: str) -> Iterator[Value]:
    section: tuple[str, ...] = ()
    skip_to = 0
    for start, stop in _lines(text):
        if start < skip_to:
            continue
        line = text[start:stop]
        if line.lstrip()[:1] in ("#", ";", "!"):
            continue
        if m := SECTION.match(line):
            section = tuple(p.strip(" \"'") for p in m[1].split("."))
            continue
        m = SETTING.match(line)
        if not m:
            continue
        at = start + m.end()
        names = section + tuple(p.strip(" \"'") for p in m[1].split("."))
        if long := LONG_TEXT.match(text, at):
            g = 1 if long[1] is not None else 2
            spans, a = [], long.start(g)
            for part in long[g].split("\n"):
                if part.strip():
                    lead = len(part) - len(part.lstrip())
                    spans.append((a + lead, a + len(part.rstrip())))
                a += len(part) + 1
            skip_to = long.end()
            if spans:
                yield Value(names, spans, True)
        elif short := SHORT_TEXT.match(text, at, stop):
            g = 1 if short[1] is not None else 2
            if short.end(g) > short.start(g):
                yield Value(names, [short.span(g)], True)
        elif text[at:at + 1] in ("{", "["):
            found, skip_to = _flow(text, at, names, False)
            yield from found
        else:
            body = re.split(r"[ \t][#;]", text[at:stop])[0].rstrip()
            if body:
                yield Value(names, [(at, at + len(body))], False)


# --- XML -------------------------------------------------------------------------------------------------------

MARK = re.compile(r"<!--(?:[^-]|-(?!->))*-->|<!\[CDATA\[(?P<data>(?:[^\]]|\](?!\]>))*)\]\]>|<[?!][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z_][\w.:\-]*)(?P<attributes>(?:\s+[\w.:\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>")
ATTRIBUTE = re.compile(r"([\w.:\-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def _xml(text: str) -> Iterator[Value]:
    stack: list[list] = []  # [tag, pairs]
    at, named = 0, None

    def path() -> tuple[str, ...]:
        return tuple(s[0] for s in stack)

    def content(start: int, end: int) -> Iterator[Value]:
        nonlocal named
        body = text[start:end]
        if not body.strip() or not stack:
            return
        a = start + len(body) - len(body.lstrip())
        spans, place = [], a
        for part in body.strip().split("\n"):
            lead = len(part) - len(part.lstrip())
            if part.strip():
                spans.append((place + lead, place + len(part.rstrip())))
            place += len(part) + 1
        tag = stack[-1][0].lower()
        if tag in NAMING:
            named = (len(stack), body.strip())
        elif named and named[0] == len(stack):
            yield Value((*path()[:-1], named[1]), spans, True)
            named = None
        if len(stack) > 1 and tag in NAMING | NAMED and len(spans) == 1:
            stack[-2][1].append((tag, body.strip(), *spans[0], True))
        yield Value(path(), spans, True)

    for m in MARK.finditer(text):
        yield from content(at, m.start())
        at = m.end()
        if m["data"] is not None:
            yield from content(*m.span("data"))
        elif m["close"]:
            tag = m["tag"]
            if any(s[0] == tag for s in stack):
                while stack:
                    gone = stack.pop()
                    yield from _paired(path() + (gone[0],), gone[1])
                    if gone[0] == tag:
                        break
        elif m["tag"]:
            pairs = []
            for a in ATTRIBUTE.finditer(text, *m.span("attributes")):
                s, e = a.start(2) + 1, a.end(2) - 1
                if e > s:
                    pairs.append((a[1].lower(), text[s:e], s, e, True))
                    yield Value((*path(), m["tag"], a[1]), [(s, e)], True)
            yield from _paired((*path(), m["tag"]), pairs)
            if not m["empty"]:
                stack.append([m["tag"], []])


def indented_parents(text: str) -> list[tuple[str, ...]]:
    """For each line of a text in no known format: the keys that open above it with less indent."""
    out, stack = [], []
    for line in text.split("\n"):
        body = line.strip()
        if not body:
            out.append(tuple(k for _, k in stack))
            continue
        indent = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        out.append(tuple(k for _, k in stack))
        if indent < 400 and (m := re.match(r"(?:- )?[\"']?([\w.\-]+)[\"']?\s*[:=]\s*(?:[{\[|>(]|$)", body)):
            stack.append((indent, m[1]))
    return out
