"""Credentials in source and configuration: find, locate by byte, and blank.

A trigger automaton runs over the bytes and names the texts and lines worth
parsing. A text in a configuration format (JSON, YAML, TOML, INI, properties,
dotenv, XML) that has a trigger is parsed whole into key paths with byte offsets
(``keypaths``): the words of the path, from the last name up through names like
``value`` that say nothing themselves, and the shape of the value decide. Lines
of other texts, and what such a parse does not reach (comments, commands,
statements, constants or keyword arguments in code), are parsed as assignments.
Values of well-known token shapes, URLs with a password, authorisation headers
and private key blocks count under any key. Redactions are spliced into the
original bytes, so quotes, line ends and everything around them stay.

Offsets are bytes of the original. UTF-16, with a byte order mark or told by its
zero bytes, is read through its text; all other encodings keep ASCII bytes in
place and are read bytewise. Time is linear in the text.

Defined results: null or empty content and binary content (flagged so, or with
more than one zero byte in a hundred) give no row; repeated
rows count once; a literal split over lines or halves counts where it begins;
several literals on one line are one row of ``p5_found`` and one span each of
``spans``; placeholders, references, masked values, digests, public keys and ids
are not credentials; figures alone are under a password's name only, from six.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import keypaths

# Shapes of well-known tokens.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[posur]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[A-Za-z0-9_-]{18,}|npm_[A-Za-z0-9]{30,}"
    r"|xox[abpsr]-[A-Za-z0-9-]{14,}|[sr]k_live_[A-Za-z0-9]{16,}|pcrk-[0-9a-f]{24,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"
)
SHAPE_START = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{3}|gh[posur]_\w{4}|github_pat_|glpat-\w|npm_\w{6}|xox[abpsr]-\d|[sr]k_live_|pcrk-[0-9a-f]|eyJ\w{8}")
HALVES = re.compile(r"\(in (?:two|three|\d+) (?:halves|parts|pieces)\)\s*[:=]\s*(\S+(?:\s+[/+|]\s+\S+)+)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
PEM_EDGE = re.compile(r"-----(END|BEGIN) [A-Z0-9 ]*KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?m)^[ \t]*(?://+|#+|--|\*|;+)?[ \t]*([A-Za-z0-9+/]{8,}={0,2})[ \t]*\r?$")
PEM_HEADER = re.compile(r"[ \t]*(?://+|#+|--|\*|;+)?[ \t]*(?:[A-Z][A-Za-z-]{2,20}: [^\n]*)?\r?")
SCHEME = re.compile(r"(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]{1,20}$")
USER = re.compile(r"[^/:]*:")
URL_PART = re.compile(r"(?<![^\s@\"'`])[^\s@\"'`]+@(?=[A-Za-z0-9\[])")
AUTH = re.compile(r"(?i)\bauthorization\b[\"']?\s*[:=]\s*[\"']?(?:(?:bearer|basic|token|apikey|digest)\s+)([A-Za-z0-9+/=_.~-]{8,})")
FLAG = re.compile(r"(?i)(?:^|\s)--?(?:[a-z]+-)*(password|passwd|pass|pwd|secret|token|api-?key)(?:\s+|=)(\"[^\"]+\"|'[^']+'|\S+)")
SSHPASS = re.compile(r"\bsshpass\s+-p\s*(\"[^\"]+\"|'[^']+'|\S+)")
IDENTIFIED = re.compile(r"(?i)\b(?:identified\s+by|with\s+(?:encrypted\s+)?password|password)\s+(?:password\s+)?'((?:[^']|'')+)'")
OLD = re.compile(r"(?i)\b(?:old|former|previous|current|new|temp(?:orary)?|default)\s+(password|passwd|passphrase|secret|token|pw|pwd|api[ _-]?key|key|credentials?)\b[^:=\n]{0,40}[:=]\s*(\S+)")
ASSIGN = re.compile(
    r"(?<![\w.\-])(?P<kq>[\"']?)(?P<key>[A-Za-z_][\w.\-]*)(?P=kq)"
    r"(?:\s*:\s*&?(?:'static\s+)?(?:str|String|string|String\?|char\s*\*|&str|bytes|Vec<u8>)\s*=|\s*:=|\s*=>|\s*[=:](?!=|/))"
    r"[ \t]*(?P<val>\(?\s*[bruf]{0,2}\"(?:[^\"\\\n]|\\.)*\"|\(?\s*[bruf]{0,2}'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s,;)}\]])?"
)
UNQUOTED = re.compile(r"[^\s,;]*")
XML = re.compile(r"<(?P<key>[A-Za-z_][\w.\-]*)>(?P<val>[^<>\n]+)</(?P=key)>")
NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)")
CONTINUED = re.compile(r"[\"']\s*(?:\+|\\|\.|&|\|\|)?\s*\r?\n\s*(?://|#|--)?\s*[bruf]{0,2}[\"']((?:[^\"'\\\n]|\\.)*)[\"']")
# Words of sensitive keys, and words beside them that make them harmless.
SENSITIVE = frozenset(
    "password passwd passwort passwords passphrase passcode pwd pw pass secret secrets token apikey credential credentials kennwort contrasena "
    "motdepasse deploytoken clientsecret authtoken accesstoken secretkey privatekey accesskey signingkey".split()
)
KEY_BEFORE = frozenset("api access signing private secret tls ssl encryption master auth service account ssh rsa hmac webhook deploy client data storage session jwt".split())
HARMLESS = frozenset(
    "name names id ids ref refs path paths file files url uri host length len count limit max min ttl expiry expires timeout stream streams type kind "
    "policy rule hint label field column prefix suffix size algorithm public pub fingerprint checksum version tokens budget usage uuid header regex "
    "pattern prompt env var variable manager provider store".split()
)
# Keys that say nothing of their own about their value, so that the name above them decides, and words of passwords that may be figures.
PLAIN_KEYS = frozenset("value val data content text default plain plaintext raw literal current string".split())
HOLDERS = frozenset("secrets passwords credentials".split())
PASSWORDS = frozenset("password passwd passwort passphrase passcode pwd pw pass kennwort contrasena motdepasse".split())
# What opens a look at a line (lower case). In words: the least of them that every sensitive key holds, the letters of a key taken together.
# As written: the heads of SHAPES, and what the other patterns cannot do without.
WORDS = tuple(sorted(w for w in SENSITIVE | {"key"} if not any(v in w for v in (SENSITIVE | {"key"}) - {w})))
HEADS = (
    "akia", "asia", *[f"gh{c}_" for c in "posur"], "github_pat_", "glpat-", "npm_", *[f"xox{c}-" for c in "abpsr"], "sk_live_", "rk_live_", "pcrk-", "aiza", "eyj",
    "://", "auth", "identified", "data.", " halves)", " parts)", " pieces)",
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?me\d*|todo|tbd|fixme|replace[-_ ]?(?:me|this)|your[-_ ].*|my[-_ ](?:password|secret|token|api[-_ ]?key)|<.*>?|\[.*\]?|\*+|x{4,}|\.{3,}|…"
    r"|none|null|nil|undefined|true|false|yes|no|empty|unset|redacted|masked|hidden|removed|example|sample|dummy|fake|placeholder|insert[-_ ].*|enter[-_ ].*|optional|required|n/a"
    r"|test|password|passwd|passwort|secret|token|string|str|default|\(.*|\{.*|\d{1,12}(?:\.\d+)?(?:ms|s|m|h|d|kb|mb)?)$"
)
REFERENCE = re.compile(
    r"\$\{|\$\(|^\$[A-Za-z_]|\{\{|^%[A-Za-z_]+%$|^!(?:ref|env|vault|secret)|\benviron\b|getenv|process\.env|env::|env\(|^env[.:]|^vault:|^secret(?:s|ref)?[:/.]|^arn:|^ssm:"
    r"|secrets\.|valueFrom|^file:|^/(?:run|etc|var)/|^@|<%|^#\{|\*{3,}|\[REDACTED|^op://|^projects/"
)
DIGEST = re.compile(r"^(?:sha\d+|md5|blake\w+)[-:]|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^ssh-(?:rsa|ed25519|dss)\b|^v?\d+\.\d+", re.I)
NAME_PATH = re.compile(r"^[a-z][a-z0-9_-]*(?:/[a-z0-9_.-]+)+$")
CODE = re.compile(r"[()\[\]{}]|::|->|^&|^\*|\.\w+\(|^self\.|^this\.|^new$|^await$|^function|^lambda")
BARE_OK = re.compile(r"[0-9]|[!#$%^&*+=@~?]|[a-z][A-Z]|-.*-")
COMMENT = re.compile(r"^\s*(?://+!?|#+|--|/\*+|\*|;+|<!--|\"\"\"|rem\b|%)\s*", re.I)
CONFIG_SUFFIX = re.compile(r"(?i)\.(?:ya?ml|toml|ini|cfg|conf|config|properties|env|json|xml|tf|tfvars|service|plist)$|(?:^|/)\.env|(?:^|/)(?:Dockerfile|Containerfile)|(?:^|/)\.?(?:netrc|npmrc|pypirc|pgpass)")

SPANS = "origin string, row_key string, line_no int, rule string, key_path string, start_byte bigint, end_byte bigint"


@lru_cache(maxsize=2)
def automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def line_starts(text: str) -> list[int]:
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def worth_parsing(text: str) -> list[int]:
    """Numbers of the lines that may hold a credential: no other line has what a pattern or a sensitive key needs.

    Both forms of the text keep its line feeds, so that lines are counted in them.
    """
    joined = text.encode("ascii", "ignore").translate(None, b"_-.").lower().decode("ascii")
    todo: set[int] = set()
    for form, words in ((joined, WORDS), (text.lower(), HEADS)):
        ends = [end for end, _ in automaton(words).iter(form)]
        if ends:
            starts = line_starts(form)
            todo.update(bisect.bisect_right(starts, end) - 1 for end in ends)
    return sorted(todo)


def url_passwords(line: str) -> Iterator[tuple[int, int]]:
    """Spans of passwords in ``scheme://user:password@host``, found from the ``@`` back."""
    for m in URL_PART.finditer(line):
        mark = line.find("://", *m.span())
        while mark >= 0:
            if SCHEME.search(line, max(m.start(), mark - 22), mark):
                user = USER.match(line, mark + 3, m.end() - 1)
                if user and user.end() < m.end() - 1:
                    yield user.end(), m.end() - 1
                    break
            mark = line.find("://", mark + 3, m.end())


def in_key(text: str, parts: list[tuple[int, int]]) -> bool:
    """Whether the spans together look like the body of a private key."""
    body = "".join(text[s:e] for s, e in parts)
    return len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 24 and not re.search(r"\.\.\.|<|\*{4}|REDACTED", body)


def key_body(text: str, at: int, until: int) -> list[tuple[int, int]]:
    """Spans of the body lines of a private key block without an end, from the line at ``at`` to the last of its lines.

    Headers and blank lines do not end it, nor does one other line before a line that is no plain word.
    """
    parts: list[tuple[int, int]] = []
    other = False
    while at < until:
        stop = text.find("\n", at, until)
        stop = until if stop < 0 else stop
        m = PEM_BODY.match(text, at, stop)
        if m and (not other or all(re.search(c, m[1]) for c in ("[A-Z]", "[a-z]", "[0-9]"))):
            parts.append(m.span(1))
            other = False
        elif not PEM_HEADER.fullmatch(text, at, stop):
            if other:
                break
            other = True
        at = stop + 1
    return parts


@lru_cache(maxsize=20_000)
def sensitive(key: str) -> bool:
    """Whether the words of a key say that its value is a credential."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", key)]
    if not words or words[-1] in HARMLESS or words[-1] in ("tokens",):
        return False
    if words[-1] in ("b64", "base64", "enc", "value", "val", "plain", "raw", "literal", "64", "1", "2") and len(words) > 1:
        words = [w for w in words if w not in ("b", "64", "b64", "base64", "enc", "value", "val", "plain", "raw", "literal", "1", "2")] or words
    if len(words) > 1 and words[-1] == "b":
        words = words[:-1]
    last = words[-1]
    if any(w in ("public", "stream") for w in words):
        return False
    if last in SENSITIVE or "".join(words) in SENSITIVE:
        return True
    if last in ("key", "keys") and len(words) > 1 and words[-2] in KEY_BEFORE:
        return True
    return any(last.endswith(s) for s in ("password", "passwd", "passwort", "secret", "apikey", "token", "passphrase")) and not last.endswith("tokens")


def literal(value: str, quoted: bool, key_words_data: bool = False) -> bool:
    """Whether a value under a sensitive key is a credential itself, not a stand-in for one."""
    v = value.strip()
    if len(v) < 4 or PLACEHOLDER.match(v) or REFERENCE.search(v) or DIGEST.search(v):
        return False
    if len(set(v)) <= 2 or NAME_PATH.match(v) and not re.search(r"[A-Z0-9+=]", v):
        return False
    if quoted:
        return " " not in v or bool(re.search(r"\d", v)) and v.count(" ") < 5
    return not CODE.search(v) and bool(BARE_OK.search(v))


def path_words(key: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", key)]


def credential_at(path: tuple[str, ...], value: str, quoted: bool) -> bool:
    """Whether the value at a key path is a credential: by the path's words first, then by its shape."""
    names = list(path)
    while len(names) > 1 and (names[-1].lower() in PLAIN_KEYS or names[-1].isdigit()):
        names.pop()
    if not names:
        return False
    if sensitive(names[-1]):
        words = path_words(names[-1])
        if re.fullmatch(r"\d{6,}", value) and words and words[-1] in PASSWORDS and len(set(value)) > 2:
            return True
        return literal(value, quoted)
    held = len(names) > 1 and names[-2].lower() in HOLDERS and len(names) == len(path)
    words = path_words(names[-1])
    if held and words and words[-1] not in HARMLESS and words[-1] not in ("username", "user", "login", "email", "account", "external"):
        return len(value) >= 8 and all(re.search(c, value) for c in ("[A-Za-z]", "[0-9]")) and "." not in value and " " not in value and "/" not in value and literal(value, quoted)
    return False


def parsed(text: str, path: str) -> list[tuple[keypaths.Value, bool]] | None:
    """The values of a text in a configuration format, each with whether it is a credential."""
    form = keypaths.format_of(text, path)
    if form is None:
        return None
    sealed = form == "yaml" and bool(re.search(r"(?m)^kind:[ \t]*[\"']?Secret\b", text))
    out = []
    for v in keypaths.values(text, form):
        if not v.path:
            continue
        parts = [text[s:e] for s, e in v.spans]
        whole = ("" if not any(" " in p for p in parts) else " ").join(parts)
        if "-----BEGIN" in parts[0]:
            out.append((v, False))
        elif sealed and len(v.path) > 1 and v.path[-2] in ("data", "stringData"):
            coded = re.fullmatch(r"[A-Za-z0-9+/]{8,}={0,2}", whole) and len(whole) % 4 == 0 and not PLACEHOLDER.match(whole)
            out.append((v, bool(coded) or credential_at(v.path, whole, v.quoted)))
        else:
            out.append((v, credential_at(v.path, whole, v.quoted)))
    return out


def _value(m: re.Match) -> tuple[int, int, bool] | None:
    """Start, end and whether quoted, of an assignment's value without its quotes."""
    if m["val"] is None:
        return None
    start, end = m.span("val")
    text = m["val"]
    if text in ("'", '"'):  # a text that does not end on its line
        return start + 1, end, False
    lead = re.match(r"\(?\s*[bruf]{0,2}(?=[\"'])", text)
    if lead and text[lead.end():]:
        return start + lead.end() + 1, end - 1, True
    if text[0] == "`":
        return start + 1, end - 1, True
    return start, end, False


def scan_text(text: str, path: str = "") -> list[tuple[int, int, int, str, str]]:
    """(line from 0, start, end, rule, key path) of each credential in ``text``, in order."""
    todo = worth_parsing(text)
    if not todo:
        return []
    starts = line_starts(text)
    config = bool(CONFIG_SUFFIX.search(path))
    known = parsed(text, path)
    decided = {v.spans[0][0] for v, _ in known} if known else set()  # where values begin that their paths decide on
    parents: list[tuple[str, ...]] | None = None
    found: list[tuple[int, int, int, str, str]] = []
    taken_until = -1
    taken: list[tuple[int, int]] = []  # spans so far, in order and apart

    def add(no: int, start: int, end: int, rule: str, key: str = "") -> None:
        at = bisect.bisect_left(taken, (end, 0))
        if end > start and not (at and start < taken[at - 1][1]):
            taken.insert(at, (start, end))
            found.append((no, start, end, rule, key))

    for no in todo:
        start = starts[no]
        stop = starts[no + 1] - 1 if no + 1 < len(starts) else len(text)
        if start < taken_until:
            continue
        line = text[start:stop]
        if "-----BEGIN" in line and (m := PEM.search(line)):
            close = PEM_EDGE.search(text, start + m.end())
            end = close.start() if close else len(text)
            rest = [(start + m.end(), stop)]
            if close and end <= stop:
                parts = [(start + m.end(), end)]
            elif close and close[1] == "END":
                parts = [(p.start(1), p.end(1)) for p in PEM_BODY.finditer(text, start + m.end(), end)]
                if not in_key(text, parts) and re.search(r"[A-Za-z0-9+/]{24}", line[m.end():]):
                    end, parts = stop, rest
            elif in_key(text, rest):
                end, parts = stop, rest
            else:
                parts = key_body(text, stop + 1, end)
            if in_key(text, parts):
                for n, (s, e) in enumerate(parts):  # lines of other things in between are read on their own
                    add(no, s, e, "continued" if n else "private-key")
                if end <= stop:
                    continue
        if m := HALVES.search(line):
            whole = re.sub(r"\s+[/+|]\s+", "", m[1])
            if literal(whole, True):
                add(no, start + m.start(1), start + m.end(1), "split-literal")
                continue
        for s, e in url_passwords(line) if "@" in line and "://" in line else ():
            if literal(line[s:e], True) and "*" not in line[s:e]:
                add(no, start + s, start + e, "url-password")
        for m in AUTH.finditer(line):
            if literal(m[1], True):
                add(no, start + m.start(1), start + m.end(1), "authorization")
        for m in SHAPES.finditer(line):
            add(no, start + m.start(), start + m.end(), "token-shape")
        for pattern, group in ((FLAG, 2), (SSHPASS, 1), (IDENTIFIED, 1), (NETRC, 1), (OLD, 2)):
            for m in pattern.finditer(line):
                s, e = m.span(group)
                quoted = line[s] in "\"'"
                s, e = (s + 1, e - 1) if quoted else (s, e)
                if literal(line[s:e], quoted or pattern is IDENTIFIED):
                    add(no, start + s, start + e, "command" if pattern in (FLAG, SSHPASS, NETRC) else "prose" if pattern is OLD else "statement")
        comment = bool(COMMENT.match(line))
        for pattern in (ASSIGN, XML):
            if pattern is XML and "</" not in line:
                continue
            at = 0
            while m := pattern.search(line, at):
                at = m.end("key") + 1
                key = m["key"]
                in_data = key.startswith(("data.", "stringData."))
                if pattern is ASSIGN:
                    place = _value(m)
                    if place is None:
                        if config and not known and sensitive(key) and no + 1 < len(starts):
                            after = text[starts[no + 1]:starts[no + 2] - 1 if no + 2 < len(starts) else len(text)]
                            if (v := re.match(r"\s+([\"']?)(\S+)\1\s*$", after)) and not re.search(r"[:=]\s*\S|-----", after) and literal(v[2], bool(v[1])):
                                s = starts[no + 1] + v.start(2)
                                add(no + 1, s, s + len(v[2]), "assignment", key)
                        continue
                    s, e, quoted = place
                else:
                    s, e, quoted = *m.span("val"), True
                value = line[s:e]
                if not quoted:
                    if not in_data and not sensitive(key):
                        continue
                    value = UNQUOTED.match(line, s)[0] if pattern is ASSIGN else value
                    value = value.rstrip("\"'`,;)")
                    e = s + len(value)
                if quoted:
                    at = max(at, min(m.end(), s))
                if in_data and re.fullmatch(r"[A-Za-z0-9+/]{8,}={0,2}", value) and len(value) % 4 == 0 and not PLACEHOLDER.match(value):
                    add(no, start + s, start + e, "encoded-data", key)
                    continue
                if not (quoted or config or comment or "=" in m[0] and re.match(r"\s*(?:export|env|set|arg)\s", line, re.I) or not CODE.search(line) and not line.rstrip().endswith((";", "{", ","))):
                    continue
                if start + s in decided:
                    continue
                if sensitive(key) and literal(value, quoted):
                    if parents is None:
                        parents = keypaths.indented_parents(text)
                    add(no, start + s, start + e, "assignment", ".".join((*parents[no], key)))
                    at = max(at, e)
                elif quoted and SHAPE_START.match(value) and line.rstrip().endswith(("+", "\\", ".")):
                    add(no, start + s, start + e, "split-literal", key)
        # a literal that goes on in the next lines is blanked there too, and counts once
        if found and found[-1][0] == no and (m := CONTINUED.match(text, found[-1][2])):
            f = found[-1]
            joined = m.end(1)
            if line.rstrip().endswith(("+", "\\", ".", "&", "(")) or line.rstrip()[-1:] in "\"'":
                found.append((f[0], m.start(1), joined, "continued", f[4]))
                taken_until = joined
    for v, yes in known or ():
        if yes:
            for n, (s, e) in enumerate(v.spans):
                add(bisect.bisect_right(starts, s) - 1, s, e, "continued" if n else "assignment", ".".join(v.path))
    return sorted(found, key=lambda f: f[1])


def scan_bytes(raw: bytes | None, path: str = "") -> list[tuple[int, int, int, str, str]]:
    """``scan_text`` over bytes, with offsets in bytes."""
    if not raw:
        return []
    wide = wide_codec(raw)
    if wide:
        head = 2 if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else 0
        text = raw[head:].decode(wide, "replace")
        out, at, place = [], 0, head  # bytes are counted from span to span
        for n, s, e, rule, key in scan_text(text, path):
            first = place + len(text[at:s].encode(wide, "surrogatepass"))
            at, place = e, first + len(text[s:e].encode(wide, "surrogatepass"))
            out.append((n, first, place, rule, key))
        return out
    if raw.count(0) * 100 > len(raw):
        return []
    return scan_text(raw.decode("latin-1"), path)


def wide_codec(raw: bytes) -> str | None:
    """The codec of a text in UTF-16, told by its byte order mark or by zero bytes at every other place."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if raw[:2] == b"\xff\xfe" else "utf-16-be"
    half = len(raw) // 2
    if half > 3 and raw.count(0) * 10 > 4 * half:
        low, high = raw[1::2].count(0), raw[::2].count(0)
        if max(low, high) * 10 > 7 * half and min(low, high) * 50 < half:
            return "utf-16-le" if low > high else "utf-16-be"
    return None


def redact_bytes(raw: bytes | None, path: str = "") -> tuple[bytes | None, int]:
    """``raw`` with every credential blanked, and how many there were."""
    spans = scan_bytes(raw, path)
    out, at = [], 0
    wide = wide_codec(raw) if raw else None
    for _, start, end, rule, _ in spans:
        mark = "REDACTED"
        if rule == "private-key":  # keep its lines, so that line numbers stay
            blank = b"".join(x if x[:1] == b"\\" else re.sub(rb"[A-Za-z0-9+/=]{8,}", b"REDACTED", x) for x in re.split(rb"(\\[nr])", raw[start:end])) if not wide else mark.encode(wide)
        elif wide:
            blank = mark.encode(wide)
        else:
            blank = mark.encode()
        out += [raw[at:start], blank]
        at = end
    return (b"".join([*out, raw[at:]]) if spans else raw), len({(s[0], s[4]) for s in spans if s[3] != "continued"})


def content_spans(content: DataFrame) -> DataFrame:
    """Spans of credentials in candidate_content, one row each; ``row_key`` is the file_id."""
    read = content.select(F.col("file_id").cast("string").alias("row_key"), "path", F.col("bytes").alias("raw")).where(
        "not coalesce(is_binary, false)"
    )
    return _spans(read, "candidate_content")


def fact_spans(facts: DataFrame) -> DataFrame:
    """Spans of credentials in normalized_fact.text; ``row_key`` is the fact_id."""
    read = facts.select(F.col("fact_id").alias("row_key"), "path", F.encode("text", "UTF-8").alias("raw"))
    return _spans(read, "normalized_fact")


def _spans(read: DataFrame, origin: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (origin, key, no + 1, rule, name, start, end)
                for key, path, raw in zip(batch["row_key"], batch["path"], batch["raw"])
                for no, start, end, rule, name in scan_bytes(raw, path or "")
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return read.mapInPandas(run, SPANS)


def found_lines(content: DataFrame, facts: DataFrame) -> DataFrame:
    """(origin, row_key, line_no): the lines on which credentials begin."""
    both = content_spans(content).unionByName(fact_spans(facts)).where("rule <> 'continued'")
    return both.select("origin", "row_key", "line_no").distinct()


def redacted_contents(content: DataFrame) -> DataFrame:
    """(file_id, path, redacted_bytes, n_redacted) of each text file; repeated rows stay repeated."""
    schema = "file_id bigint, path string, redacted_bytes binary, n_redacted int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [redact_bytes(raw, path or "") for raw, path in zip(batch["bytes"], batch["path"])]
            yield pd.DataFrame({
                "file_id": batch["file_id"], "path": batch["path"],
                "redacted_bytes": [d[0] for d in done], "n_redacted": [d[1] for d in done],
            })

    return content.where("not coalesce(is_binary, false)").select("file_id", "path", "bytes").mapInPandas(run, schema)


def redacted(content: DataFrame, facts: DataFrame) -> DataFrame:
    """(origin, row_key, path, redacted_bytes, n_redacted) of each text file and each fact's text, in UTF-8; repeated rows stay repeated."""
    files = redacted_contents(content).select(
        F.lit("candidate_content").alias("origin"), F.col("file_id").cast("string").alias("row_key"), "path", "redacted_bytes", "n_redacted"
    )
    schema = "row_key string, path string, redacted_bytes binary, n_redacted int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [redact_bytes(raw, path or "") for raw, path in zip(batch["raw"], batch["path"])]
            yield pd.DataFrame({
                "row_key": batch["row_key"], "path": batch["path"],
                "redacted_bytes": [d[0] for d in done], "n_redacted": [d[1] for d in done],
            })

    read = facts.select(F.col("fact_id").alias("row_key"), "path", F.encode("text", "UTF-8").alias("raw"))
    texts = read.mapInPandas(run, schema).select(F.lit("normalized_fact").alias("origin"), "row_key", "path", "redacted_bytes", "n_redacted")
    return files.unionByName(texts)
