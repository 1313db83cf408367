"""Personal information in free text, by a semi-Markov conditional random field.

Generous patterns propose candidate segments with bounds on their length; they
overlap and may be of several types. Features of the whole span (its shape,
digits, check digits, words, what stands before and after) score each segment,
others score which type follows which nearby. Dynamic programming over the
segments then chooses boundaries and types jointly; text outside segments
scores 0. Weights are those of a conditional random field fitted by its exact
likelihood (forward-backward) on sentences that ``pii_training`` makes from
invented names, numbers and places; ``trained()`` fits once per process, which
takes a few seconds and is deterministic.

Time is linear in the text: a segment is scored once, and sees only segments
that end within ``REACH`` characters before it; earlier ones enter by a running
best.

Defined results: null and empty texts give no rows; positions are code points
of the text as given; a title or label is not part of an item; a name written
surname first is one item, so is an address over two lines; repeated rows give
their items each; overlapping candidates give the one best reading, ties going
to the earlier and longer one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 80
KINDS = ("email", "phone", "id_number", "address", "name")
ITEMS = "doc_id bigint, pii_kind string, start_pos int, end_pos int, item string"


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    pattern: str


# Words and shapes of addresses, titles, labels, and words that begin sentences.
STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Court|Ct\.?|Close|Avenue|Ave\.?|Way|Drive|Dr\.?|Terrace|Place|Pl\.?|Row|Square|Sq\.?|Hill|Boulevard|Blvd\.?|Crescent|Parkway|Walk|Mews)"
TOWN = r"[A-ZÀ-ÞŁŚ][\w'’-]+(?: (?:[A-ZÀ-Þ][\w'’-]+|am|an der|de|la|del|upon|sur|bei)){0,3}"
TITLES = frozenset("dr prof mr mrs ms miss mx sir herr frau hr fr señor señora sr sra sra. don doña mme mlle m monsieur madame dipl ing".split())
STOP = frozenset(
    "a an the and or but if in on at to of for from by with without as is was be it its this that these those since while when whenever before after during once under over between unless until "
    "looking reading compared nothing half every one our your my their his her some any all no not who whoever whose there here now then so yet still only also both each such same other another "
    "in short by design strangely to be fair see took version commit checksum snowflake listening pinned clone verdict summary findings next steps notes review summarise read give list please "
    "der die das den dem des ein eine einen einem und oder aber wenn ohne mit nach vor seit im in am an auf aus bei beim von vom zu zum zur unter über durch für um laut wie ob weil bis als "
    "el la los las un una y o pero si con sin por para según desde hasta en al del tras cuando como porque ahora ya que "
    "le les des du et ou mais sans avec dans sur pour par selon author reviewer reviewed-by reported-by signed-off-by owner assigned thanks call contact ping mail phone office ship sample record "
    "escribe paket rückfragen last protokoll puffer umbau versuch lauf zweig team gruppe komponente version caché traza carga cambio prueba cola sample row error result option string self".split()
)
ID_LABEL = re.compile(
    r"(?i)(?:ssn|social security(?: (?:number|no\.?|#))?|dni|nie|nif|steuer-?id(?:nr\.?)?|steueridentifikationsnummer|passport(?: (?:no|number|nr)\.?)?|reisepass(?:nr\.?)?|pasaporte|driv(?:er|ing)(?:'?s)? licen[cs]e(?: no\.?)?"
    r"|führerschein|national id(?:entity)?(?: (?:no|number)\.?)?|identity (?:card|number|no\.?)|id card|personnummer|personal(?:ausweis)?(?: ?nr\.?| ?nummer)?|residence permit|aufenthaltstitel|tax id|nhs(?: number)?"
    r"|national insurance|cpr|pesel|bsn|aadhaar|curp|rfc|cpf|身份证(?:号码?)?|护照(?:号码?)?)[ :#：=]*$"
)
PHONE_LABEL = re.compile(r"(?i)(?:tel(?:efon(?:nummer)?|éfono|ephone)?|phone|mobile|mobil|cell|call|fax|handy|móvil|unter|on call(?: tonight)?|电话|手机|号码|dial|ring|reach(?:ed)?(?: at)?)[\"']?[ .:=：]*[\"']?$")
NOT_LABEL = re.compile(r"(?i)(?:checksum|snowflake|version|v|commit|listening on|port|took|then|ticket|issue|pr|build|sha\d*|hash|shard|group|gruppe|grupo|第|dated|date|since|seed|offset|bytes?|#|@)[ :#=]*$")
MAIL_AT = r"(?:@|[ ]?[\[({<]\s?at\s?[\])}>][ ]?|[ ]at[ ])"
MAIL_DOT = r"(?:\.|[ ]?[\[({]\s?dot\s?[\])}][ ]?|[ ]dot[ ])"
EMAIL = re.compile(rf"(?<![\w.+/%-])[A-Za-z0-9À-ÿ][\w.+%'-]{{0,63}}{MAIL_AT}(?:[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?{MAIL_DOT}){{1,5}}[A-Za-z]{{2,24}}(?![\w@-]|\.[A-Za-z0-9])")
MAIL_HINT = re.compile(r"@|[\[({ ]\s?at\s?[\])} ]")
NUMBER = re.compile(r"(?<![\w.+/:-])(?:\+|\()?\d(?:(?:[ .\-/ ]|\) ?| ?\()?\d){5,20}(?:,? (?:ext|x|extn|durchwahl)\.? ?\d{1,5})?(?![\w])(?![.:-]\d)", re.I)
CODE = re.compile(r"(?<![\w.+/:@-])(?:[A-Z]{1,3}\d{2,9}(?:-\d{2,6}){0,3}[A-Z]?|\d{7,8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])(?![\w-])")
ADDRESSES = (
    ("street", re.compile(
        rf"(?<![\w.])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor) \w{{1,5}}, ?)?\d{{1,5}}[A-Za-z]? (?:[A-Z][a-zà-ÿ'’]+ ){{1,4}}{STREET}(?![a-z])"
        rf"(?:,? (?:Apt|Flat|Unit|Suite|No|#)\.? ?\w{{1,5}})?(?:(?:,[ \n]?|\n){TOWN}(?:,? [A-Z]{{2}})?(?: \d{{4,5}}(?:-\d{{4}})?| [A-Z]{{1,2}}\d\w? \d[A-Z]{{2}})?)?")),
    ("box", re.compile(rf"(?<!\w)(?:P\.? ?O\.? ?Box|Postfach|Apartado) \d{{1,6}}(?:,[ \n]?(?:\d{{4,5}} )?{TOWN}(?:,? [A-Z]{{2}})?(?: \d{{4,5}})?)?")),
    ("german", re.compile(
        rf"(?<!\w)(?:(?:Am|An der|Im|In der|Auf dem|Zum|Zur|Alte|Alter|Neue|Neuer) [A-ZÄÖÜ][a-zäöüß]+|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|graben|hof|damm|steig|markt|chaussee))"
        rf" \d{{1,4}} ?[a-z]?(?:,[ \n]?|\n)\d{{4,5}} {TOWN}")),
    ("spanish", re.compile(
        rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Ronda|Carrer|Rua|Via) (?:(?:de|la|del|los|las|el|da|do) ){{0,3}}[A-ZÁÉÍÓÚÑ]\w+(?: [^\W\d]+){{0,2}},? \d{{1,4}}"
        rf"(?:, ?\d{{1,2}}[ºª°] ?\w{{1,4}})?(?:(?:,[ \n]?|\n)\d{{4,5}} {TOWN})?")),
    ("french", re.compile(rf"(?<!\w)\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|quai|allée|impasse) (?:(?:de|la|du|des|le|les) )*[A-Zd][\w'’]+(?: [A-Z]\w+){{0,2}}(?:(?:,[ \n]?|\n)\d{{4,5}} {TOWN})?")),
)
ADDRESS_HINT = re.compile(rf"\d[A-Za-z]? (?:[A-Z][a-zà-ÿ'’]+ ){{1,4}}{STREET}|Box \d|Postfach|\d,? ?\n?\d{{4,5}} [A-Z]|[ºª]|\d,? (?:rue|avenue|boulevard|place|chemin|quai|allée) |(?:Calle|Avenida|Avda|Plaza|Paseo|Camino) ")
ZH_ADDRESS = re.compile(r"[一-鿿]{1,6}?[省市区县镇](?:[一-鿿]{1,6}?[市区县镇])?[一-鿿]{1,8}?(?:路|街|道|巷|大道|胡同)\d{1,5}号(?:院)?(?:\d{1,4}(?:栋|号楼|幢|单元))*(?:\d{1,5}室)?")
ZH_BEFORE = re.compile(r"^(?:.*(?:寄到|送到|寄往|送往|地址是|地址为|地址|住在|位于|搬到|搬至|发到|在|到|至|往))?")
ZH_NAME = re.compile(r"(?:(?:请?联系|收件人|联系人|负责人|报告人|作者|提交人|审阅人|感谢|找|由)[:： ]?)([一-鿿]{2,4})(?=[，。；、,.;\s（(]|$|(?: ?的))|(?<![一-鿿])([一-鿿]{2,4})(?= ?(?:的(?:邮箱|电话|手机|地址|号码|身份证)|先生|女士|说|已经?))")
CAP = r"(?:[A-ZÀ-ÞŁŚŽŠČ]\.|(?:Dr|Prof|Mr|Mrs|Ms|Hr|Fr|St|Sr|Sra)\.|[A-ZÀ-ÞŁŚŽŠČ][\w'’]*(?:-[A-ZÀ-Þ][\w'’]*)*)"
NAME_RUN = re.compile(rf"(?<![\w@/.:#&-]){CAP}(?:(?:,? |[ ]?, ){CAP})+")
TOKEN = re.compile(r"[^\s,]+")


def _numbers(text: str) -> Iterator[Segment]:
    for m in NUMBER.finditer(text):
        s, e = m.span()
        digits = sum(c.isdigit() for c in m[0])
        if not re.search(r"\d\d", m[0]):
            continue
        for kind in ("phone", "id_number"):
            if digits >= 7 and e - s <= 40:
                yield Segment(s, e, kind, "number")
        ext = re.search(r",? (?:ext|x|extn|durchwahl)\b.*$", m[0], re.I)
        if ext:
            yield Segment(s, s + ext.start(), "phone", "number")
    for m in CODE.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 6:
            yield Segment(*m.span(), "id_number", "code")


def _names(text: str) -> Iterator[Segment]:
    for run in NAME_RUN.finditer(text):
        tokens = [(run.start() + m.start(), run.start() + m.end()) for m in TOKEN.finditer(run[0])]
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + 4, len(tokens))):
                s, e = tokens[i][0], tokens[j][1]
                span = text[s:e]
                if e - s > 60 or span.count(",") > 1:
                    continue
                if "," in span and not re.match(rf"{CAP}(?: {CAP})?, {CAP}(?: {CAP})?$", span):
                    continue
                if span.endswith(".") and not re.search(r"\b[A-Z]\.$", span):
                    e -= 1
                yield Segment(s, e, "name", "latin")
    if not text.isascii():
        for m in ZH_NAME.finditer(text):
            g = 1 if m[1] else 2
            for cut in range(2, len(m[g]) + 1):
                s, e = (m.start(g), m.start(g) + cut) if g == 1 else (m.end(g) - cut, m.end(g))
                yield Segment(s, e, "name", "han")


def candidates(text: str) -> list[Segment]:
    """Segments the field chooses from, in order of their ends."""
    out: set[Segment] = set()
    if MAIL_HINT.search(text):
        out.update(Segment(*m.span(), "email", "mail") for m in EMAIL.finditer(text))
    out.update(_numbers(text))
    if ADDRESS_HINT.search(text):
        for name, pattern in ADDRESSES:
            out.update(Segment(*m.span(), "address", name) for m in pattern.finditer(text))
    if not text.isascii():
        for m in ZH_ADDRESS.finditer(text):
            s = m.start() + len(ZH_BEFORE.match(m[0])[0])
            if m.end() - s > 6:
                out.add(Segment(s, m.end(), "address", "han"))
                out.add(Segment(m.start(), m.end(), "address", "han"))
    out.update(_names(text))
    return sorted(out, key=lambda g: (g.end, g.start, g.kind))


def shape(span: str) -> str:
    """Character classes with their run lengths, letters up to two."""
    s = re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 20)}", span)
    return re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]{2,}", "AA", s))[:40]


def mod11(digits: str) -> bool:
    """Check character of an 18-place identity number (ISO 7064 MOD 11-2)."""
    total = sum(int(d) * (2 ** (17 - i) % 11) for i, d in enumerate(digits[:17]))
    return "10X98765432"[total % 11] == digits[17].upper()


@lru_cache(maxsize=100_000)
def _token_features(token: str) -> tuple[str, ...]:
    bare = token.strip(".,'’")
    low = bare.lower()
    out = []
    if low in TITLES:
        out.append("title")
    if low in STOP:
        out.append("stop")
    if len(bare) == 1:
        out.append("initial")
    elif bare.isupper():
        out.append("upper")
    elif "-" in bare:
        out.append("hyphen")
    elif not bare[1:].islower():
        out.append("mixed")
    if len(bare) >= 3:
        out.append("t=" + low[-3:])
    if re.search(r"[\d_]", bare):
        out.append("digit")
    return tuple(out)


def features(text: str, g: Segment) -> list[str]:
    """Whole-span features of a segment."""
    span = text[g.start:g.end]
    before, after = text[max(0, g.start - 32):g.start], text[g.end:g.end + 24]
    line = before.rsplit("\n", 1)[-1] if "\n" in before else before
    prev = (line.rstrip(" \"'<([*").rsplit(" ", 1)[-1] or "^").lower()[-14:]
    nxt = (re.split(r"[ \n]", after.lstrip(" \"'>)]*.,;:"), maxsplit=1)[0] or "$").lower()[:12]
    k = g.kind
    out = [k, f"{k}|p={g.pattern}", f"{k}|b={before[-1:] or '^'}", f"{k}|a={after[:1] or '$'}"]
    if k == "email":
        tld = re.split(r"[.\s)\]}]", span)[-1].lower()
        local = re.split(r"@|[\[({ ]", span)[0]
        at = "@" if "@" in span else "wrapped" if re.search(r"[\[({]\s?at", span) else "plain"
        out += [f"e|at={at}", f"e|tld={'file' if tld in FILES else 'ok'}", f"e|at={at}|tld={'file' if tld in FILES else 'ok'}"]
        out += [f"e|at={at}|mark={bool(re.search(r'[._+0-9-]', local))}", f"e|colon={bool(re.match(r':[A-Za-z~./]', after))}", f"e|vcs={local in ('git', 'hg', 'svn')}"]
        if at == "plain":
            out += [f"e|plain|len={min(len(local), 6)}", f"e|plain|stop={local.lower() in STOP}", f"e|plain|b={before[-1:] or '^'}"]
    elif k in ("phone", "id_number"):
        digits = re.sub(r"\D", "", span)
        base = re.sub(r",? (?:ext|x|extn|durchwahl)\b.*$", "", span, flags=re.I)
        label = "id" if ID_LABEL.search(before) else "phone" if PHONE_LABEL.search(before) else "not" if NOT_LABEL.search(before) else "none"
        out += [f"{k}|s={shape(base)}", f"{k}|label={label}", f"{k}|label={label}|p={g.pattern}", f"{k}|n={min(len(digits), 20)}", f"{k}|plus={span[0]}", f"{k}|ext={base != span}"]
        out += [f"{k}|cell={before.endswith('| ') and after[:2] in (' |', '')}", f"{k}|label={label}|sep={bool(re.search(r'[ ()/.-]', base))}"]
        if len(digits) == 18 and span.isdigit():
            out += [f"{k}|check={mod11(digits)}", f"{k}|born={_date(digits[6:14])}"]
        if re.match(r"\d{6}-\d{4}$", span):
            out.append(f"{k}|born6={_date('19' + span[:6])}")
        if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", base) or re.match(r"\d{4}-\d\d-\d\d", span):
            out.append(f"{k}|dotted")
        if re.fullmatch(r"(?:19|20)\d\d[-./ ][01]\d[-./ ][0-3]\d", base):
            out.append(f"{k}|date")
        if re.match(r" ?(?:ms|s|MB|KB|bytes|%|rows|lines)\b", after):
            out.append(f"{k}|unit")
    elif k == "address":
        out += [f"address|zip={bool(re.search(r'[0-9]{4,5}', span[8:]))}", f"address|{g.pattern}|long={len(span) > 14}", f"address|lines={span.count(chr(10))}"]
        out += [f"address|lead={bool(re.match('.*(?:寄|送|址|在)', span))}", f"address|len={min(len(span) // 6, 8)}"]
    elif g.pattern == "han":
        out += [f"han|n={len(span)}", f"han|b={before[-2:]}", f"han|a={after[:2]}"]
    else:
        tokens = [t for t in re.split(r"[ ,]+", span) if t]
        per = [_token_features(t) for t in tokens]
        kinds = ["stop" if "stop" in p else "title" if "title" in p else "init" if "initial" in p else "up" if "upper" in p else "hy" if "hyphen" in p else "mix" if "mixed" in p else "cap" for p in per]
        out += [f"name|form={'-'.join(kinds)}{',' if ',' in span else ''}", f"name|n={len(tokens)}", f"name|prev={prev}", f"name|next={nxt}"]
        out += [f"name|anystop={'stop' in kinds}", f"name|first={kinds[0]}", f"name|last={kinds[-1]}", f"name|digit={any('digit' in p for p in per)}"]
        out += [f"name|b2={before[-3:]}", f"name|a2={after[:3]}", f"name|line={'^' if not line.strip(' -*>|#') else '.'}{'$' if after[:1] in ('', chr(10)) else '.'}"]
        out += [f"name|street={bool(re.search(STREET + r'$', span)) and len(span) > 3}", f"name|numbered={bool(re.search(r'[0-9] ?$', before))}", f"name|mailnext={bool(re.match(r'[ ,;|]{0,3}<?[^ <>]+(?:@| ?[\[(]at| at )', after))}"]
        out += [f"name|sig={bool(re.search(r'-- ?' + chr(10) + '$', before))}", f"name|zip={bool(re.match(r',? [A-Z]{2} [0-9]{5}', after))}"]
        loud = [w for w in re.findall(r"[^\W\d_]{2,}", line[-16:])[-1:] + re.findall(r"[^\W\d_]{2,}", after.split(chr(10))[0])[:1] if w.isupper()]
        out += [f"name|loud={len(loud)}", f"name|loud={len(loud)}|{kinds[-1]}"]
        more = re.match(r" [A-ZÀ-Þ][\w'’-]*", after)
        out.append(f"name|more={_more(more[0].strip()) if more else 'no'}")
        ahead = re.search(r"([A-ZÀ-Þ][\w'’.-]*),? $", before)
        out.append(f"name|lead={_more(ahead[1]) if ahead else 'no'}")
    return out


# Endings of files and packages, not of mail domains.
FILES = frozenset("rs py ts js toml sql yaml yml json md txt sh css html go java c h cpp lock cfg ini log csv tsx jsx rb".split())


def _more(token: str) -> str:
    f = _token_features(token)
    return "stop" if "stop" in f else "title" if "title" in f else "word"


def _date(digits: str) -> bool:
    return len(digits) == 8 and 1900 <= int(digits[:4]) <= 2030 and 1 <= int(digits[4:6]) <= 12 and 1 <= int(digits[6:]) <= 31


def follows(text: str, a: Segment, b: Segment) -> str:
    """The feature of segment ``b`` coming soon after ``a``."""
    gap = re.sub(r"\w+", "w", text[a.end:b.start])
    return f"{a.kind}>{b.kind}|{gap if len(gap) <= 6 else 'far'}"


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """The weights, decoding and fitting."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, names: list[str]) -> float:
        w = self.w
        return sum([w.get(n, 0.0) for n in names])

    def decode(self, text: str) -> list[Segment]:
        """The best set of segments that do not overlap."""
        segs = candidates(text)
        if not segs:
            return []
        ends = [g.end for g in segs]
        best: list[float] = []
        back: list[int] = []
        top: list[tuple[float, int]] = []  # the best reading that ends with one of the segments so far
        for k, g in enumerate(segs):
            own = self.score(features(text, g))
            upto = bisect_left(ends, g.start + 1, 0, k)
            near = bisect_left(ends, g.start - REACH, 0, upto)
            value, at = (top[near - 1] if near and top[near - 1][0] > 0 else (0.0, -1))
            for j in range(near, upto):
                v = best[j] + self.w.get(follows(text, segs[j], g), 0.0)
                if v > value:
                    value, at = v, j
            best.append(value + own)
            back.append(at)
            top.append(max(top[-1], (best[k], k)) if top else (best[k], k))
        value, at = top[-1]
        out = []
        while value > 0 and at >= 0:
            out.append(segs[at])
            at = back[at]
        return out[::-1]

    def fit(self, examples: list[tuple[str, set[tuple[int, int, str]]]], passes: int = 6, rate: float = 0.25, ridge: float = 1e-4) -> Field:
        """Ascends the conditional likelihood of the gold readings (AdaGrad)."""
        ready = []
        for text, gold in examples:
            segs = candidates(text)
            if segs:
                feats = [features(text, g) for g in segs]
                right = [(g.start, g.end, g.kind) in gold for g in segs]
                pairs = {
                    (j, k): follows(text, segs[j], segs[k])
                    for k in range(len(segs)) for j in range(len(segs)) if segs[j].end <= segs[k].start <= segs[j].end + REACH
                }
                ready.append((segs, feats, right, pairs))
        squares: dict[str, float] = {}
        for _ in range(passes):
            for segs, feats, right, pairs in ready:
                for name, grad in self._gradient(segs, feats, right, pairs).items():
                    grad -= ridge * self.w.get(name, 0.0)
                    squares[name] = squares.get(name, 1e-6) + grad * grad
                    self.w[name] = self.w.get(name, 0.0) + rate * grad / math.sqrt(squares[name])
        return self

    def _gradient(self, segs, feats, right, pairs) -> dict[str, float]:
        n, w = len(segs), self.w
        own = [self.score(f) for f in feats]
        step = {jk: w.get(name, 0.0) for jk, name in pairs.items()}
        ahead = [[0.0] for _ in range(n)]
        alpha = [0.0] * n
        for k in range(n):
            for j in range(k):
                if segs[j].end <= segs[k].start:
                    ahead[k].append(alpha[j] + step.get((j, k), 0.0))
            alpha[k] = own[k] + _logsum(ahead[k])
        total = _logsum([0.0, *alpha])
        beta = [0.0] * n
        order = sorted(range(n), key=lambda k: -segs[k].start)
        for j in order:
            beta[j] = _logsum([0.0, *[own[k] + beta[k] + step.get((j, k), 0.0) for k in range(n) if segs[j].end <= segs[k].start]])
        grad: dict[str, float] = {}
        for k in range(n):
            miss = right[k] - math.exp(alpha[k] + beta[k] - total)
            if abs(miss) > 1e-4:
                for name in feats[k]:
                    grad[name] = grad.get(name, 0.0) + miss
        gold = [k for k in range(n) if right[k]]
        chosen = set(zip(gold, gold[1:]))
        for (j, k), name in pairs.items():
            miss = ((j, k) in chosen) - math.exp(min(0.0, alpha[j] + step[j, k] + own[k] + beta[k] - total))
            if abs(miss) > 1e-4:
                grad[name] = grad.get(name, 0.0) + miss
        return grad


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted on the made sentences; the same in every process."""
    from lodestrata.llm.pii_training import examples

    return Field().fit(examples())


def find_items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per item; the weights are fitted on the driver and sent to the tasks (a few thousand numbers)."""
    weights = docs.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(weights.value)
        for batch in batches:
            rows = [
                (d, g.kind, g.start, g.end, t[g.start:g.end]) for d, t in zip(batch["doc_id"], batch["text"]) for g in field.decode(t)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return read.mapInPandas(run, ITEMS)


def replaced(text: str, field: Field) -> tuple[str, int]:
    """``text`` with typed placeholders, and how many."""
    out, at = [], 0
    found = field.decode(text)
    for g in found:
        out += [text[at:g.start], f"[{g.kind.upper()}]"]
        at = g.end
    return "".join([*out, text[at:]]), len(found)


def redacted_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, redacted_text, n_items) of every document with a text."""
    weights = docs.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(weights.value)
        for batch in batches:
            done = [replaced(t, field) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "redacted_text": [d[0] for d in done], "n_items": [d[1] for d in done]})

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id bigint, redacted_text string, n_items int")


def found_items(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start_pos) of every item."""
    return find_items(docs).select("doc_id", "pii_kind", "start_pos").distinct()
