"""Evaluation passages leaking into training text, by template canonicalisation.

Both sides are read as words and their parts: markup, marks and case are dropped. A word's
canonical form replaces numbers, names (identifiers, paths, hosts, versions) and
units by typed placeholders. Windows of canonical words are hashed and joined
between documents and items; from each joined window the two texts are aligned
both ways, allowing a changed, added or missing word now and then. The slots
under the placeholders then tell a quote from the same question with other
parameters: a stretch whose words agree is ``verbatim``; one that agrees only as
a template, each slot value always replaced by the same other one, is
``reparameterised``.

Items are a stated query set. While they hold at most ``broadcast_windows``
words their windows go to all tasks and the documents are read once, without a
shuffle. More items are dealt into blocks of that size: a shuffled hash join of
windows, each counted once per document and once per block, names the documents
that share a window with a block, and only those are compared with it. No pair
of document and item is ever made before it is known to match, and no text is
shuffled where the documents named are few enough to be broadcast.

Defined results: null and empty texts or prompts match nothing, nor do rows without an id; an item without
an instruction paragraph is a passage as a whole; a passage shorter than
``least`` words cannot be found; each doc_id with the same text gets its rows;
several stretches of one item in one document are one row, with the longest.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, small

WINDOW = 7  # canonical words in a joined window
LEAST = 25  # words of a passage that make a leak
SLACK = 2  # changes allowed ..
SPAN = 10  # .. among so many parts
AGREE = 0.84  # share of a quote's parts that agree
JUMP = 4  # parts that one change may take on either side
SKIPS = sorted(((i, j) for i in range(JUMP + 1) for j in range(JUMP + 1) if i or j), key=lambda s: (max(s), sum(s), s[0] != s[1]))
PROMISING = 12  # words that must agree as a template before the words themselves are compared
BROADCAST_WINDOWS = 1_000_000

TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
LINK = re.compile(r"\[([^\[\]\n]*)\]\([^()\s]*\)")
PART = re.compile(r"[^\W_]+")
CJK = re.compile(r"([぀-ヿ㐀-鿿豈-﫿])")
NUMBER = re.compile(r"[^\w]*[-+]?\d[\d.,:/%-]*[^\w]*$")
MEASURE = re.compile(r"[^\w]*\d[\d.,]*[A-Za-z%°µ]{1,4}[^\w]*$")
NAME = re.compile(r"\w[_/\\@:]\w|\w\.\w|\wv?\d|^\W*v\d|[a-z][A-Z]")
# Words that name a unit.
UNITS = frozenset("ms s sec secs second seconds minute minutes min hour hours h day days week weeks b kb mb gb bytes byte kib mib percent rows lines files entries times attempts tage dateien zeilen".split())
MATCHES = "doc_id bigint, item_id bigint, kind string, n_words int, n_equal int, doc_word int, item_word int"


@lru_cache(maxsize=200_000)
def token_forms(raw: str) -> tuple[str, tuple[str, ...]]:
    """A token's canonical form and its parts in lower case; no parts for marks alone."""
    parts = tuple(PART.findall(raw.lower()))
    if not parts:
        return "", ()
    if NUMBER.match(raw) or MEASURE.match(raw):
        return "<number>", parts
    core = raw.strip("`*_~\"'“”‘’()[]{}<>.,;:!?|#")
    if NAME.search(core):
        return "<name>", parts
    plain = "".join(parts)
    return "<unit>" if plain in UNITS else plain, parts


class Words:
    """A text as tokens (runs without white space) and their parts (runs of letters and digits).

    ``canonical`` has a form per token; ``parts`` all parts in order, ``of_token``
    the place of each token's first part, ``token_of`` the token of each part.
    Marks that split a token in one text and not in the other leave parts alike.
    """

    def __init__(self, text: str):
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii():
            text = CJK.sub(r" \1 ", unicodedata.normalize("NFKC", text))
        if "<" in text:
            text = TAG.sub(" ", text)
        if "](" in text:
            text = LINK.sub(r"\1", text)
        self.canonical: list[str] = []
        self.parts: list[str] = []
        self.of_token: list[int] = []
        self.token_of: list[int] = []
        self._back: dict[str, list[str]] = {}
        for form, parts in map(token_forms, text.split()):
            if parts:
                self.of_token.append(len(self.parts))
                self.token_of.extend([len(self.canonical)] * len(parts))
                self.canonical.append(form)
                self.parts.extend(parts)


    def back(self, name: str) -> list[str]:
        """``parts`` or ``canonical`` from behind, made once."""
        if name not in self._back:
            self._back[name] = getattr(self, name)[::-1]
        return self._back[name]


@lru_cache(maxsize=200_000)
def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def window_hashes(canonical: list[str], size: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` words, as signed integers."""
    n = len(canonical) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hash_of, canonical), np.uint64, len(canonical))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return out.view(np.int64)


def _extend(p: list, d: list, a: int, b: int) -> list[tuple[int, int, int]]:
    """Runs (place in p, place in d, length) that agree from (a, b) on."""
    end_p, end_d = len(p), len(d)
    at, changes, runs = 0, [], []
    while a < end_p and b < end_d:
        if p[a] == d[b]:
            x, y = a + 1, b + 1
            while x < end_p and y < end_d and p[x] == d[y]:
                x, y = x + 1, y + 1
            runs.append((a, b, x - a))
            at += x - a
            a, b = x, y
            continue
        changes = [c for c in changes if at - c < SPAN]
        if len(changes) >= SLACK or set(p[a:a + JUMP + 1]).isdisjoint(d[b:b + JUMP + 1]):
            break
        for skip_p, skip_d in SKIPS:
            x, y = a + skip_p, b + skip_d
            if x < end_p and y < end_d and p[x] == d[y]:
                if (x + 1 >= end_p or y + 1 >= end_d or p[x + 1] == d[y + 1]) and (max(skip_p, skip_d) <= 2 or x + 2 >= end_p or y + 2 >= end_d or p[x + 2] == d[y + 2]):
                    break
        else:
            break
        changes.append(at)
        a, b, at = x, y, at + 1
    return runs


def stretch(p: list, d: list, back_p: list, back_d: list, a: int, b: int) -> list[tuple[int, int, int]]:
    """The agreeing runs around (a, b), in order; ``back_*`` are the same lists from behind."""
    n, m = len(p), len(d)
    left = [(n - x - k, m - y - k, k) for x, y, k in _extend(back_p, back_d, n - a, m - b)]
    return left[::-1] + _extend(p, d, a, b)


def places_of(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    return [(a + i, b + i) for a, b, k in runs for i in range(k)]


def trimmed(equal: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch without runs at its ends, as far as they keep it below ``AGREE``."""
    i, j = 0, len(equal) - 1
    while i < j and (j - i + 1) < AGREE * (equal[j][0] - equal[i][0] + 1):
        x, y = i, j
        while x < j and equal[x + 1][0] - equal[x][0] == 1:
            x += 1
        while y > i and equal[y][0] - equal[y - 1][0] == 1:
            y -= 1
        x, y = min(x + 1, j), max(y - 1, i)
        if (j - x + 1) / (equal[j][0] - equal[x][0] + 1) >= (y - i + 1) / (equal[y][0] - equal[i][0] + 1):
            i = x
        else:
            j = y
    return equal[i:j + 1]


def consistent(p: Words, d: Words, found: tuple[int, int, int, int]) -> bool:
    """Whether slot values under a template stretch are always replaced alike."""
    p0, p1, d0, d1 = found

    def slots(w: Words, first: int, last: int) -> list[tuple[str, ...]]:
        ends = [*w.of_token[1:], len(w.parts)]
        return [tuple(w.parts[w.of_token[i]:ends[i]]) for i in range(first, last + 1) if w.canonical[i] in ("<number>", "<name>")]

    mine, theirs = slots(p, p0, p1), slots(d, d0, d1)
    if len(mine) != len(theirs):
        return False
    there: dict[tuple[str, ...], tuple[str, ...]] = {}
    return all(there.setdefault(m, t) == t for m, t in zip(mine, theirs))


def passage_of(prompt: str | None) -> str:
    """The prompt without its instruction, the first of several paragraphs."""
    if not prompt:
        return ""
    head, blank, rest = prompt.replace("\r\n", "\n").partition("\n\n")
    return rest if blank and rest.strip() else head


class Items:
    """The items' words and windows, as every task holds them."""

    def __init__(self, prompts: list[tuple[int, str]]):
        self.ids = [i for i, _ in prompts]
        self.words = [Words(passage_of(prompt)) for _, prompt in prompts]
        pairs = sorted((h, i, k) for i, w in enumerate(self.words) for k, h in enumerate(window_hashes(w.canonical).tolist()))
        self.hashes = np.array(sorted({h for h, _, _ in pairs}), np.int64)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for h, i, k in pairs:
            self.places[h].append((i, k))

    def matches(self, text: str, least: int = LEAST) -> list[tuple[int, str, int, int, int, int]]:
        """(item, kind, words, equal parts, word in text, word in passage), the best of each item."""
        d = Words(text)
        if len(d.parts) < least or not len(self.hashes):
            return []
        h = window_hashes(d.canonical)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        seeds = [(b, item, a) for b in np.flatnonzero(self.hashes[at] == h).tolist() for item, a in self.places[int(h[b])]]
        if not seeds:
            return []
        best: dict[int, tuple] = {}
        shaped: dict[tuple[int, int], tuple[int, int]] = {}  # until where a diagonal is aligned as a template, and over how many words
        quoted: dict[tuple[int, int], int] = {}
        for b, item, a in seeds:
            p, row = self.words[item], None
            end, span = shaped.get((item, b - a), (-1, 0))
            if end < b:
                span, row = self._template(p, d, item, a, b, shaped, least)
            if span >= PROMISING and quoted.get((item, b - a), -1) < b:
                row = self._quote(p, d, item, a, b, quoted, least) or row
            if row and (item not in best or row > best[item]):
                best[item] = row
        return [(self.ids[r[2]], r[3], r[1], r[4], r[5], r[6]) for r in best.values()]

    @staticmethod
    def _quote(p: Words, d: Words, item: int, a: int, b: int, done: dict[tuple[int, int], int], least: int):
        """A stretch of equal parts through the joined window."""
        for k in range(WINDOW):
            x, y = p.of_token[a + k], d.of_token[b + k]
            if p.parts[x] == d.parts[y] and (x + 1 >= len(p.parts) or y + 1 >= len(d.parts) or p.parts[x + 1] == d.parts[y + 1]):
                break
        else:
            return None
        runs = stretch(p.parts, d.parts, p.back("parts"), d.back("parts"), x, y)
        first, last = runs[0][0], runs[-1][0] + runs[-1][2] - 1
        end = runs[-1][1] + runs[-1][2] - 1
        for shift in {b - a, d.token_of[end] - p.token_of[last]}:
            done[item, shift] = max(done.get((item, shift), -1), d.token_of[end])
        if p.token_of[last] - p.token_of[first] + 1 < least:
            return None
        equal = trimmed(places_of(runs))
        n = p.token_of[equal[-1][0]] - p.token_of[equal[0][0]] + 1
        return (1, n, item, "verbatim", len(equal), d.token_of[equal[0][1]], p.token_of[equal[0][0]]) if n >= least else None

    @staticmethod
    def _template(p: Words, d: Words, item: int, a: int, b: int, shaped: dict[tuple[int, int], tuple[int, int]], least: int):
        """How many words agree around the joined window in canonical form, and the match if its slots are replaced consistently."""
        runs = stretch(p.canonical, d.canonical, p.back("canonical"), d.back("canonical"), a, b)
        (p0, d0, _), (x, y, k) = runs[0], runs[-1]
        p1, d1 = x + k - 1, y + k - 1
        span = p1 - p0 + 1
        for shift in {b - a, d1 - p1}:
            shaped[item, shift] = max(shaped.get((item, shift), (-1, 0)), (d1, span))
        if span < least or not consistent(p, d, (p0, p1, d0, d1)):
            return span, None
        return span, (0, span, item, "reparameterised", sum(n for _, _, n in runs), d0, p0)


def leaks(
    docs: DataFrame, items: DataFrame, least: int = LEAST, broadcast_windows: int = BROADCAST_WINDOWS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", prompt: str = "prompt",
) -> DataFrame:
    """One row per document and item whose passage it holds in part or whole."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    items = items.select(F.col(item_id).alias("item_id"), F.col(prompt).alias("prompt")).where("prompt is not null and item_id is not null")
    size = items.agg(F.sum(F.size(F.split("prompt", r"\s+"))).alias("n")).first().n or 0
    if size <= broadcast_windows:
        return _compared(docs, items, least)
    return _in_blocks(docs, items, least, -(-size // max(1, broadcast_windows)))


def _compared(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """Documents against items that were counted to be few enough for a task."""
    held = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.prompt) for r in items.collect()])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _items_of(key, held)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in known.matches(t, least)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ")])

    return docs.mapInPandas(run, MATCHES)


_HELD: dict[str, Items] = {}


def _items_of(key: str, held) -> Items:
    """The index of a broadcast, built once per worker process; the last one is kept."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Items(held.value)
    return _HELD[key]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = [np.unique(window_hashes(Words(t).canonical)) for t in batch["text"]]
        yield pd.DataFrame({
            "key": np.repeat(batch["key"].to_numpy(), [len(h) for h in hashes]) if len(batch) else np.empty(0, np.int64),
            "h": np.concatenate(hashes) if hashes else np.empty(0, np.int64),
        })


def _in_blocks(docs: DataFrame, items: DataFrame, least: int, blocks: int) -> DataFrame:
    """The same for items too many to hold in a task, block by block."""
    dealt = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    passages = dealt.mapInPandas(
        lambda batches: (pd.DataFrame({"key": b["block"], "text": ["\n\n" + passage_of(p) for p in b["prompt"]]}) for b in batches),
        "key bigint, text string",
    )
    of_blocks = passages.mapInPandas(_windows, "key bigint, h bigint").select(F.col("key").alias("block"), "h").distinct()
    of_docs = docs.select(F.col("doc_id").alias("key"), "text").mapInPandas(_windows, "key bigint, h bigint").withColumnRenamed("key", "doc_id")
    named = cut(of_docs.join(of_blocks, "h").select("doc_id", "block").distinct())
    parts = []
    for block in range(blocks):
        of_block = small(named.where(F.col("block") == block).select("doc_id"))
        parts.append(_compared(docs.join(of_block, "doc_id", "left_semi"), dealt.where(F.col("block") == block).drop("block"), least))
    return reduce(DataFrame.unionByName, parts)


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents holding 25 or more words of an item's passage in order."""
    return leaks(docs, items).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()
