"""Generated, minified, vendored or data files among the listed source files.

Linear support-vector classifiers, one per kind, score each file on three views:

* hashed character n-grams of its text with giveaway notices masked, so that the
  text view learns how such files are written, not their headers;
* path components and the parts of the file name;
* notices (their kind and place), whether a copyright holder is the repository's
  own, the shape of the text (line lengths, shares of digits, of base64 runs and
  of table rows, ..), the language the manifest names, and how much of the text
  other repositories hold too.

They are fitted on a bounded sample of files labelled by their giveaways, each
shown whole, with its notices masked, and with its path masked, so that a file
that lacks one of them is still recognised. Repositories are split for
validation: those with a hash of 0 mod 5 only measure.

Copies between repositories are found over all files: each file keeps the
``SKETCH`` least hashes of its lines (of statements where lines are very long, of
runs of lines where they are short), and a hash counts as shared when
two repositories hold it. A repository's own holder is the one that most of its
files without other signs of foreign origin name. Only hashes, names and counts
are shuffled, never texts; what files of other rows tell about a file is added to
its linear score afterwards, by joins of narrow rows.

Defined results: entries not present, without text content, or with binary
content give no row; every listing of a (repo_id, path) counts, later ones too;
repeated content rows count once (of differing ones any positive decides); null
paths match nothing; an empty file is hand-written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, small

KINDS = ("generated", "minified", "vendored", "data")
BITS = 18
SKETCH = 12
LONG_LINE = 32
SHORT_RUN = 8  # successive lines that count as one where lines are short
WIDE_LINE = 2_000  # longer lines are taken apart into statements
HOT_FILES = 20_000  # a line in more files than that is looked up by broadcast
TRAIN_ROWS = 3_000  # labelled files fitted on at most, half of them hand-written
GRAM_SCALE = 1.0  # length of the n-gram part of a file, whose named features are 1 each
MASKED_WEIGHT = 0.02  # of a view in which every giveaway is masked and only the way of writing is left
BAR = 0.3  # the score above which a file is not hand-written here
TRAIN_BYTES = 65_536  # longer files are scored whole, but not fitted on

# Parts of paths that give a file away.
VENDOR_PARTS = frozenset("vendor _vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components external externals deps pods imported".split())
GENERATED_PARTS = frozenset("gen generated __generated__ .autogen autogen autogenerated __snapshots__ dist".split())
NAME_PARTS = frozenset("min pb g snap generated bundle designer".split())
# Wordings of notices in comments.
COMMENT = re.compile(r"[ \t]*(?://|#|--|/\*|\*|;|<!--|%|\"\"\")")
CLOSERS = {"/*": "*/", "<!--": "-->", '"""': '"""'}
GENERATED = re.compile(
    r"(?i)@generated\b|\bcode generated by\b|auto[- ]?generated (?:file|by|with|from|code)|</?auto-?generated>|autogenerated|automatically generated (?:from|by)|\bgenerated (?:from|by) \S+[.:]|manual changes will be lost"
    r"|\bdo not (?:edit|modify)\b|machine[- ](?:written|generated) by|regenerate instead of editing|regenerated nightly|rerun the tool|edit that instead|自动生成|自動生成|请勿手动修改|maschinell erzeugt|automatisch (?:erzeugt|generiert)|nicht bearbeiten"
    r"|generado automáticamente|no (?:editar|modificar)\b|généré automatiquement|ne pas (?:modifier|éditer)"
)
BY_HAND = re.compile(r"(?i)by hand|edit freely|\bwrites?\b|rewritten|checked by|maintained|detects?\b|\bif\b.*\bthen\b|\breplaces\b")
FOREIGN = re.compile(
    r"(?i)vendored from \S+|upstream: ?\S+@\S+|\blocal copy\b|keep in sync with upstream|copied from \S+[/@.]\S+|imported from \S+@|spdx-filecopyrighttext|spdx-license-identifier|licensed under the|\b(?:mit|bsd|apache)\b.{0,14}licen[cs]e"
    r"|\(c\) .{2,60}\b(?:mit|bsd|apache|isc)\b|/\*! ?[\w.-]+ v\d|^\W*[\w.-]+ \d+\.\d+\.\d+\s*$"
)
HOLDER = re.compile(r"(?i)copyright (?:\(c\) |© )?(?:\d{4}(?:-\d{4})? )?([A-Z一-鿿][^\n.,;*]{2,60})")
SOURCE_MAP = re.compile(r"[#@] ?sourceMappingURL=")
STATEMENT = re.compile(rb"(?<=[;}])")
WEIGH = re.compile(rb"[A-Za-z0-9+/=]{60,}")
ROW = re.compile(rb"^[ \t]*(?:[\[({]?[ \t]*(?:0x[0-9a-fA-F]+|-?\d[\d.]*|\"[^\"\n]{0,40}\" ?: ?[^,\n]{1,40})(?:[ \t]*[,:)\]}]+[ \t]*|$)){2,}|^[ \t]*\"[A-Za-z0-9+/=]{40,}\"[,)]?[ \t]*\r?$", re.M)
TRIGGERS = (
    "enerat", "erzeugt", "edit", "vendor", "upstream", "copyright", "(c)", "licen", "spdx", "modif", "machine", "sourcemap", "local copy", "rerun", "bearbeiten", "自动", "自動", "by hand", "©", "imported", "copied", "manual",
)
VERSIONED = re.compile(r"(?m)^[^\w\n]{0,6}[\w.-]+ v?\d+\.\d+\.\d+")


@lru_cache(maxsize=1)
def triggers():
    """Finds the lines that may be notices."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in TRIGGERS:
        a.add_word(w, 1)
    a.make_automaton()
    return a


def text_of(raw: bytes) -> str:
    """The text of a file in UTF-8, UTF-16 with a byte order mark, or else Windows-1252."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def notices(text: str) -> tuple[list[tuple[str, str]], list[str], list[tuple[int, int]]]:
    """(kind, place) of each notice, copyright holders, and the spans of all of them for masking.

    Only comment lines hold notices; a sentence about notices, or one that says
    the file is kept by hand, is one of kind ``hand``.
    """
    found, holders, spans = [], [], []
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case; then places are those of the ASCII form
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = {low.rfind("\n", 0, end) + 1 for end, _ in triggers().iter(low)}
    hits.update(m.start() for m in VERSIONED.finditer(text))
    if not hits:
        return found, holders, spans
    n_lines = text.count("\n") + 1
    for at in sorted(hits):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if not (opened := COMMENT.match(text, at)):
            continue
        if (close := CLOSERS.get(opened[0].strip())) and (closed := text.find(close, opened.end(), end)) >= 0:
            end = closed + len(close)  # code may follow on the line
        line = text[at:end].strip()
        no = text.count("\n", 0, at)
        place = "head" if no < 4 else "tail" if no > n_lines - 5 else "inner"
        kind = None
        if BY_HAND.search(line) and re.search(r"(?i)generat|vendor|minif|edit", line) and not re.search(r"(?i)modify by hand|modify this", line):
            kind = "hand"
        elif GENERATED.search(line):
            kind = "generated"
        elif FOREIGN.search(line):
            kind = "foreign"
        elif SOURCE_MAP.search(line):
            kind = "map"
        elif m := HOLDER.search(line):
            holders.append(re.sub(r"(?i)[\s.]*all rights reserved.*", "", m[1]).strip())
            kind = "holder"
        if kind:
            spans.append((at, end))
            if kind != "holder":
                found.append((kind, place))
    return found, holders, spans


def path_features(path: str) -> list[str]:
    """Path components, pairs of them, and the parts of the file name."""
    *folders, name = path.split("/")
    out = [f"D:{f.lower()}" for f in folders] + [f"DD:{a.lower()}/{b.lower()}" for a, b in zip(folders, folders[1:])]
    parts = name.lower().split(".")
    out += [f"N:{'.'.join(parts[1:])}"] + [f"M:{p}" for p in parts[1:-1]] + [f"E:{parts[-1] if len(parts) > 1 else ''}"]
    stem = re.split(r"[_\-]", parts[0])
    out += [f"S:{stem[-1]}"] if len(stem) > 1 else []
    out += ["V:name"] if len(stem) > 1 and stem[-1] == "generated" else []
    return out + ["V:vendor" for f in folders if f.lower() in VENDOR_PARTS] + ["V:generated" for f in folders if f.lower() in GENERATED_PARTS] + [
        "V:name" for p in parts[1:-1] if p in NAME_PARTS
    ]


def shape_features(raw: bytes) -> list[str]:
    """Line lengths and the shares of digits, base64 runs and table rows, in steps."""
    n = max(1, len(raw))
    lines = raw.split(b"\n")
    longest = max(map(len, lines))
    digits = sum(raw.count(d) for d in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")) / n
    runs = sum(map(len, WEIGH.findall(raw))) / n if longest >= 60 else 0.0
    rows = sum(map(len, ROW.findall(raw))) / n if digits > 0.12 or runs > 0.2 else 0.0
    spaces = raw.count(b" ") / n
    filled = sum(1 for s in lines if s.strip())
    comments = sum(1 for s in lines if s.lstrip()[:2] in (b"//", b"--", b"/*") or s.lstrip()[:1] == b"#")
    step = lambda x, cuts: sum(x > c for c in cuts)
    dense = longest > 400 and longest / n > 0.5
    punctuation = sum(raw.count(p) for p in (b"{", b"}", b"(", b")", b";", b"=", b":", b",")) / n
    return [
        f"H:long={step(longest, (200, 400, 800, 1600))}", f"H:mean={step(n / max(1, filled), (30, 60, 120, 300, 800))}", f"H:digits={step(digits, (.08, .15, .22, .3))}",
        f"H:runs={step(runs, (.1, .3, .5, .7, .85))}", f"H:rows={step(rows, (.1, .3, .5, .7))}", f"H:spaces={step(spaces, (.02, .04, .08, .15))}", f"H:comments={step(comments / max(1, filled), (0, .02, .1, .3))}",
        f"H:few={step(filled, (2, 5, 20))}", f"H:dense={dense}|{step(spaces, (.02, .05, .1))}|{step(punctuation, (.1, .2, .3))}", f"H:bulk={max(runs, rows) > .5}",
    ]


@lru_cache(maxsize=300_000)
def _slot(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)


def gram_slots(raw: bytes) -> np.ndarray:
    """Slots of the character 3-grams and 5-grams of masked text."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 5:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        three = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1]) * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA6B)
        five = (three[:-2] * np.uint32(0xC2B2AE35) ^ three[2:]) * np.uint32(0x27D4EB2F)
        out = np.concatenate([three * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), five >> np.uint32(32 - BITS)])
    return out.astype(np.int64)


class Masked:
    """A file read once: its features by view, and what else the passes need."""

    def __init__(self, path: str, raw: bytes):
        self.path = path
        text = text_of(raw)
        self.notes, self.holders, spans = notices(text)
        if spans:
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            self.body = "".join([*kept, text[at:]]).encode("utf-8", "surrogatepass")
        else:
            self.body = raw
        self.raw = raw

    def sketch(self) -> list[int]:
        """The least hashes of its lines, without notices; fewer than three tell nothing."""
        import xxhash

        lines = [x for x in (line.strip() for line in self.body.split(b"\n")) if x]
        units = {x for x in lines if LONG_LINE <= len(x) < WIDE_LINE}
        for line in lines:
            if len(line) >= WIDE_LINE:
                units.update(x for x in STATEMENT.split(line) if len(x) >= LONG_LINE)
        if len(units) < 3:
            units |= {x for k in range(len(lines) - SHORT_RUN + 1) if len(x := b"\n".join(lines[k:k + SHORT_RUN])) >= LONG_LINE}
        low = sorted(map(xxhash.xxh64_intdigest, units))[:SKETCH]
        return [h - (1 << 63) for h in low] if len(units) >= 3 else []

    def view(self, notes: bool = True, path: bool = True) -> list[str]:
        """Named features that the file itself tells."""
        out = list(shape_features(self.body)) if self.body.strip() else ["H:empty"]
        if path:
            out += path_features(self.path)
        if notes:
            out += [f"W:{kind}" for kind, _ in set(self.notes)] + [f"W:{kind}@{place}" for kind, place in set(self.notes)]
        return out

    def foreign(self) -> bool:
        """Whether a notice or the path says that the file comes from elsewhere."""
        return any(k == "foreign" for k, _ in self.notes) or "V:vendor" in path_features(self.path)

    def label(self, other_holder: bool) -> str | None:
        """The kind its giveaways say, ``hand`` without any; ``other_holder``: it names a holder that is not its repository's own."""
        names = path_features(self.path)
        kinds = {k for k, _ in self.notes}
        shape = set(shape_features(self.body)) if self.body.strip() else set()
        dense = next((h.split("|")[1:] for h in shape if h.startswith("H:dense=True")), None)  # steps of spaces and of punctuation
        if "map" in kinds or "M:min" in names or dense and (dense[0] == "0" or dense[0] <= "2" and dense[1] >= "2") and "H:bulk=False" in shape:
            return "minified"
        if "generated" in kinds or "V:generated" in names or "V:name" in names:
            return "generated"
        if "hand" in kinds:
            return "hand"
        if other_holder or self.foreign():
            return "vendored"
        if "H:bulk=True" in shape:
            return "data"
        return "hand"


def gram_values(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams, and the roots of their relative frequencies."""
    slots, counts = np.unique(gram_slots(body), return_counts=True)
    return slots.astype(np.int32), (np.sqrt(counts / max(1, counts.sum())) * GRAM_SCALE).astype(np.float32)


def named_slots(names: list[str]) -> np.ndarray:
    """Slots of named features, whose values are 1."""
    return np.array([_slot(n) for n in names], np.int32)


class Machines:
    """One linear support-vector machine per kind (averaged stochastic subgradient, Pegasos steps)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.by_slot = np.ascontiguousarray(weights.T)  # one slot's weights lie together

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], str, float]], passes: int = 8, ridge: float = 2e-5, seed: int = 5) -> Machines:
        r = np.random.default_rng(seed)
        weights = np.zeros((len(KINDS), 1 << BITS), np.float32)
        for k, kind in enumerate(KINDS):
            y = np.array([1.0 if label == kind else -1.0 for _, _, label, _ in rows])
            if not (y > 0).any():
                continue
            boost = min(8.0, (y < 0).sum() / max(1, (y > 0).sum())) ** 0.5
            w, scale, step = np.zeros(1 << BITS), 1.0, 0
            for _ in range(passes):
                for i in r.permutation(len(rows)):
                    step += 1
                    eta = 0.05 / (1 + 0.05 * ridge * step)
                    named, (grams, shares), _, weight = rows[i]
                    slots = np.concatenate([named, grams])
                    values = np.concatenate([np.ones(len(named), np.float32), shares])
                    margin = y[i] * scale * (w[slots] @ values)
                    scale *= 1 - eta * ridge
                    if margin < 1:
                        np.add.at(w, slots, weight * (boost if y[i] > 0 else 1.0) * eta * y[i] * values / scale)
            weights[k] = w * scale
        return cls(weights)

    def scores(self, named: np.ndarray, grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.by_slot[named].sum(0) + grams[1] @ self.by_slot[grams[0]]


READ = "repo_id string, path string, holders array<string>, is_foreign boolean, sketch array<bigint>, n_bytes bigint"


def _read_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, raw in zip(batch["repo_id"], batch["path"], batch["bytes"]):
            m = Masked(path, raw)
            rows.append((repo, path, sorted(set(m.holders)), m.foreign(), m.sketch(), len(raw)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])


def texts(content: DataFrame) -> DataFrame:
    """Content rows that hold text."""
    return content.where("not coalesce(is_binary, false) and path is not null and bytes is not null").select("file_id", "repo_id", "path", "bytes")


def copied_shares(read: DataFrame) -> DataFrame:
    """(repo_id, path, shared): the share of a file's sketch that other repositories hold too, in tenths.

    A line that very many files hold (a licence, say) would meet all of them in one
    task; such lines are few, and are looked up by broadcast instead.
    """
    lines = read.select("repo_id", "path", F.explode("sketch").alias("h"))
    known = cut(lines.groupBy("h").agg((F.min("repo_id") < F.max("repo_id")).alias("elsewhere"), F.count("*").alias("n")))
    hot = known.where(F.col("n") > HOT_FILES).select("h", "elsewhere")
    looked = lines.join(small(hot), "h", "left")
    rest = looked.where("elsewhere is null").drop("elsewhere").join(known.where(F.col("n") <= HOT_FILES).select("h", "elsewhere"), "h")
    joined = looked.where("elsewhere is not null").unionByName(rest)
    return joined.groupBy("repo_id", "path").agg(F.floor(F.avg(F.col("elsewhere").cast("int")) * 10).cast("int").alias("shared"))


def own_holders(read: DataFrame) -> DataFrame:
    """(repo_id, own): the copyright holder that most of a repository's files name, of those without other signs of foreign origin.

    A holder of a single such file counts only if no other is named more often in the whole corpus.
    """
    each = read.where("not is_foreign").select("repo_id", F.explode("holders").alias("holder")).groupBy("repo_id", "holder").agg(F.count("*").alias("n"))
    each = cut(each)
    corpus = each.groupBy("holder").agg(F.sum("n").alias("in_all"))
    most = corpus.agg(F.max(F.struct("in_all", "holder")).alias("m")).select(F.col("m.holder").alias("commonest"))
    top = most.first()
    ranked = each.join(small(corpus), "holder").where((F.col("n") > 1) | (F.col("holder") == F.lit(top.commonest if top else None)))
    return ranked.groupBy("repo_id").agg(F.max_by("holder", F.struct("n", "in_all", "holder")).alias("own"))


def surroundings(read: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(repo_id, path, shared, own_holder, other_holder, language) of each file: what only other rows tell about it."""
    owners = own_holders(read)
    files = read.groupBy("repo_id", "path").agg(F.array_distinct(F.flatten(F.collect_list("holders"))).alias("holders"))
    j = files.join(small(cut(owners)), "repo_id", "left")
    own = F.exists("holders", lambda h: h == F.col("own"))
    other = F.exists("holders", lambda h: F.coalesce(h != F.col("own"), F.lit(True)))
    j = j.select("repo_id", "path", F.coalesce(own, F.lit(False)).alias("own_holder"), F.coalesce(other, F.lit(False)).alias("other_holder"))
    j = j.join(copied_shares(read), ["repo_id", "path"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    if manifest is None or "language" not in manifest.columns:
        return j.withColumn("language", F.lit("none"))
    word = F.lower(F.trim("language"))
    named = manifest.where("presence = 'present'").select("repo_id", "path", F.when((word == "") | (word == "unknown"), F.lit(None)).otherwise(word).alias("language"))
    named = named.where("language is not null and path is not null").groupBy("repo_id", "path").agg(F.min("language").alias("language"))
    return j.join(named, ["repo_id", "path"], "left").withColumn("language", F.coalesce("language", F.lit("none")))


def around(shared: int, own_holder: bool, other_holder: bool, language: str, notes: bool = True) -> list[str]:
    """Named features of a file's surroundings."""
    out = [f"C:shared={shared}", f"L:{language}"]
    return out + ["W:holder=own"] * (own_holder and notes) + ["W:holder=other"] * (other_holder and notes)


def classified(content: DataFrame, manifest: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, Machines, dict]:
    """(repo_id, path, kind, score) of every text file with its best kind, the machines, and how they did in validation."""
    source = texts(content)
    read = cut(source.mapInPandas(_read_pass, READ))
    near = cut(surroundings(read, manifest))
    sample = _sample(source, read, near, train_rows)
    rows, held = [], []
    for repo, path, raw, label, shared, own, other, language in sample:
        m = Masked(path, bytes(raw))
        views = [m.view(), m.view(notes=False), m.view(path=False), m.view(notes=False, path=False)]
        in_text = label in ("hand", "minified", "data") or shared >= 5
        by_path = any(v.startswith("V:") for v in views[1])
        tells = (True, in_text or by_path, in_text or bool(m.notes or m.holders), in_text)
        grams = gram_values(m.body)  # held once for all views
        ready = [(named_slots([*v, *around(shared, own, other, language, k in (0, 2))]), grams, label, 1.0 if told else MASKED_WEIGHT) for k, (v, told) in enumerate(zip(views, tells))]
        if _slot(f"repo:{repo}") % 5 == 0:
            held.append((ready, label))
        else:
            rows += ready
    machines = Machines.fit(rows)
    report = _validate(machines, held)
    sent = content.sparkSession.sparkContext.broadcast(machines.weights.astype(np.float32))
    schema = "repo_id string, path string, s0 float, s1 float, s2 float, s3 float"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = Machines(sent.value)
        for batch in batches:
            out = np.zeros((len(batch), len(KINDS)), np.float32)
            for i, (path, raw) in enumerate(zip(batch["path"], batch["bytes"])):
                m = Masked(path, raw)
                out[i] = fitted.scores(named_slots(m.view()), gram_values(m.body))
            yield pd.DataFrame({"repo_id": batch["repo_id"], "path": batch["path"], **{f"s{k}": out[:, k] for k in range(len(KINDS))}})

    scored = source.mapInPandas(score, schema)
    plus = scored.join(near, ["repo_id", "path"])
    languages = sorted({language for *_, language in sample})  # of the bounded sample; others weigh nothing
    final = []
    for k in range(len(KINDS)):
        weight = lambda name, k=k: F.lit(float(machines.weights[k, _slot(name)]))
        by_share = F.element_at(F.array(*[weight(f"C:shared={s}") for s in range(11)]), F.col("shared") + 1)
        by_language = F.coalesce(F.try_element_at(F.create_map(*[x for n in languages for x in (F.lit(n), weight(f"L:{n}"))]), F.col("language")), F.lit(0.0)) if languages else F.lit(0.0)
        by_holder = F.when(F.col("own_holder"), weight("W:holder=own")).otherwise(0.0) + F.when(F.col("other_holder"), weight("W:holder=other")).otherwise(0.0)
        final.append(F.col(f"s{k}") + by_share + by_language + by_holder)
    best = F.greatest(*final)
    kind = F.coalesce(*[F.when(final[k] == best, F.lit(name)) for k, name in enumerate(KINDS)])
    return plus.select("repo_id", "path", kind.alias("kind"), best.alias("score")), machines, report


def _sample(source: DataFrame, read: DataFrame, near: DataFrame, most: int) -> list[tuple]:
    """Labelled files to fit on: at most ``most``, half of them hand-written, chosen by a hash of their place.

    About four times as many files are drawn, labelled and kept, whatever the size of the corpus.
    """
    total = read.where(F.col("n_bytes") <= TRAIN_BYTES).count()
    keep = min(1.0, 4.0 * most / max(1, total))
    pick = F.pmod(F.xxhash64(F.lit("fit"), "repo_id", "path"), F.lit(10**15))
    schema = "repo_id string, path string, bytes binary, if_own string, if_other string, pick bigint"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [(m.label(False), m.label(True)) for m in map(Masked, batch["path"], batch["bytes"])]
            yield pd.DataFrame({"repo_id": batch["repo_id"], "path": batch["path"], "bytes": batch["bytes"], "if_own": [x for x, _ in both], "if_other": [x for _, x in both], "pick": batch["pick"]})

    drawn = source.withColumn("pick", pick).where((F.col("pick") < F.lit(int(keep * 10**15) + 1)) & (F.octet_length("bytes") <= TRAIN_BYTES))
    labelled = cut(drawn.select("repo_id", "path", "bytes", "pick").mapInPandas(label, schema))
    keys = labelled.select("repo_id", "path").distinct()
    theirs = near.join(small(keys), ["repo_id", "path"], "left_semi")
    labelled = labelled.join(small(theirs), ["repo_id", "path"]).withColumn("label", F.when(F.col("other_holder"), F.col("if_other")).otherwise(F.col("if_own")))
    labelled = labelled.where("not (label = 'hand' and shared >= 5)")  # a copy without giveaways has no known label
    hand = labelled.where("label = 'hand'").orderBy("pick").limit(most // 2)
    rest = labelled.where("label <> 'hand'").orderBy("pick").limit(most - most // 2)
    rows = hand.unionByName(rest).select("repo_id", "path", "bytes", "label", "shared", "own_holder", "other_holder", "language").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] or "", r[1]))


def _validate(machines: Machines, held: list) -> dict:
    """Precision and recall on the repositories kept apart, with giveaway notices masked and with all of a file."""
    out = {}
    for name, at in (("whole", 0), ("notices_masked", 1)):
        hit = wrong = missed = 0
        for ready, label in held:
            said = machines.scores(*ready[at][:2]).max() > BAR
            hit += said and label != "hand"
            wrong += said and label == "hand"
            missed += (not said) and label != "hand"
        out[name] = {"precision": hit / max(1, hit + wrong), "recall": hit / max(1, hit + missed), "files": len(held)}
    return out


def foreign_entries(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """(entry_id) of every present listing of a generated, minified, vendored or data file."""
    scored, _, _ = classified(content, manifest)
    files = scored.where(F.col("score") > BAR).select("repo_id", "path").distinct()
    present = manifest.where("presence = 'present'").select("entry_id", "repo_id", "path")
    return present.join(files, ["repo_id", "path"]).select("entry_id").distinct()


def entry_kinds(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """(entry_id, kind) of the same listings."""
    scored, _, _ = classified(content, manifest)
    files = scored.where(F.col("score") > BAR).groupBy("repo_id", "path").agg(F.max_by("kind", "score").alias("kind"))
    present = manifest.where("presence = 'present'").select("entry_id", "repo_id", "path")
    return present.join(files, ["repo_id", "path"]).select("entry_id", "kind").distinct()
