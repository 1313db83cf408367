"""Cutting oversized diffs into pieces at natural boundaries, by lexical cohesion.

A block of lines slides over the text; the cosine between the words before and
after each gap falls into valleys where the topic changes. Within each size
window the deepest valley is taken: among hunk starts if the window holds one,
else between lines. Each further piece begins with the last lines of the one
before. Work is per row, time linear in the text; texts are not shuffled, but for
those whose id comes more than once.

Defined results: a text of at most ``limit`` bytes is one piece; a null or empty
text gives none; a single line longer than the limit is cut between code points;
where the overlap lines alone would not leave room for a new line within the
limit, the overlap loses its earliest lines. Ties between valleys go to the later
gap. Lines end with LF; a CR before it belongs to the line.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, small

LIMIT = 12_000
OVERLAP = 3
BLOCK = 8  # lines on each side of a gap
YIELD = 8 << 20  # bytes of pieces handed on at once
FILL = 0.5  # a size window reaches from this share of the limit up to the limit
HEADER = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
WORD = re.compile(r"[^\W\d_]{2,}")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PIECES = (
    "split_id bigint, text_md5 string, piece_no int, hunk_no int, hunk_header string, start_line int, piece_bytes int, overlap_lines int, overlap_bytes int, "
    "piece string, hunks array<struct<hunk_no:int,hunk_header:string,start_line:int>>"
)


def lines_of(text: str, limit: int) -> list[str]:
    """Lines with their ends; longer ones cut between code points so that each fits ``limit`` bytes."""
    out = []
    for line in text.split("\n"):
        line += "\n"
        if len(line) * 4 > limit and len(raw := line.encode("utf-8", "surrogatepass")) > limit:
            at = 0
            while len(raw) - at > limit:
                end = at + limit
                while end > at + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
                out.append(raw[at:end].decode("utf-8", "surrogatepass"))
                at = end
            line = raw[at:].decode("utf-8", "surrogatepass")
        out.append(line)
    out[-1] = out[-1][:-1]
    return out if out[-1] else out[:-1]


def cohesion(lines: list[str], block: int = BLOCK) -> list[float]:
    """For gap i (before line i): the cosine of the words in the ``block`` lines before and after."""
    words = [Counter(w.lower() for w in WORD.findall(CAMEL.sub(" ", line))) for line in lines]
    left: Counter = Counter()
    right: Counter = Counter()
    dot = sq_left = sq_right = 0

    def move(line: Counter, sign: int, to_left: bool) -> None:
        nonlocal dot, sq_left, sq_right
        own, other = (left, right) if to_left else (right, left)
        for w, n in line.items():
            had = own[w]
            own[w] = had + sign * n
            dot += sign * n * other[w]
            change = sign * n * (2 * had + sign * n)
            if to_left:
                sq_left += change
            else:
                sq_right += change

    for line in words[:block]:
        move(line, 1, False)
    out = [0.0]
    for i in range(1, len(lines)):
        move(words[i - 1], -1, False)
        move(words[i - 1], 1, True)
        if i > block:
            move(words[i - 1 - block], -1, True)
        if i - 1 + block < len(lines):
            move(words[i - 1 + block], 1, False)
        out.append(dot / (sq_left * sq_right) ** 0.5 if sq_left and sq_right else 0.0)
    return out


def depths(similarity: list[float]) -> list[float]:
    """How far each gap lies below the nearest peaks on both sides."""
    before = _from_peak(similarity)
    after = _from_peak(similarity[::-1])[::-1]
    return [a + b for a, b in zip(before, after)]


def _from_peak(values: list[float]) -> list[float]:
    """Distance below the top of the slope that leads down to each value."""
    out, peak = [], 0.0
    for i, v in enumerate(values):
        if i == 0 or v >= values[i - 1]:
            peak = v
        out.append(peak - v)
    return out


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """The pieces of one diff text."""
    if not text:
        return []
    lines = lines_of(text, limit)
    size = [len(line.encode("utf-8", "surrogatepass")) for line in lines]
    total = [0]
    for n in size:
        total.append(total[-1] + n)
    hunk_at: list[int] = []  # the hunk's number at each line, 0 before the first
    starts: dict[int, tuple[int, str, int]] = {}
    new_line: list[int] = []  # the new side's line number at each line
    number, at_new = 0, 0
    for i, line in enumerate(lines):
        whole = i == 0 or lines[i - 1].endswith("\n")
        if whole and (m := HEADER.match(line)):
            number += 1
            at_new = int(m[1])
            starts[i] = (number, line.rstrip("\r\n"), at_new)
            new_line.append(at_new)
        else:
            new_line.append(at_new)
            if number and whole and line[:1] not in ("-", "\\"):
                at_new += 1
        hunk_at.append(number)
    headers = {n: h for n, h, _ in starts.values()}
    valley = depths(cohesion(lines)) if total[-1] > limit else [0.0] * len(lines)

    out, begin, shared = [], 0, 0  # the piece's first own line, and the lines before it that it repeats
    while begin < len(lines):
        first = begin - shared
        end = begin + 1
        while end < len(lines) and total[end + 1] - total[first] <= limit:
            end += 1
        if end < len(lines):
            low = begin + 1
            while low < end and total[low] - total[first] < limit * FILL:
                low += 1
            in_window = [i for i in range(low, end + 1) if i in starts]
            earlier = [i for i in range(begin + 1, low) if i in starts]
            if in_window:
                end = max(in_window, key=lambda i: (valley[i], i))
            elif earlier:
                end = earlier[-1]
            else:
                end = max(range(low, end + 1), key=lambda i: (valley[i], i))
        piece = "".join(lines[first:end])
        lead = begin if hunk_at[begin] else next((i for i in range(begin, end) if i in starts), begin)
        out.append({
            "piece_no": len(out) + 1, "hunk_no": hunk_at[lead], "hunk_header": headers.get(hunk_at[lead]),
            "start_line": new_line[first] if hunk_at[first] else new_line[lead] if hunk_at[lead] else None,
            "piece_bytes": total[end] - total[first], "overlap_lines": shared, "overlap_bytes": total[begin] - total[first], "piece": piece,
            "hunks": [{"hunk_no": n, "hunk_header": h, "start_line": s} for i in range(begin, end) if i in starts for n, h, s in [starts[i]]],
        })
        if end < len(lines):
            shared = min(overlap, end)
            while shared and total[end + 1] - total[end - shared] > limit:
                shared -= 1
        begin = end
    return out


def split_pieces(
    df: DataFrame, id_col: str = "split_id", text_col: str = "diff_text", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """The pieces of every row over ``limit`` bytes; repeated rows count once."""
    over = df.select(F.col(id_col).cast("bigint").alias("split_id"), F.col(text_col).alias("diff_text")).where(
        F.octet_length("diff_text") > limit
    )
    ids = over.groupBy("split_id").agg(F.count("*").alias("n")).where("n > 1 and split_id is not null").select("split_id")
    again = cut(ids)
    several = over.join(small(again), "split_id", "left_semi").unionByName(over.where("split_id is null")).dropDuplicates(["split_id", "diff_text"])
    once = over.where("split_id is not null").join(small(again), "split_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.sub(r"<.*>", "", PIECES).split(", ")]
        kinds = {"hunk_no": "Int32", "start_line": "Int32", "split_id": "Int64"}
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch["split_id"], batch["diff_text"]):
                digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                pieces = pieces_of(text, limit, overlap)
                rows += [{"split_id": key, "text_md5": digest, **p} for p in pieces]
                held += sum(p["piece_bytes"] for p in pieces)
                if held > YIELD:
                    yield pd.DataFrame(rows, columns=names).astype(kinds)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype(kinds)

    return once.unionByName(several).mapInPandas(run, PIECES)


def oversized_hunks(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(split_id, hunk_no, start_line): every hunk of every row over the limit, as its pieces list them."""
    one = split_pieces(df, limit=limit).select("split_id", F.explode("hunks").alias("h"))
    return one.select("split_id", F.col("h.hunk_no").alias("hunk_no"), F.col("h.start_line").alias("start_line")).distinct()


def rebuilt(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(split_id, n_bytes, text_md5, within) of each split text, put together again from its pieces without what they repeat.

    ``within``: no piece is over the limit. The pieces of one text meet in one row.
    """
    own = F.expr("substring(encode(piece, 'UTF-8'), overlap_bytes + 1)")
    parts = pieces.groupBy("split_id", "text_md5").agg(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"), F.max("piece_bytes").alias("longest"))
    whole = F.concat_ws("", F.transform("parts", lambda x: F.hex(x["own"])))
    return parts.select("split_id", (F.length(whole) / 2).cast("bigint").alias("n_bytes"), F.md5(F.unhex(whole)).alias("text_md5"), (F.col("longest") <= limit).alias("within"))
