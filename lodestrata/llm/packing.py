"""Putting whole texts into containers under several limits at once, by vector bin packing.

A text is sized by a public tokenizer in three ways: tokens, one segment, and
tokens that bear loss: all but those of quoted lines, fenced blocks and lines
indented like code or logs, which a model only reads. A container holds at most
a given number of each. The dot-product heuristic fills one container after the
other: of the items that still fit, the one whose sizes agree most with the room
left (weighted by how scarce each room is) goes in. Only a text over the token
capacity is cut, at token boundaries, into pieces that are as long as the token
and the loss limit allow; the loss of each piece is counted, not shared out.

Items are dealt by hash into groups of about ``group_tokens`` tokens, each packed
on its own; no group depends on a key of the data, so none is hot. What lies in
poorly filled containers of all groups is then packed once more in far fewer
groups, so that the room left unused does not grow with their number.

Defined results: null texts and texts without tokens need no place and give no
row; exact copies are packed each; a rest is an item like any other; a text
within the token capacity whose loss-bearing tokens alone pass their limit stays
whole in a container of its own; ties go to the item with the least
(doc_id, piece_no); container ids are unique but not consecutive.

The rank file is read by the driver and broadcast (under a megabyte), so that
executors need no path of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that file splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2_048
SEGMENTS = 32
LOSS_TOKENS = 2_040
GROUP_TOKENS = 4_000_000
POOR = 0.97  # containers filled less are packed once more
SIZES = "doc_id bigint, piece_no int, start_token int, n_tokens int, n_loss int"
PLACES = "container_id bigint, doc_id bigint, piece_no int, start_token int, n_tokens int, n_loss int, position int, fill double"
#: What bears no loss: fenced blocks, quoted lines, and lines indented like code or logs.
UNLEARNT = re.compile(r"(?ms)^[ ]{0,3}```.*?(?:^[ ]{0,3}```[^\n]*(?:\n|\Z)|\Z)|^[ \t]*>[^\n]*\n?|^(?:    |\t)[^\n]*\n?")


@lru_cache(maxsize=2)
def of_ranks(raw: bytes):
    """(tokenizer, bytes of each token) of the content of a rank file, built once per process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokenizer(path: str):
    """The tokenizer of a rank file."""
    return of_ranks(read_ranks(path))[0]


def token_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the tokenizer has them."""
    return [len(x) for x in tokenizer(path).encode_ordinary_batch(texts, num_threads=1)]


def bears_loss(text: str, tokens: list[int], lengths: np.ndarray) -> np.ndarray:
    """Whether each token bears loss: those that begin in a part that is only read do not."""
    loss = np.ones(len(tokens), bool)
    spans = [m.span() for m in UNLEARNT.finditer(text)] if ">" in text or "```" in text or "    " in text or "\t" in text else []
    if spans:
        starts = np.concatenate([[0], np.cumsum(lengths[tokens])[:-1]])
        at, place = 0, 0  # bytes are counted from span to span, so that the text is encoded once
        for s, e in spans:
            first = place + len(text[at:s].encode("utf-8", "replace"))
            at, place = e, first + len(text[s:e].encode("utf-8", "replace"))
            loss[np.searchsorted(starts, first):np.searchsorted(starts, place)] = False
    return loss


def cut_text(loss: np.ndarray, capacity: int, loss_tokens: int) -> list[tuple[int, int, int]]:
    """(start, tokens, loss-bearing tokens) of each piece; one piece if the text is within the capacity."""
    n = len(loss)
    upto = np.concatenate([[0], np.cumsum(loss)])
    if n <= capacity:
        return [(0, n, int(upto[n]))] if n else []
    out, at = [], 0
    while at < n:
        end = min(n, at + capacity, max(at + 1, int(np.searchsorted(upto, upto[at] + loss_tokens, "right")) - 1))
        out.append((at, end - at, int(upto[end] - upto[at])))
        at = end
    return out


def sized(docs: DataFrame, capacity: int, loss_tokens: int, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per item: a text, or a piece of one over the capacity."""
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = of_ranks(held.value)
        for batch in batches:
            texts = batch["text"].tolist()
            rows = []
            for d, t, tokens in zip(batch["doc_id"], texts, encoding.encode_ordinary_batch(texts, num_threads=1)):
                pieces = cut_text(bears_loss(t, tokens, lengths), capacity, loss_tokens)
                rows += [(d, k, *piece) for k, piece in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIZES.split(", ")])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return read.mapInPandas(run, SIZES)


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item (rows of ``sizes``, one column per limit), by the dot-product heuristic.

    A container aims at its part of what is still to be placed: as much of each
    limit as all remaining items need of it, relative to the scarcest. The item
    whose sizes agree most with the rest of that aim goes in next. Where segments
    lag behind tokens, sizes count by direction, so that short texts get in while
    long ones are there to go with them. Items of equal sizes are interchangeable,
    so the search runs over distinct sizes with their counts. An item that no
    container can hold within all limits gets one of its own.
    """
    kinds, back, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    share = kinds / limits
    length = np.linalg.norm(share, axis=1)
    order = np.argsort(back.ravel(), kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    taken = np.zeros(len(kinds), np.int64)
    out = np.full(len(sizes), -1, np.int64)
    alone = np.flatnonzero((sizes > limits).any(1))
    out[alone] = np.arange(len(alone))
    bin_no = len(alone)
    live = np.flatnonzero((kinds <= limits).all(1))
    while len(live):
        needed = (share[live] * (counts[live] - taken[live])[:, None]).sum(0)
        part = needed / needed.max()
        room, can = limits.astype(np.float64), live
        while True:
            can = can[(kinds[can] <= room).all(1)]
            if not len(can):
                break
            aim = np.maximum(part - 1 + room / limits, 0.0)
            still = aim / np.maximum(part, 1e-9)
            score = (share[can] * (aim + 1e-6)).sum(1) / length[can] ** max(0.0, still[1] - still[0])
            k = can[np.argmax(score)]
            out[order[first[k] + taken[k]]] = bin_no
            taken[k] += 1
            room = room - kinds[k]
            if taken[k] == counts[k]:
                can = can[can != k]
        live = live[taken[live] < counts[live]]
        bin_no += 1
    return out


def _pack_groups(limits: tuple[int, int, int], stage: int):
    bound = np.array(limits, np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable", ignore_index=True)
        sizes = np.stack([pdf["n_tokens"], np.ones(len(pdf), np.int64), pdf["n_loss"]], 1).astype(np.int64)
        where = pack(sizes, bound)
        filled = np.bincount(where, weights=pdf["n_tokens"])
        group = int(pdf["group"].iloc[0])
        pdf["container_id"] = where + (group << 24) + (stage << 60)
        pdf["position"] = pdf.groupby("container_id").cumcount().astype("int32")
        pdf["fill"] = filled[where] / limits[0]
        return pdf[[c.split()[0] for c in PLACES.split(", ")]]

    return run


def packed(
    docs: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_tokens: int = LOSS_TOKENS, path: str = TOKENIZER, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """The place of every item: container, order in it, and how full the container is."""
    if capacity < 1 or segments < 1 or loss_tokens < 1:
        raise ValueError("limits are at least 1")
    items = cut(sized(docs, capacity, loss_tokens, path))
    limits = (capacity, segments, loss_tokens)
    n = items.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-n // group_tokens))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).cast("int"))
    first = cut(dealt.groupBy("group").applyInPandas(_pack_groups(limits, 0), PLACES))
    if groups == 1:
        return first
    poor = first.where(F.col("fill") < POOR)
    rest = max(1, -(-(poor.agg(F.sum("n_tokens")).first()[0] or 0) // group_tokens))
    again = poor.withColumn("group", F.pmod(F.xxhash64("piece_no", "doc_id"), F.lit(rest)).cast("int")).drop("container_id", "position", "fill")
    return first.where(F.col("fill") >= POOR).unionByName(again.groupBy("group").applyInPandas(_pack_groups(limits, 1), PLACES))


def containers(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_segments, n_tokens, n_loss, unused) of each container."""
    return places.groupBy("container_id").agg(
        F.count("*").alias("n_segments"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_loss").alias("n_loss"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused")
    )


def audit(docs: DataFrame, places: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_tokens: int = LOSS_TOKENS) -> DataFrame:
    """One row that tells whether the places keep what packing promises.

    docs: texts placed; missing: texts to be placed that were not; over: containers
    beyond a limit that hold more than one item, or one beyond the capacity;
    needless: pieces of texts that were within the capacity; broken: texts whose
    pieces do not follow each other without gap.
    """
    per = containers(places, capacity)
    over = per.agg(F.count_if((F.col("n_tokens") > capacity) | (F.col("n_segments") > segments) | (F.col("n_loss") > loss_tokens) & (F.col("n_segments") > 1)).alias("over"))
    of_text = places.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("piece_no").alias("last"), F.sort_array(F.collect_list(F.struct("piece_no", "start_token", "n_tokens"))).alias("pieces"))
    follows = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda at, p: F.when(at == p["start_token"], at + p["n_tokens"]).otherwise(F.lit(-1).cast("bigint"))) == F.col("n")
    pieces = of_text.agg(
        F.count("*").alias("docs"), F.count_if((F.col("k") > 1) & (F.col("n") <= capacity)).alias("needless"), F.count_if(~follows | (F.col("last") + 1 != F.col("k"))).alias("broken")
    )
    wanted = docs.where("text is not null and text <> ''").select("doc_id").join(places.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    names = ("docs", "missing", "over", "needless", "broken")
    parts = [df.select(*[F.col(c) if c in df.columns else F.lit(0).cast("bigint").alias(c) for c in names]) for df in (pieces, over, wanted)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(c).alias(c) for c in names])
