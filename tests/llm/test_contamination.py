import os
import random

import pytest

from lodestrata.llm import contamination

FOLDER = "/root/testdata/sf0.01"


def reparameterised(passage, r):
    """The passage with every number and name always replaced by the same other one."""
    there = {}

    def other(token):
        form, _ = contamination.token_forms(token)
        if form not in ("<number>", "<name>"):
            return token
        if token not in there:
            kept = lambda c: str(r.randint(1, 9)) if c.isdigit() else r.choice("abcdefghij") if c.islower() else r.choice("ABCDEFGHIJ") if c.isupper() else c
            there[token] = "".join(map(kept, token))
        return there[token]

    return " ".join(other(t) for t in passage.split()), len(there)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_reparameterised_questions_are_found(spark):
    r = random.Random(2)
    items = spark.read.parquet(f"{FOLDER}/eval_item.parquet")
    noise = "we looked at this again yesterday and found nothing else worth telling here today".split()
    docs, want = [], set()
    for row in items.where("prompt is not null").select("item_id", "prompt").collect():
        passage = " ".join(contamination.passage_of(row.prompt).split())
        text, n = reparameterised(passage, r)
        if len(contamination.Words(passage).canonical) < contamination.LEAST or n < 2:
            continue
        docs.append((len(docs), " ".join(r.choices(noise, k=30)) + " " + text + " " + " ".join(r.choices(noise, k=30))))
        want.add((docs[-1][0], row.item_id))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = contamination.leaks(frame, items).collect()
    found = {(x.doc_id, x.item_id) for x in rows}
    assert len(want) > 40 and len(found & want) >= 0.9 * len(want)
    shaped = [x for x in rows if x.kind == "reparameterised"]
    assert len(shaped) > 0.1 * len(want) and all(x.n_words >= contamination.LEAST for x in shaped)


def test_slots_must_be_replaced_alike():
    words = "at the end of the run {a} of the {b} workers forgot {a} entries while {c} waited for {b} others and {a} more until the queue of {c} jobs was empty again"
    item = contamination.Items([(1, words.format(a=11, b=22, c=33))])
    one = item.matches(words.format(a=44, b=55, c=66))
    assert [m[1] for m in one] == ["reparameterised"]
    parts = words.format(a="{}", b="{}", c="{}").format(*range(41, 48))
    assert [m[1] for m in item.matches(parts)] == []


def test_blocks_of_items_find_the_same(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(300)]
    common = " ".join(r.choices(vocabulary, k=12))  # a window that every text and every item holds
    prompts = [(i, "Judge this.\n\n" + common + " " + " ".join(r.choices(vocabulary, k=40))) for i in range(60)]
    docs = []
    for i in range(200):
        body = " ".join(r.choices(vocabulary, k=30))
        held = " ".join(contamination.passage_of(prompts[i % 60][1]).split()[8:40]) if i % 3 == 0 else ""
        docs.append((i, f"{body} {common} {held} {body}"))
    docs += [(None, docs[0][1]), (900, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(prompts, "item_id bigint, prompt string")
    whole = sorted(map(tuple, contamination.leaks(d, q).collect()))
    blocks = sorted(map(tuple, contamination.leaks(d, q, broadcast_windows=1000).collect()))
    assert whole == blocks and {(x[0], x[1]) for x in whole} >= {(i, i % 60) for i in range(0, 200, 3)} | {(900, 0)} and None not in {x[0] for x in whole}
