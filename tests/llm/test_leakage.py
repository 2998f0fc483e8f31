"""Leakage search against plain dynamic programming."""

from __future__ import annotations

import random

from strandline.llm.leakage import ItemIndex, leaked_items, masks, piece_length, within, words_of


def distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, c in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (p != c), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def brute(item, text, low=20, rate=0.1):
    a, b = words_of(item), words_of(text)
    return any(distance(a[i : i + n], b) <= int(n * rate + 1e-9) for n in range(low, len(a) + 1) for i in range(len(a) - n + 1))


def test_bit_parallel_distance():
    rnd = random.Random(0)
    for _ in range(300):
        p = [rnd.randrange(4) for _ in range(rnd.randrange(1, 90))]
        t = [rnd.randrange(4) for _ in range(rnd.randrange(0, 60))]
        d = distance(p, t)
        assert within(masks(p), len(p), t, d) and not (d and within(masks(p), len(p), t, d - 1))


def test_piece_length():
    assert piece_length(20, 0.1) == 6


def test_mutated_passages(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(n))) for k, n in enumerate([15, 20, 34, 45])]
    docs = []
    for d in range(60):
        k, text = rnd.choice(items)
        w = words_of(text)
        a = rnd.randrange(0, max(1, len(w) - 20))
        part = w[a : a + rnd.randrange(12, 45)]
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(len(part))
            part = [part[:at] + part[at + 1 :], part[:at] + ["zz"] + part[at:], part[:at] + ["yy"] + part[at + 1 :]][rnd.randrange(3)] or ["x"]
        noise = [rnd.choice(vocab) for _ in range(8)]
        docs.append((d, "> " + "\n> ".join(x.upper() + "," for x in noise + part + noise), "clash"))
    want = {(d, k) for d, t, _ in docs for k, x in items if brute(x, t)}
    assert want
    docs += [docs[0], (100, None, ""), (101, "", ""), (None, items[3][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (9, None), (10, ""), items[0]], "item_id long, text string")
    for kw in ({}, {"batch_words": 40}):
        got = [(r.doc_id, r.item_id) for r in leaked_items(df, it, **kw).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    long = " ".join(rnd.choice(vocab) for _ in range(200_000)) + " " + items[3][1]
    assert 3 in ItemIndex(items, 20, 0.1).found(long)
    assert leaked_items(df.limit(0), it).collect() == [] and leaked_items(df, it.limit(0)).collect() == []
