"""Mixing: shares, repeat caps, running totals against brute force."""

from __future__ import annotations

import random
from collections import Counter

from strandline.llm.mixing import counted_documents, mix, mix_report


def test_shares_and_caps(spark):
    rnd = random.Random(3)
    docs = [(i, s, rnd.randrange(5, 60)) for i, s in enumerate(rnd.choices(["big", "mid", "small", "none"], [60, 25, 5, 10], k=4000))]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = [("Big ", 0.5, 1), ("mid", 0.3, 1), ("small", 0.15, 3), ("gone", 0.05, 1)]
    t = spark.createDataFrame([(*x, "clash") for x in targets], "source string, target_share double, max_repeats int, tokens string").drop("tokens")
    rows = mix(d, t, block_tokens=256).collect()
    seen = Counter((r.doc_id, r.repeat_no) for r in rows)
    assert max(seen.values()) == 1
    cap = {"big": 1, "mid": 1, "small": 3}
    assert all(r.repeat_no <= cap[r.source] for r in rows) and {r.source for r in rows} == set(cap)
    total = sum(r.n_tokens for r in rows)
    for s, w, _ in targets[:3]:
        s = s.strip().lower()
        assert abs(sum(r.n_tokens for r in rows if r.source == s) / total - w / 0.95) < 0.02
    # the size is as large as the scarcest source allows
    have = {s: sum(n for _, x, n in docs if x == s) for s in cap}
    want = min(have[s] * cap[s] / (w / 0.95) for s, w in zip(cap, (0.5, 0.3, 0.15)))
    assert 0.95 * want < total <= want * 1.01
    # any stretch of the schedule is close to its share
    early = [r for r in rows if r.slot < max(x.slot for x in rows) // 4]
    assert abs(sum(r.n_tokens for r in early if r.source == "big") / sum(r.n_tokens for r in early) - 0.5 / 0.95) < 0.06
    rep = {r.source: r for r in mix_report(d, t, block_tokens=256).collect()}
    assert rep["gone"].mix_tokens == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-4
    assert mix(d.limit(0), t).collect() == [] and mix(d, t.limit(0)).collect() == []


def test_counted(spark):
    rows = [(1, " Commit-Message", "hello world, hello"), (1, " Commit-Message", "hello world, hello"), (2, None, "x"), (None, "a", "x"), (3, "a", None), (4, "a", ""), (5, "a", "word " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, n_tokens string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in counted_documents(df).collect()}
    assert got[1] == ("commit_message", 4) and got[3][1] == got[4][1] == 0 and got[5][1] >= 50_000 and set(got) == {1, 3, 4, 5}
