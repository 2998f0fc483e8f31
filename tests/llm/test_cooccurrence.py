"""Blocked Gram matrix against brute force."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from strandline.llm.cooccurrence import change_baskets, pairs_together


def brute(sets, min_count, lift):
    out = set()
    for g in {s[0] for s in sets}:
        bs = [set(s[2]) for s in sets if s[0] == g and s[2]]
        t = len(bs)
        n, ab = {}, {}
        for b in bs:
            for i in b:
                n[i] = n.get(i, 0) + 1
            for p in combinations(sorted(b), 2):
                ab[p] = ab.get(p, 0) + 1
        out |= {(g, a, b, c) for (a, b), c in ab.items() if c >= min_count and c * t >= lift * n[a] * n[b]}
    return out


def test_random_blocks(spark):
    rnd = random.Random(1)
    sets = []
    for i in range(400):
        g = rnd.choice(["hot", "hot", "b", None])
        base = rnd.randrange(0, 40, 4)
        items = [f"i{(base + rnd.randrange(4)) % 40:02d}" for _ in range(rnd.choice([0, 1, 2, 3, 4]))]
        if i % 57 == 0:
            items = [f"i{k:02d}" for k in range(40)]
        sets.append((g, i, sorted(set(items)) or None))
    df = spark.createDataFrame(sets, "grp string, basket long, items array<string>").withColumn("n_ab", F.lit("clash"))
    df = df.select("grp", "basket", "items")
    for kw in ({}, {"entry_block": 60, "item_block": 6}):
        got = {(r.grp, r.item_a, r.item_b, r.n_ab) for r in pairs_together(df, 3, 1.5, **kw).collect()}
        assert got == brute(sets, 3, 1.5)


def test_paths_and_empty(spark):
    schema = "change_set_id long, project_id string, modified array<string>, added array<string>, items string"
    rows = [(i, "p", ["./a", "x\\b", None, "a"], None, "") for i in range(4)] + [(9, "p", [], None, "")] + [(20 + i, "p", None, ["z"], "") for i in range(4)]
    got = pairs_together(change_baskets(spark.createDataFrame(rows + rows[:2], schema))).collect()
    assert [(r.item_a, r.item_b, r.n_ab, r.n_baskets) for r in got] == [("a", "x/b", 4, 8)]
    assert pairs_together(change_baskets(spark.createDataFrame([], schema))).collect() == []
