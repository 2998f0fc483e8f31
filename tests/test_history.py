"""Version history against hand-made facts and a brute-force version."""

from __future__ import annotations

import datetime as dt
import random

from strandline.operators.history import version_history

SCHEMA = (
    "update_id long, e string, conf double, why string, valid_from timestamp_ntz, valid_to timestamp_ntz, "
    "txn_from timestamp_ntz, txn_to timestamp_ntz, t string, k string, a0 string"
)
BASE = dt.datetime(1970, 1, 1)


def ts(us):
    return None if us is None else BASE + dt.timedelta(microseconds=us)


def fact(i, e, conf, why, vf, vt=None, txn=0, gone=None):
    return (i, e, conf, why, ts(vf), ts(vt), ts(txn), ts(gone), "x", "y", "z")


def brute(facts):
    out, by = set(), {}
    for i, e, conf, why, vf, vt, txn, gone in facts:
        if gone is not None:
            continue
        vf = vf or 0
        k = (e, vf)
        if k not in by or (txn, i) > by[k][0]:
            by[k] = ((txn, i), conf, why, vt)
    for e in {k[0] for k in by}:
        rows = sorted((vf, *by[(x, vf)][1:]) for x, vf in by if x == e) if e is not None else sorted(
            ((vf, *by[(x, vf)][1:]) for x, vf in by if x is None), key=lambda r: r[0]
        )
        vs = []
        for j, (vf, conf, why, vt) in enumerate(rows):
            ends = [x for x in (vt, rows[j + 1][0] if j + 1 < len(rows) else None) if x is not None]
            end = min(ends) if ends else None
            if end is not None and end <= vf:
                continue
            if vs and vs[-1][3] == vf and vs[-1][:2] == (conf, why):
                vs[-1] = (conf, why, vs[-1][2], end)
            else:
                vs.append((conf, why, vf, end))
        out |= {(e, *v[:3], -1 if v[3] is None else v[3]) for v in vs}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = version_history(df, ["e"], ["conf", "why"], **kw).collect()
    res = [tuple(r) for r in got]
    assert len(res) == len(set(res))
    return set(res)


def test_hand_made(spark):
    rows = [
        fact(1, "a", 0.5, None, None),
        fact(1, "a", 0.5, None, None),  # delivered twice
        fact(2, "a", 0.5, None, 10),  # repeated without change
        fact(3, "a", 0.9, "r", 20, 20),  # of no length, ends the one before
        fact(4, "a", 0.9, "r", 30, 40),
        fact(5, "a", 0.1, "q", 30, 50, txn=9),  # corrects fact 4
        fact(6, "a", 0.2, "q", 35, gone=99),  # withdrawn
    ]
    assert run(spark, rows) == {("a", 0.5, None, 0, 20), ("a", 0.1, "q", 30, 50)}


def test_empty(spark):
    assert run(spark, []) == set()


def test_random_with_and_without_buckets(spark):
    rnd = random.Random(3)
    facts = []
    for i in range(600):
        e = rnd.choice(["hot", "hot", "b", "c", None])
        vf = rnd.choice([None, *range(0, 400, 4)])
        facts.append((i, e, rnd.choice([0.5, 0.7, None]), rnd.choice(["x", None]), vf, rnd.choice([None, None, (vf or 0) + rnd.randrange(0, 60)]), rnd.randrange(50), rnd.choice([None] * 9 + [1])))
    rows = [fact(*f) for f in facts]
    want = brute(facts)
    assert run(spark, rows) == want
    assert run(spark, rows, hot=5) == want
