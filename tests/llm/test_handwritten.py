"""Forest, notices, near copies and scores on a small collection."""

from __future__ import annotations

import random

import numpy as np

from strandline.llm.handwritten import FEATURES, Forest, _near_copies, blob, features, file_scores, machine_files, notice, signature


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = Forest(x, y, trees=30)
    t = rng.standard_normal((400, 6))
    assert ((f.score(t) > 0.5) == ((t[:, 0] > 0) ^ (t[:, 3] > 0.5))).mean() > 0.9


def test_notice():
    assert notice("p", "// Code generated by x. DO NOT EDIT.\nlet a = 1\n") and notice("p", "// pad v1.2.3\n// https://pad.example/\nf()\n")
    assert notice("p", "# Part of q. Use it.\nx = 1\n") and not notice("p", "# Part of p. Use it.\nx = 1\n")
    assert not notice("p", "// This file is not generated; please edit it freely.\nf()\n") and not notice("p", "f() // generated by hand\n")
    assert len(features("a/b.js", "")) == len(features(None, "let a = 1")) == len(FEATURES)


def test_scores(spark):
    rnd = random.Random(7)
    words = "window table reader branch commit folder module parser graph leaf token report".split()

    def hand(n=8):
        out = []
        for k in range(n):
            a, b, c = rnd.choice(words), rnd.choice(words), rnd.choice(words)
            out.append(f"// Reads the {a} of the {b}.\nfunction read{a.title()}{k}(x) {{\n    const {b}{rnd.randrange(99)} = load{c.title()}(x, {rnd.randrange(99)});\n    if ({b}) {{\n        return {c}.{a}(x);\n    }}\n    return null;\n}}\n")
        return "\n".join(out)

    def pressed():
        return "(()=>{" + ";".join(f"var {rnd.choice('abcdefgh')}{rnd.choice('XYZ')}=function({rnd.choice('klm')}){{return {rnd.randrange(99)}*{rnd.choice('klm')}}}" for _ in range(40)) + "})();"

    rows = [(i, f"p{i % 5}", f"src/{rnd.choice(words)}/f{i}.js", hand()) for i in range(160)]
    for i in range(40):
        rows.append((1000 + i, f"p{i % 5}", f"dist/g{i}.min.js", ("/*! x 1.0 */\n" if i % 2 else "") + pressed()))
    shared = hand(14)
    rows += [(2000 + i, f"p{i}", f"src/util/pad{i}.js", ("// pad v1.2.3\n" if i < 3 else "") + shared.replace("null", "undefined", i)) for i in range(5)]
    rows += [(3000, "p0", "a.js", ""), (3001, None, None, None), rows[0], (None, "p0", "b.js", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, project_id string, file_path string, content string, x string")
    got = {r.file_id: r.score for r in file_scores(df).collect()}
    assert len(got) == len({r[0] for r in rows if r[0] is not None}) and got[3000] == got[3001] == 0
    found = {k for k, v in got.items() if v >= 0.5}
    assert len(found & set(range(1000, 1040))) >= 38 and len([k for k in found if k < 1000]) <= 4
    assert {2000, 2001, 2002} <= found
    assert machine_files(df.limit(0)).collect() == []


def test_false_label_is_outvoted(spark):
    rnd = random.Random(11)
    words = "window table reader branch commit folder module parser graph leaf token report".split()

    def hand():
        return "\n".join(f"function {rnd.choice(words)}{k}(x) {{\n    const {rnd.choice(words)}{rnd.randrange(99)} = load(x, {rnd.randrange(99)});\n    if (x.{rnd.choice(words)}) {{\n        return {rnd.choice(words)}(x);\n    }}\n    return null;\n}}\n" for k in range(rnd.randrange(5, 12)))

    def pressed():
        return "(()=>{" + ";".join(f"var {rnd.choice('abcdefgh')}{rnd.choice('XYZ')}=function({rnd.choice('klm')}){{return {rnd.randrange(99)}*{rnd.choice('klm')}}}" for _ in range(40)) + "})();"

    rows = [(i, f"p{i % 5}", f"src/{rnd.choice(words)}/f{i}.js", hand()) for i in range(400)]
    rows += [(1000 + i, f"p{i % 5}", f"dist/g{i}.min.js", "/*! x 1.0 */\n" + pressed()) for i in range(40)]
    # the notice is wrong: the text is like the other files of the project
    rows.append((2000, "p1", "src/table/f2000.js", "// Code generated by x. DO NOT EDIT.\n" + hand()))
    got = {r.file_id: r.score for r in file_scores(spark.createDataFrame(rows, "file_id long, project_id string, file_path string, content string")).collect()}
    assert notice("p1", rows[-1][3]) and got[2000] < 0.5
    assert sum(got[1000 + i] >= 0.5 for i in range(40)) >= 38


def test_header_is_hidden():
    body = "function read(x) {\n    return load(x, 1);\n}\n" * 9
    assert features("a.js", body) == features("a.js", "// Code generated by x. DO NOT EDIT.\n" + body) == features("a.js", "/*! x 1.0 */\n" + body)
    long = "x = [" + ", ".join(f"a{i}" for i in range(200)) + "]\n"
    assert features("a.py", long + long) != features("a.py", long + long[:210] + "b0]\n")  # whole lines count
    assert blob("DATA = [" + "0x1f, " * 90 + "]") and not blob(body)


def test_near_copies_of_a_hot_bucket(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]

    def copy():
        w = list(base)
        w[rnd.randrange(300)] = f"z{rnd.randrange(10**6)}"
        return " ".join(w)

    rows = [(i, "p1" if i == 77 else "p0", copy()) for i in range(150)]
    rows += [(1000 + i, f"q{i % 2}", " ".join(f"v{rnd.randrange(5000)}" for _ in range(300))) for i in range(60)]
    sig = spark.createDataFrame([(i, p, signature(t)) for i, p, t in rows], "body long, project string, sig array<long>")
    want = {r.body for r in _near_copies(sig).collect()}
    assert want == set(range(150)) == {r.body for r in _near_copies(sig, bucket=16).collect()}
    assert _near_copies(sig.limit(0)).collect() == []
