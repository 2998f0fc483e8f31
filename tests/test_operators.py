"""Hand-made expectations for the core operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.times import parse_time
from strandline.operators import bitemporal as B
from strandline.operators import coupling as C
from strandline.operators import graph as G
from strandline.operators import ingest as I
from strandline.operators import retrieval as S
from strandline.plans.sql_api import TEMPLATES, read_only, safe_query
from strandline.sources import repository, store
from strandline.streaming import feed

NOW = dt.datetime(2026, 5, 28, 12)


def test_times():
    p = lambda s, **k: parse_time(s, NOW, **k)
    assert p("3 days ago") == NOW - dt.timedelta(days=3) and p("2 months ago") == NOW - dt.timedelta(days=60)
    assert p("yesterday") == NOW - dt.timedelta(days=1) and p("since 2026-01-01") == dt.datetime(2026, 1, 1)
    assert p("1700000000") == p("1700000000000") and p("v1.0") is None and p("v1.0", tag=lambda t: NOW) == NOW


def test_coupling_metrics(spark):
    pairs = spark.createDataFrame([("a", "b", 5)], "node_a string, node_b string, co_changes long")
    ch = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(20)], "node string, commit_hash long")
    r = C.coupling(pairs, ch, spark.createDataFrame([(100,)], "total long"), []).first()
    assert (r.support, r.confidence_ab, r.confidence_ba, r.lift) == (0.05, 0.5, 0.25, 2.5)
    pc = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 2), ("a", 3)], "node string, commit_hash long")
    assert {(x.node_a, x.node_b, x.co_changes) for x in C.pair_counts(pc, []).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


def test_bus_factor(spark):
    one = spark.createDataFrame([("m1", "x"), ("m2", "x"), ("m3", "x")], "node string, author string")
    assert C.bus_factor(one).first().bus_factor == 1
    three = spark.createDataFrame([("m1", "x"), ("m2", "y"), ("m3", "z")], "node string, author string")
    assert C.bus_factor(three).first().bus_factor == 2
    assert C.bus_factor(one.limit(0)).first().bus_factor == 0


def test_stability(spark):
    rows = [("r1", f"c{i}", dt.datetime(2026, 1, 1 + i)) for i in range(3)] + [("r2", "c1", dt.datetime(2026, 1, 1))] + [("r3", f"c{i}", dt.datetime(2026, 1, 1 + i)) for i in range(8)] + [("r0", None, None)]
    df = spark.createDataFrame(rows, "route string, commit string, ts timestamp_ntz")
    assert {r.route: (r.stability, r["class"]) for r in C.stability(df, ["route"]).collect()} == {"r1": (0.7, "moderate"), "r2": (0.9, "stable"), "r3": (0.2, "volatile"), "r0": (1.0, "stable")}


def test_supersede_leaves_one_open(spark):
    f = spark.createDataFrame([("k", dt.datetime(2026, 1, d), None) for d in (3, 1, 2)], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = B.supersede(f, ["k"], ["valid_from"]).orderBy("valid_from").collect()
    assert [r.valid_to for r in got] == [dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3), None]


def edges(spark, rows, typ="CALLS"):
    return spark.createDataFrame([("p", a, b, typ, 0.9) for a, b in rows], "project_id string, src string, dst string, type string, confidence double")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", "y"), ("e", "e")])
    up = {r.node: r.depth for r in G.bfs(e, spark.createDataFrame([("p", "c")], "project_id string, node string"), 3).collect()}
    assert up == {"c": 0, "b": 1, "d": 1, "a": 2}
    assert {r.node: r.component for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    lv = {r.node: r.level for r in G.topological_levels(e).collect()}
    assert lv["d"] == 0 and lv["x"] == 0 and lv["y"] == 1 and lv["a"] == lv["b"] == lv["c"] == -1
    n = spark.createDataFrame([("p", i, i == "x") for i in "abcdexy"], "project_id string, id string, is_exported boolean")
    assert {r.id: (r.reason, r.confidence) for r in G.no_inbound(n, e).collect()} == {"d": ("no_callers_internal", 0.9), "x": ("no_callers_exported", 1.0), "e": ("only_self", 0.95)}
    t = G.traces(e, spark.createDataFrame([("p", "d")], "project_id string, node string")).collect()
    # a path that is a part of a longer one is left out
    assert [r.path for r in t] == [["d", "c", "a", "b"]]
    r = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a")], "project string, old string, new string")
    assert {(x.start, x.current, x.hops) for x in G.rename_chain(r).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_mro(spark):
    assert G.c3({"d": ["b", "c"], "b": ["a"], "c": ["a"]}, "d") == ["d", "b", "c", "a"]
    assert G.c3({"x": ["a", "b"], "a": ["b"], "y": ["x"], "b": ["a"]}, "y") is None
    e = edges(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "EXTENDS")
    assert {r.node: r.mro for r in G.method_resolution(e).collect()}["d"] == ["d", "b", "c", "a"]


def test_no_bound_on_levels_or_ancestors(spark):
    chain = edges(spark, [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)] + [("z", "n000"), ("y", "y2"), ("y2", "y"), ("y2", "y3")])
    lv = {r.node: r.level for r in G.topological_levels(chain).collect()}
    assert lv["z"] == 0 and all(lv[f"n{k:03}"] == k + 1 for k in range(41)) and lv["y"] == lv["y2"] == lv["y3"] == -1
    mro = {r.node: r.mro for r in G.method_resolution(edges(spark, [(f"c{k:02}", f"c{k + 1:02}") for k in range(16)], "EXTENDS")).collect()}
    assert mro["c00"] == [f"c{k:02}" for k in range(17)]
    # diamonds above diamonds: each class is merged once, not once per way up
    deep = {f"d{k}": [f"a{k}", f"b{k}"] for k in range(40)} | {f"{c}{k}": [f"d{k + 1}"] for k in range(40) for c in "ab"}
    assert len(G.c3(deep, "d0")) == 121
    long = edges(spark, [(f"n{k:03}", f"n{k + 1:03}") for k in range(90)])
    assert {r.component for r in G.components(long).collect()} == {"n000"}


def test_wide_commits_and_pruning(spark):
    rows = [(f"f{i:04}", 1) for i in range(600)] + [("f0000", 2), ("f0599", 2), ("g", 2)]
    ch = spark.createDataFrame(rows, "node string, commit_hash long")
    assert C.pair_counts(ch, []).count() == 600 * 599 // 2 + 2
    assert [tuple(r) for r in C.pair_counts(ch, [], min_count=2).collect()] == [("f0000", "f0599", 2)]


def test_top_similar_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((120, 8)).round(1)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(200, [float(v) for v in x[3]])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = S.top_similar(v, v.filter("id % 10 = 0"), 4)
    got = S.top_similar(v, v.filter("id % 10 = 0"), 4, vector_block=17, query_block=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 13 * 4


def test_git_log_and_blame(spark):
    h = "a" * 40
    log = f"{h}|An|an@x|2026-01-01T00:00:00Z|fix: a | b\r\n\r\nA\tsrc/a.ts\r\nM\tb.ts\nD\tc.ts\nR100\told.ts\tnew.ts\nC75\tx.ts\ty.ts\nT\tz.ts\n"
    rows = I.parse_git_log(spark.createDataFrame([("r", log)], "repo string, text string")).collect()
    assert [(r.change_type, r.file_path, r.new_path) for r in rows] == [("added", "src/a.ts", None), ("modified", "b.ts", None), ("deleted", "c.ts", None), ("renamed", "old.ts", "new.ts"), ("added", "y.ts", None)]
    assert rows[0].message == "fix: a | b" and rows[0].email == "an@x"
    two = I.parse_git_log(spark.createDataFrame([("r", log + log.replace("a" * 40, "b" * 40))], "repo string, text string"))
    assert sorted((r.hash[0], r.n) for r in two.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).collect()) == [("a", 5), ("b", 5)]
    b = I.parse_blame(spark.createDataFrame([("f", "author-mail <a@x>\n\tx\nauthor-mail <a@x>\n\ty\nauthor-mail <b@x>\n\tz\n")], "path string, text string")).collect()
    assert {(r.email, r.lines, r.share) for r in b} == {("a@x", 2, 0.6667), ("b@x", 1, 0.3333)}


def test_tiers(spark):
    refs = spark.createDataFrame([("p", "f", n) for n in ("a", "b", "c", "d")], "project_id string, file string, name string")
    sym = spark.createDataFrame([("p", "f", "a", "1"), ("p", "g", "a", "2"), ("p", "g", "b", "3"), ("p", "h", "b", "4"), ("p", "h", "c", "5"), ("p", "h", "d", "6"), ("p", "i", "d", "7")], "project_id string, file string, name string, id string")
    imp = spark.createDataFrame([("p", "f", "g")], "project_id string, file string, target string")
    assert {(r.name, r.id, r.tier) for r in I.resolve_tiers(refs, sym, imp).collect()} == {("a", "1", 0.95), ("b", "3", 0.9), ("c", "5", 0.5)}


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1)], "id long, rank int")
    got = {r.id: r.score for r in S.rrf([a, b]).collect()}
    assert got == {1: round(1 / 61, 8), 2: round(1 / 62 + 1 / 61, 8)}


def test_read_only_and_templates(spark):
    assert read_only("SELECT 1; ") and read_only("WITH a AS (SELECT ';' AS x) SELECT * FROM a") and not read_only("DROP TABLE x") and not read_only("SELECT 1; DROP TABLE x")
    edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]).createOrReplaceTempView("edges")
    got = {(r.node, r.depth) for r in safe_query(spark, "reach", project="p", id="a", depth=2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    for bad in ({"template": "none"}, {"template": "callers"}, {"template": "reach", "project": "p", "id": "a", "depth": 11}):
        with pytest.raises((KeyError, ValueError)):
            safe_query(spark, **bad)
    assert len(TEMPLATES) == 13


def test_store_and_feed(spark, tmp_path):
    path, src = str(tmp_path / "store"), str(tmp_path / "in")
    schema = "project_id string, id string, name string, size int"
    a = spark.createDataFrame([("p", "1", "x", 1), ("q", "2", "y", 2)], schema)
    store.upsert(spark, path, a, ["project_id", "id"])
    store.upsert(spark, path, spark.createDataFrame([("p", "1", None, 9), ("p", "3", "z", 3)], schema), ["project_id", "id"])
    rows = lambda: {(r.project_id, r.id, r.name, r.size) for r in spark.read.parquet(path).collect()}
    assert rows() == {("p", "1", "x", 9), ("p", "3", "z", 3), ("q", "2", "y", 2)}
    store.delete(spark, path, spark.createDataFrame([("q", "2"), ("p", "3")], "project_id string, id string"), ["project_id", "id"])
    assert rows() == {("p", "1", "x", 9)}
    a.write.parquet(src)
    for _ in range(2):
        feed.apply_feed(feed.facts_stream(spark, src, schema), path, ["project_id", "id"], str(tmp_path / "cp")).awaitTermination()
    assert rows() == {("p", "1", "x", 1), ("q", "2", "y", 2)}
    assert feed.refresh_mode(3, 0.01, 1, 2) == "incremental" and feed.refresh_mode(3, 0.06, 1, 2) == "full"
    w = feed.windowed_counts(spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, 5), "a", 1.0), (dt.datetime(2026, 1, 1, 0, 50), "a", 2.0)], "ts timestamp, event_type string, value double"))
    assert [(r.n, r.value) for r in w.collect()] == [(2, 3.0)]


def test_walk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin2").write_bytes(b"a\0b")
    (tmp_path / "src/c.png").write_bytes(b"abc")
    (tmp_path / "node_modules/d.js").write_text("y\n")
    got = repository.walk(spark, str(tmp_path), "p").collect()
    assert [(r.file_path, r.language, r.content) for r in got] == [("src/a.py", "python", "x = 1\n")]
    ids = spark.createDataFrame([("a",)], "id string").select(store.vector_id("id").alias("u")).first().u
    assert len(ids) == 36 and ids.count("-") == 4
    d = I.markdown_sections(spark.createDataFrame([(1, "# A\ntext\n## B\n### C\n## D\n")], "doc long, text string")).orderBy("line_no").collect()
    assert [(r.title, r.parent_line) for r in d] == [("A", -1), ("B", 0), ("C", 2), ("D", 0)]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    got = {r.node: r.root for r in G.components_by(spark.createDataFrame(edges, "a long, b long"), [], "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {a for a, b in edges if a == b}
