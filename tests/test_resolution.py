"""Symbols, imports, calls, authors, routes, lineage and writers on fixtures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import authors as A
from strandline.operators import bitemporal as B
from strandline.operators import graph as G
from strandline.operators import lineage as L
from strandline.operators import resolve as V
from strandline.operators import routes as U
from strandline.sources import repository, store


def test_author_dedup(spark):
    rows = [("John Doe", "john@a", 5), ("J. Doe", "jd@b", 2), ("Doe", "john@a", 1), ("Jane Roe", None, 3), (None, "jane.roe@c", 1), ("", "", 9), ("A. Smith D.", "s@d", 1), ("Ann Smith", "s2@d", 1), (None, None, 1)]
    got = {r.author: (r.canonical, r.names, r.emails, r.commits) for r in A.dedup(spark.createDataFrame(rows, "name string, email string, commit_count long")).collect()}
    assert got == {"doe": ("John Doe", 3, 2, 8), "j roe": ("Jane Roe", 1, 0, 3), "jane roe": ("jane roe", 0, 1, 1), "a smith": ("A. Smith D.", 2, 2, 2)}


def test_symbols_calls_and_imports(spark):
    files = [
        (1, "p", "a/core.py", "python", "def load(x):\n    return 1\nclass Box:\n    pass\n"),
        (2, "p", "a/use.py", "python", "from a.core import load\nload(1)\nb = Box()\nx.other(2)\nmystery(3)\n"),
        (3, "p", "a/other.py", "python", "def load(y):\n    pass\n"),
        (4, "p", "src/app/Main.java", "java", "import app.Util;\npublic final class Main {}\ninterface Q {}\n"),
        (5, "p", "src/app/Util.java", "java", "class Util {}\n"),
        (6, "p", "web/x.js", "javascript", "import a from 'left-pad/lib';\nconst b = require(\"@scope/tool/x\");\nimport c from './y';\nexport default async function go() {}\n"),
        (7, "p", "m/deep.rs", "rust", "use crate::m::deep::Thing;\npub fn run() {}\npub struct S;\n"),
        (8, "p", "n.go", "go", "package n\n\nimport (\n\t\"app/m\"\n)\nfunc (s *S) Do() {}\ntype T struct {}\n"),
        (9, "p", None, None, None),
    ]
    f = spark.createDataFrame(files, "file_id long, project_id string, file_path string, language string, content string")
    sym = {(r.file_id, r.line, r.kind, r.name) for r in V.line_symbols(f).collect()}
    assert sym == {
        (1, 1, "Function", "load"), (1, 3, "Class", "Box"), (3, 1, "Function", "load"), (4, 2, "Class", "Main"), (4, 3, "Interface", "Q"), (5, 1, "Class", "Util"),
        (6, 4, "Function", "go"), (7, 2, "Function", "run"), (7, 3, "Class", "S"), (8, 6, "Function", "Do"), (8, 7, "Class", "T"),
    }
    imp = {(r.file_path, r.raw, r.target) for r in V.resolve_imports(f).collect()}
    assert imp == {("a/use.py", "a.core", "a/core.py"), ("src/app/Main.java", "app.Util", "src/app/Util.java"), ("m/deep.rs", "m::deep::Thing", "m/deep.rs")}
    assert {(r.package, r.used_by) for r in V.external_packages(f).collect()} == {("left-pad", 1), ("@scope/tool", 1)}
    s = spark.createDataFrame([("p", "a/core.py", "load", "1", "Function"), ("p", "a/other.py", "load", "2", "Function"), ("p", "a/core.py", "Box", "3", "Class"), ("p", "z.py", "other", "4", "Method"), ("p", "z.py", "mystery", "5", "Method")], "project_id string, file string, name string, id string, type string")
    i = spark.createDataFrame([("p", "a/use.py", "a/core.py")], "project_id string, file string, target string")
    got = {(r.file, r.name, r.id, r.confidence, r.reason) for r in V.resolve_calls(V.calls(f), s, i).collect() if r.file == "a/use.py"}
    assert got == {("a/use.py", "load", "1", 0.9, "import-resolved"), ("a/use.py", "Box", "3", 0.9, "import-resolved"), ("a/use.py", "other", "4", 0.5, "global")}
    n = spark.createDataFrame([("p", "A", "2", "Function"), ("p", "A", "9", "Class"), ("p", "B", "1", "Method")], "project_id string, name string, id string, type string")
    assert {(r.name, r.id, r.candidates) for r in V.disambiguate(n).collect()} == {("A", "9", 2), ("B", "1", 1)}


def test_gitignore_and_routes(spark):
    paths = ["dist/a.js", "x/dist/b", "a/dist", "build", "src/build/c", "y.min.js", "vendor/a/b", "vendor/keep/x", "q/node_modules/z", "a/b.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").filter(V.gitignore(F.col("p"), ["# x", "dist/", "/build", "*.min.js", "vendor/**", "!vendor/keep", "**/node_modules/"]))
    assert {r.p for r in df.collect()} == {"dist/a.js", "x/dist/b", "build", "y.min.js", "vendor/a/b", "q/node_modules/z"}
    u = spark.createDataFrame([("https://h.example/api/users/7?x=1#a",), ("/api/users/${id}/",), ("api/users/me",)], "u string").select(U.normal_url(F.col("u")).alias("u"))
    assert [r.u for r in u.collect()] == ["/api/users/7", "/api/users/[slot]", "/api/users/me"]
    r = spark.createDataFrame([("src/app/(shop)/items/[id]/route.ts",), ("pages/api/a/index.js",), ("src/x.ts",), ("app/route.ts",)], "p string").select(U.next_route(F.col("p")).alias("r"))
    assert [x.r for x in r.collect()] == ["/items/[id]", "/api/a", None, "/"]
    urls = spark.createDataFrame([("p", x) for x in ("/api/users/7", "/api/users/me", "/api/users/[slot]", "/other/7", "/api")], "project_id string, url string")
    routes = spark.createDataFrame([("p", x) for x in ("/api/users/[id]", "/api/users/me", "/:any/7", "/x")], "project_id string, route string")
    assert {(x.url, x.route) for x in U.match_routes(urls, routes).collect()} == {("/api/users/7", "/api/users/[id]"), ("/api/users/me", "/api/users/me"), ("/api/users/[slot]", "/api/users/[id]"), ("/other/7", "/:any/7")}


def test_lineage(spark):
    rows = [("p", f"n{k:03}", f"n{k + 1:03}") for k in range(70)] + [("p", "x", "y"), ("p", "y", "x"), ("q", "a", "b")]
    got = {(r.project, r.start): (r.current, r.hops) for r in L.rename_terminals(spark.createDataFrame(rows, "project string, old string, new string")).collect()}
    assert got[("p", "n000")] == ("n070", 70) and got[("p", "n069")] == ("n070", 1) and got[("q", "a")] == ("b", 1) and ("p", "x") not in got
    own = lambda rows: L.community_bus_factor(spark.createDataFrame(rows, "module string, author string, ownership double")).first().bus_factor
    assert own([(m, "a", 0.9) for m in "xyz"]) == 1 and own([("x", "a", 0.6), ("y", "b", 0.6), ("z", "c", 0.6)]) == 2 and own([("x", "a", 0.5)]) == -1
    c = spark.createDataFrame([("p", "c1", n) for n in "abc"] + [("p", "c2", n) for n in "def"] + [("q", "c1", "a")], "project_id string, community string, node string")
    good = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "d", "e"), ("p", "e", "f")], "project_id string, node_a string, node_b string")
    per, total = L.drift(c, good)
    assert {(r.project_id, r.community, r.best, r.drifted) for r in per.collect()} == {("p", "c1", 1.0, False), ("p", "c2", 1.0, False), ("q", "c1", 0.0, True)}
    assert {(r.project_id, r.drifted, r.divergence) for r in total.collect()} == {("p", 0, 0.0), ("q", 1, -1.0)}
    ch = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "a")], "project_id string, commit_hash long, node string")
    assert [tuple(r) for r in L.history_only(ch).collect()] == [("p", "a", "b", 1, 0.5, 0.5)]


def test_overrides_and_dispatch(spark):
    h = spark.createDataFrame([("p", "J", "K", "EXTENDS"), ("p", "J", "I", "IMPLEMENTS"), ("p", "M", "I", "IMPLEMENTS"), ("p", "M", "I2", "IMPLEMENTS"), ("p", "P", "A", "EXTENDS"), ("p", "P", "B", "EXTENDS"), ("p", "R", "A", "IMPLEMENTS"), ("p", "R", "B", "IMPLEMENTS")], "project_id string, src string, dst string, type string")
    cl = spark.createDataFrame([("p", "J", "java"), ("p", "M", "java"), ("p", "P", "python"), ("p", "R", "rust")], "project_id string, id string, language string")
    m = spark.createDataFrame([("p", c, n, f"{c}.{n}") for c, n in (("K", "f"), ("I", "f"), ("I2", "f"), ("A", "g"), ("B", "g"), ("A", "h"), ("B", "h"), ("P", "h"))], "project_id string, class string, name string, id string")
    assert {(r.src, r.name, r.dst, r.confidence) for r in G.overrides(h, cl, m).collect()} == {("J", "f", "K.f", 0.95), ("M", "f", None, 0.5), ("P", "g", "A.g", 0.9), ("R", "g", None, 0.5), ("R", "h", None, 0.5)}
    e = spark.createDataFrame([("p", "x", "I", "CALLS"), ("p", "c1", "I", "IMPLEMENTS"), ("p", "c2", "I", "IMPLEMENTS"), ("p", "x", "c2", "CALLS")], "project_id string, src string, dst string, type string")
    assert [(r.src, r.dst, r.confidence) for r in V.interface_dispatch(e).collect()] == [("x", "c1", 0.7)]
    steps = G.process_steps(spark.createDataFrame([("p", "a", ["a", "b", "c"])], "project_id string, entry string, path array<string>"), spark.createDataFrame([("p", "a", "1"), ("p", "b", "1"), ("p", "c", "2")], "project_id string, node string, community string"))
    assert [(r.node, r.step, r.process_type) for r in steps.orderBy("step").collect()] == [("a", 1, "cross_community"), ("b", 2, "cross_community"), ("c", 3, "cross_community")]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "edges")
    schema = "project_id string, src string, dst string, type string, confidence double"
    spark.createDataFrame([("p", "a", "b", "CO_CHANGED_WITH", 0.1), ("p", "a", "c", "CALLS", 1.0), ("q", "a", "b", "CO_CHANGED_WITH", 0.2)], schema).write.partitionBy("project_id").parquet(path)
    m = spark.createDataFrame([("p", "x", "y", 3, 0.5, 0.6, 0.7, 2.0)], "project_id string, node_a string, node_b string, co_changes long, support double, confidence_ab double, confidence_ba double, lift double")
    for _ in range(2):
        store.replace_type(spark, path, L.both_directions(m), "CO_CHANGED_WITH")
        got = {(r.project_id, r.src, r.dst, r.type, r.confidence) for r in spark.read.parquet(path).collect()}
        assert got == {("p", "x", "y", "CO_CHANGED_WITH", 0.6), ("p", "y", "x", "CO_CHANGED_WITH", 0.7), ("p", "a", "c", "CALLS", 1.0), ("q", "a", "b", "CO_CHANGED_WITH", 0.2)}
    store.replace_type(spark, path, L.both_directions(m.limit(0)), "CO_CHANGED_WITH")
    assert spark.read.parquet(path).count() == 4
    n = spark.createDataFrame([("p", "x", "Author"), ("p", "z", "Author"), ("p", "w", "File")], "project_id string, id string, type string")
    assert [r.id for r in store.orphans(n, spark.read.parquet(path), "Author").collect()] == ["z"]
    t0 = dt.datetime(2026, 1, 1)
    f = spark.createDataFrame([("p", "w1", "n", "DESCRIBES", None, None), ("p", "n", "w1", "DOCUMENTED_BY", None, None), ("p", "w2", "n", "DESCRIBES", t0, None), ("p", "a", "n", "CALLS", None, None), ("q", "w1", "n", "DESCRIBES", None, None)], "project_id string, src string, dst string, type string, valid_to timestamp_ntz, txn_to timestamp_ntz")
    gone = spark.createDataFrame([("p", "n")], "project_id string, id string")
    once = B.close_for_nodes(f, gone, "2026-02-01 00:00:00")
    t1 = dt.datetime(2026, 2, 1)
    want = [("p", "CALLS", None, None), ("p", "DESCRIBES", t0, None), ("p", "DESCRIBES", t1, t1), ("p", "DOCUMENTED_BY", t1, t1), ("q", "DESCRIBES", None, None)]
    for r in (once, B.close_for_nodes(once, gone, "2026-03-01 00:00:00")):
        assert sorted([(x.project_id, x.type, x.valid_to, x.txn_to) for x in r.collect()], key=str) == sorted(want, key=str)


def test_git_log_is_read_commit_by_commit(spark, tmp_path):
    import subprocess

    repo = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=An", "-c", "user.email=an@x", *a], check=True, capture_output=True)
    repo.mkdir()
    git("init", "-q")
    for i, name in enumerate(("a.txt", "b.txt", "a.txt")):
        (repo / name).write_text(f"{i}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"step {i} | {name}")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "r.log").write_text(repository.export_git_log(str(repo)))
    got = {(r.message, r.change_type, r.file_path, r.email) for r in repository.git_log(spark, str(tmp_path / "log")).collect()}
    assert got == {("step 0 | a.txt", "added", "a.txt", "an@x"), ("step 1 | b.txt", "added", "b.txt", "an@x"), ("step 2 | a.txt", "modified", "a.txt", "an@x")}
