"""Graph traversal and structure over edge tables (project_id, src, dst, type)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

CALLS = ("CALLS", "IMPORTS", "USES", "EXTENDS", "IMPLEMENTS", "OVERRIDES")


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: node, direction, other, type."""
    out = edges.select("project_id", F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "type")
    return out.union(edges.select("project_id", "dst", F.lit("in"), "src", "type"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "upstream", types: tuple[str, ...] = CALLS) -> DataFrame:
    """First-visit depth of every node reached from the seeds (project_id,
    node). One join per level for the whole frontier; visited nodes are left
    out, so cycles end and each node is expanded once. The edges are
    checkpointed once, the frontier once per level."""
    e = edges.filter(F.col("type").isin(*types)).select("project_id", *(("dst", "src") if direction == "upstream" else ("src", "dst"))).toDF("project_id", "node", "next").distinct()
    e = cut(e)
    seen = cut(seeds.select("project_id", "node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(e, ["project_id", "node"]).select("project_id", F.col("next").alias("node")).distinct()
        front = step.join(seen, ["project_id", "node"], "left_anti").withColumn("depth", F.lit(k))
        if k < depth:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.union(front)
    return seen


def risk(n: Column) -> Column:
    """Risk class of the number of affected nodes."""
    return F.when(n >= 10, "CRITICAL").when(n >= 5, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW")


def no_inbound(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("CALLS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "USES")) -> DataFrame:
    """Nodes (project_id, id) nobody refers to, or only they themselves."""
    e = edges.filter(F.col("type").isin(*types))
    used = e.filter("src <> dst").select("project_id", F.col("dst").alias("id")).distinct()
    own = e.filter("src = dst").select("project_id", F.col("dst").alias("id")).distinct().withColumn("self", F.lit(True))
    dead = nodes.join(used, ["project_id", "id"], "left_anti").join(own, ["project_id", "id"], "left")
    exported = F.coalesce("is_exported", F.lit(False))
    reason = F.when(F.col("self"), "only_self").when(exported, "no_callers_exported").otherwise("no_callers_internal")
    conf = F.when(F.col("self"), 0.95).when(exported, 1.0).otherwise(0.9)
    return dead.withColumn("reason", reason).withColumn("confidence", conf).drop("self")


def components(edges: DataFrame) -> DataFrame:
    """(project_id, node, component): smallest node reachable by undirected
    edges."""
    return components_by(edges, ["project_id"], "src", "dst").withColumnRenamed("root", "component")


def components_by(edges: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(*by, node, root): root is the smallest node of the component; only
    nodes with an edge to another appear; null ends are left out.

    Alternating large-star and small-star steps: every round is two aggregations
    over an edge table that never grows, and components shrink to stars in a
    logarithmic number of rounds, until nothing changes. A node with a huge
    neighbourhood costs one minimum, combined map-side. Each round is
    checkpointed; only a count and a checksum reach the driver.
    """
    e = edges.select(*by, F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "u", "v"))).first())
    key = [*by, "u"]
    was = sign(e)
    while was[0]:
        both = e.union(e.select(*by, "v", "u"))
        # large star: larger neighbours are linked to the smallest neighbour
        low = both.groupBy(*key).agg(F.min("v").alias("m")).select(*key, F.least("u", "m").alias("m"))
        large = both.join(low, key).filter("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours are linked to the smallest of them
        down = large.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        low2 = down.groupBy(*key).agg(F.min("v").alias("m"))
        j = down.join(low2, key)
        small = j.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select(*by, "u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        now = sign(e)
        if now == was:
            break
        was = now
    roots = e.groupBy(*key).agg(F.min("v").alias("root"))
    return roots.select(*by, F.col("u").alias("node"), "root").union(roots.select(*by, F.col("root").alias("node"), "root").distinct())


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities: each node takes the most frequent label among its
    neighbours and itself (ties: the smaller label). Deterministic."""
    both = cut(edges.select("project_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("project_id", "dst", "src")).filter("a <> b").distinct())
    lab = both.select("project_id", F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(lab.select("project_id", F.col("node").alias("b"), "label"), ["project_id", "b"]).select("project_id", F.col("a").alias("node"), "label").union(lab.select("project_id", "node", "label"))
        n = votes.groupBy("project_id", "node", "label").agg(F.count(F.lit(1)).alias("n"))
        best = n.groupBy("project_id", "node").agg(F.min(F.struct(-F.col("n"), "label")).alias("m"))
        lab = cut(best.select("project_id", "node", F.col("m.label").alias("label")))
    return lab.withColumnRenamed("label", "community")


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of edge ends of a community that stay inside it."""
    m = members.select("project_id", "node", "community")
    e = edges.select("project_id", "src", "dst").filter("src <> dst").distinct()
    a = m.select("project_id", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = m.select("project_id", F.col("node").alias("dst"), F.col("community").alias("cb"))
    j = e.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"])
    ends = j.select("project_id", F.explode(F.array("ca", "cb")).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"))
    size = m.groupBy("project_id", "community").agg(F.count(F.lit(1)).alias("members"))
    share = ends.groupBy("project_id", "community").agg(F.round(F.avg(F.col("inside").cast("double")), 6).alias("cohesion"))
    return size.join(share, ["project_id", "community"], "left").filter("members > 1").select("project_id", "community", "members", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """Level of each node (0: nothing comes before it; else the longest way
    from there); nodes on or behind a cycle get -1. Each round settles all
    nodes whose predecessors are settled: one join and one checkpoint per
    level, until none is free."""
    e = cut(edges.select("project_id", "src", "dst").filter("src <> dst").distinct())
    into = e.groupBy("project_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    first = e.select("project_id", F.col("src").alias("node"), F.lit(0).cast("bigint").alias("open")).union(into)
    state = cut(first.groupBy("project_id", "node").agg(F.max("open").alias("open")).withColumn("level", F.when(F.col("open") == 0, 0)))
    k = 0
    while not state.filter(F.col("level") == k).isEmpty():
        free = state.filter(F.col("level") == k).select("project_id", F.col("node").alias("src"))
        done = e.join(free, ["project_id", "src"]).groupBy("project_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        k += 1
        left = F.col("open") - F.coalesce("n", F.lit(0))
        settled = F.when(F.col("level").isNull() & (left == 0), k).otherwise(F.col("level"))
        state = cut(state.join(done, ["project_id", "node"], "left").select("project_id", "node", left.alias("open"), settled.alias("level")))
    return state.select("project_id", "node", F.coalesce("level", F.lit(-1)).alias("level"))


def traces(edges: DataFrame, entries: DataFrame, depth: int = 10, branch: int = 4, per_entry: int = 12, least: int = 3) -> DataFrame:
    """Call paths from entry points: at most ``branch`` callees per step (by
    confidence, then name), no node twice in a path, at most ``depth`` nodes,
    none that is a part of a longer one, the ``per_entry`` longest paths of an
    entry, as in call-flow tracing."""
    w = Window.partitionBy("project_id", "src").orderBy(F.col("confidence").desc(), "dst")
    e = edges.filter((F.col("type") == "CALLS") & (F.col("confidence") >= 0.5) & (F.col("src") != F.col("dst")))
    e = e.groupBy("project_id", "src", "dst").agg(F.max("confidence").alias("confidence"))
    e = cut(e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= branch).select("project_id", "src", "dst"))
    path = entries.select("project_id", F.col("node").alias("entry"), F.array("node").alias("path"))
    done = []
    for _ in range(depth - 1):
        p = path.withColumn("src", F.element_at("path", -1))
        grown = p.join(e, ["project_id", "src"]).filter(~F.array_contains("path", F.col("dst"))).select("project_id", "entry", F.concat("path", F.array("dst")).alias("path"))
        path = cut(grown)
        if done and path.isEmpty():
            break
        done.append(path)
    every = done[0]
    for p in done[1:]:
        every = every.union(p)
    every = every.filter(F.size("path") >= least)
    # a path that is a part of a longer one tells nothing new
    n = F.size("path")
    spans = F.flatten(F.transform(F.sequence(F.lit(least), F.greatest(n - 1, F.lit(least))), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.slice("path", i, w))))
    parts = every.filter(n > least).select("project_id", F.explode(spans).alias("path")).distinct()
    every = every.join(parts, ["project_id", "path"], "left_anti")
    # of paths between the same ends the longest (then the first by name)
    key = ["project_id", "entry", F.element_at("path", -1).alias("last")]
    best = every.groupBy(*key).agg(F.min(F.struct(-F.size("path"), "path")).alias("b")).select("project_id", "entry", F.col("b.path").alias("path"))
    we = Window.partitionBy("project_id", "entry").orderBy(F.size("path").desc(), "path")
    return best.withColumn("r", F.row_number().over(we)).filter(F.col("r") <= per_entry).drop("r")


def process_steps(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Traces (project_id, entry, path) -> their steps from 1, and whether the
    trace stays in one community (project_id, node, community) or crosses."""
    p = paths.withColumn("trace", F.array_join("path", " > ")).select("project_id", "entry", "trace", F.posexplode("path").alias("i", "node"))
    j = p.join(members.select("project_id", "node", "community"), ["project_id", "node"], "left")
    kind = j.groupBy("project_id", "trace").agg(F.countDistinct("community").alias("n"))
    cross = F.when(F.col("n") > 1, "cross_community").otherwise("intra_community")
    return j.join(kind, ["project_id", "trace"]).select("project_id", "entry", "trace", "node", (F.col("i") + 1).alias("step"), cross.alias("process_type"))


#: name patterns of entry points and of helpers (fixed values), and their factors
ENTRY, HELPER = r"(?i)^(?:handle|on|run|start|main|serve|process|init|dispatch|execute)", r"(?i)^(?:get|set|is|has|to|format|parse|util|helper|log|assert)"


def entry_score(calls: Column, callers: Column, name: Column, exported: Column) -> Column:
    """Calls over callers, doubled for exported symbols, less for helpers, more
    for names that begin like entry points."""
    named = F.when(name.rlike(HELPER), 0.3).when(name.rlike(ENTRY), 1.5).otherwise(1.0)
    return F.round(calls / (callers + 1.0) * F.when(exported, 2.0).otherwise(1.0) * named, 6)


def rename_chain(renames: DataFrame, depth: int = 10) -> DataFrame:
    """(project, old, new) -> every (start, current, hops) along the chain, at
    most ``depth`` hops, each start's own path without repeats."""
    r = cut(renames.select("project", "old", "new").filter("old <> new").distinct())
    path = r.select("project", F.col("old").alias("start"), F.col("new").alias("current"), F.array("old", "new").alias("seen"), F.lit(1).alias("hops"))
    out = [path]
    for _ in range(depth - 1):
        nxt = out[-1].join(r.select("project", F.col("old").alias("current"), "new"), ["project", "current"]).filter(~F.array_contains("seen", F.col("new")))
        step = cut(nxt.select("project", "start", F.col("new").alias("current"), F.concat("seen", F.array("new")).alias("seen"), (F.col("hops") + 1).alias("hops")))
        if step.isEmpty():
            break
        out.append(step)
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every.drop("seen")


def best_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best Jaccard similarity of each set of ``a`` (set, member) with any set
    of ``b``, from intersection counts (a join on the member, no cross
    product of sets)."""
    na, nb = a.groupBy("set").agg(F.countDistinct("member").alias("na")), b.groupBy(F.col("set").alias("other")).agg(F.countDistinct("member").alias("nb"))
    both = a.distinct().join(b.select(F.col("set").alias("other"), "member").distinct(), "member").groupBy("set", "other").agg(F.count(F.lit(1)).alias("n"))
    j = both.join(na, "set").join(nb, "other").withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = j.groupBy("set").agg(F.max("j").alias("best"))
    return na.select("set").join(best, "set", "left").select("set", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


def c3(parents: dict[str, list[str]], name: str, memo: dict[str, list[str] | None] | None = None) -> list[str] | None:
    """Method resolution order by C3; None where there is none (or a cycle).
    Each class is merged once, in depth-first order without recursion."""
    memo = {} if memo is None else memo
    todo, open_ = [(name, False)], set()
    while todo:
        at, ready = todo.pop()
        if at in memo:
            continue
        ps = list(parents.get(at, []))
        if not ready:
            open_.add(at)
            todo.append((at, True))
            todo += [(p, False) for p in ps if p not in memo and p not in open_]
            continue
        # a parent that is still open lies on a cycle with this class
        memo[at] = None if any(memo.get(p) is None for p in ps) else _merge(at, [memo[p] for p in ps], ps)
        open_.discard(at)
    return memo[name]


def _merge(name: str, lists: list[list[str]], ps: list[str]) -> list[str] | None:
    out, lists = [name], [list(x) for x in (*lists, ps) if x]
    while lists:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [y for y in ([z for z in x if z != head] for x in lists) if y]
    return out


def method_resolution(edges: DataFrame) -> DataFrame:
    """(project_id, node, mro): C3 order of every class with parents. The
    ancestors of a class are gathered by joins until none is new; only this
    closure of one class goes into Python, in Arrow batches."""
    h = edges.filter(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select("project_id", "src", "dst").filter("src <> dst").distinct()
    up = cut(h.groupBy("project_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("parents")))
    step = up.select("project_id", F.col("src").alias("at"), "parents")
    every = cut(up.select("project_id", F.col("src").alias("node"), F.col("src").alias("at")))
    front = every
    while not front.isEmpty():
        nxt = front.join(step, ["project_id", "at"]).select("project_id", "node", F.explode("parents").alias("at")).distinct()
        front = cut(nxt.join(every, ["project_id", "node", "at"], "left_anti"))
        every = every.union(front)
    packed = every.join(step, ["project_id", "at"]).groupBy("project_id", "node").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("at", "parents")))).alias("m"))

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"project_id": f["project_id"], "node": f["node"], "mro": [c3(json.loads(m), n) for n, m in zip(f["node"], f["m"])]})

    return packed.mapInPandas(order, "project_id string, node string, mro array<string>")


#: how a language picks among inherited methods (fixed values; others: first)
MRO_RULES = {"python": "c3", "cpp": "first", "java": "split", "kotlin": "split", "csharp": "split", "rust": "qualified"}


def ancestors(parents: dict[str, list[list[str]]], name: str, rule: str) -> list[tuple[str, bool]]:
    """Ancestors of a class in the order of its language (C3 where there is
    one, else by levels) and whether each is reached through an interface.
    ``parents`` gives [parent, edge type] in order."""
    seen: dict[str, bool] = {}
    level = [(p, t == "IMPLEMENTS") for p, t in parents.get(name, [])]
    while level:
        fresh = []
        for p, iface in level:
            if p != name and p not in seen:
                seen[p] = iface
                fresh += [(q, iface or t == "IMPLEMENTS") for q, t in parents.get(p, [])]
        level = fresh
    order = c3({k: [p for p, _ in v] for k, v in parents.items()}, name) if rule == "c3" else None
    return [(p, seen[p]) for p in (order[1:] if order else seen)]


def overrides(heritage: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods that a class inherits from two or more ancestors and does not
    define itself -> OVERRIDES edge to the one its language picks.

    ``heritage`` (project_id, src, dst, type), ``classes`` (project_id, id,
    language), ``methods`` (project_id, class, name, id). Python goes by C3,
    others by levels, first definition .9; Java, Kotlin and C# take a class
    before interfaces (.95), else the only interface (.85); where nothing
    decides (several interfaces, Rust) target is null.
    """
    h = heritage.filter(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select("project_id", "src", "dst", "type").filter("src <> dst").distinct()
    up = cut(h.groupBy("project_id", F.col("src").alias("at")).agg(F.array_sort(F.collect_set(F.array("dst", "type"))).alias("parents")))
    every = cut(up.select("project_id", F.col("at").alias("node"), "at"))
    front = every
    while not front.isEmpty():
        nxt = front.join(up, ["project_id", "at"]).select("project_id", "node", F.explode("parents").alias("p")).select("project_id", "node", F.get("p", F.lit(0)).alias("at")).distinct()
        front = cut(nxt.join(every, ["project_id", "node", "at"], "left_anti"))
        every = every.union(front)
    packed = every.join(up, ["project_id", "at"]).groupBy("project_id", "node").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("at", "parents")))).alias("m"))
    packed = packed.join(classes.select("project_id", F.col("id").alias("node"), "language"), ["project_id", "node"]).filter("language IS NOT NULL")

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pid, n, m, lang in zip(f["project_id"], f["node"], f["m"], f["language"]):
                rule = MRO_RULES.get(lang, "first")
                out += [(pid, n, rule, i, a, iface) for i, (a, iface) in enumerate(ancestors(json.loads(m), n, rule))]
            yield pd.DataFrame(out, columns=["project_id", "node", "rule", "pos", "class", "iface"])

    line = packed.mapInPandas(order, "project_id string, node string, rule string, pos int, class string, iface boolean")
    own = methods.select("project_id", F.col("class").alias("node"), "name")
    defs = line.join(methods.select("project_id", "class", "name", F.col("id").alias("method")), ["project_id", "class"]).join(own, ["project_id", "node", "name"], "left_anti")
    first = lambda cond: F.min(F.when(cond, F.struct("pos", "method")))["method"]
    d = defs.groupBy("project_id", "node", "name", "rule").agg(
        F.countDistinct("method").alias("n"), first(F.lit(True)).alias("any"), first(~F.col("iface")).alias("klass"), F.count_if("iface").alias("ifaces"), first(F.col("iface")).alias("one"),
    ).filter("n > 1")
    split = F.col("rule") == "split"
    target = F.when(F.col("rule") == "qualified", F.lit(None)).when(split, F.coalesce("klass", F.when(F.col("ifaces") == 1, F.col("one")))).otherwise(F.col("any"))
    conf = F.when(F.col("rule") == "qualified", 0.5).when(split & F.col("klass").isNotNull(), 0.95).when(split & (F.col("ifaces") == 1), 0.85).when(split, 0.5).otherwise(0.9)
    return d.select("project_id", F.col("node").alias("src"), "name", target.alias("dst"), conf.alias("confidence"))
