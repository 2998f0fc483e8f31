"""Graph, impact and API queries on file-level relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..operators import graph as G
from . import canon
from .canon import with_
from .registry import Registry

R = Registry()
_E = with_("facts", "edges")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return canon.edges(spark, d)


def _file_nodes(e: DataFrame) -> DataFrame:
    return e.select("project_id", F.col("src").alias("id")).union(e.select("project_id", "dst")).distinct()


@R.add("context", _E + "SELECT project_id, src AS node, 'out' AS direction, dst AS other, type FROM edges UNION ALL SELECT project_id, dst, 'in', src, type FROM edges")
def context(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(_edges(spark, d))


@R.add("degree", _E + "SELECT project_id, node, count(*) FILTER (WHERE o) AS out_degree, count(*) FILTER (WHERE NOT o) AS in_degree FROM (SELECT project_id, src AS node, true AS o FROM edges UNION ALL SELECT project_id, dst, false FROM edges) GROUP BY 1, 2")
def degree(spark: SparkSession, d: str) -> DataFrame:
    n = G.neighbours(_edges(spark, d))
    return n.groupBy("project_id", "node").agg(F.count_if(F.col("direction") == "out").alias("out_degree"), F.count_if(F.col("direction") == "in").alias("in_degree"))


_T = "('CALLS','IMPORTS','USES','EXTENDS','IMPLEMENTS','OVERRIDES')"
_SEED = "seeds AS (SELECT project_id, min({c}) AS node FROM edges GROUP BY 1)"


def _bfs_sql(frm: str, to: str, depth: int, seed: str) -> str:
    return (
        _E + ", " + _SEED.format(c=seed) + f", e AS (SELECT DISTINCT project_id, {frm} AS node, {to} AS nxt FROM edges WHERE type IN {_T}), "
        f"b AS (SELECT project_id, node, 0 AS depth FROM seeds UNION SELECT b.project_id, e.nxt, b.depth + 1 FROM b JOIN e ON e.project_id = b.project_id AND e.node = b.node WHERE b.depth < {depth}), "
        "r AS (SELECT project_id, node, min(depth) AS depth FROM b GROUP BY 1, 2) "
    )


def _impact(spark: SparkSession, d: str, direction: str, depth: int = 3) -> DataFrame:
    e = _edges(spark, d)
    seeds = e.groupBy("project_id").agg(F.min("dst" if direction == "upstream" else "src").alias("node"))
    return G.bfs(e, seeds, depth, direction)


@R.add("impact_upstream", _bfs_sql("dst", "src", 3, "dst") + "SELECT * FROM r")
def impact_upstream(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "upstream")


@R.add("impact_downstream", _bfs_sql("src", "dst", 3, "src") + "SELECT * FROM r")
def impact_downstream(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "downstream")


@R.add("impact_risk", _bfs_sql("dst", "src", 3, "dst") + "SELECT project_id, count(*) FILTER (WHERE depth > 0) AS affected, count(*) FILTER (WHERE depth = 1) AS direct, CASE WHEN count(*) FILTER (WHERE depth > 0) >= 10 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE depth > 0) >= 5 THEN 'HIGH' WHEN count(*) FILTER (WHERE depth > 0) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r GROUP BY 1")
def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    r = _impact(spark, d, "upstream")
    g = r.groupBy("project_id").agg(F.count_if(F.col("depth") > 0).alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"))
    return g.withColumn("risk", G.risk(F.col("affected")))


@R.add(
    "combined_impact",
    _bfs_sql("dst", "src", 3, "dst") + ", c AS (SELECT DISTINCT e.project_id, e.dst AS node FROM edges e JOIN r ON r.project_id = e.project_id AND r.node = e.src WHERE e.type = 'DESCRIBES') "
    "SELECT project_id, node, CASE WHEN s AND c THEN 'high_risk' WHEN s THEN 'structural' ELSE 'hidden' END AS kind FROM (SELECT coalesce(r.project_id, c.project_id) AS project_id, coalesce(r.node, c.node) AS node, r.node IS NOT NULL AS s, c.node IS NOT NULL AS c FROM r FULL JOIN c ON r.project_id = c.project_id AND r.node = c.node)",
)
def combined_impact(spark: SparkSession, d: str) -> DataFrame:
    """Structural reach and historically coupled nodes, by set operations."""
    e = _edges(spark, d)
    s = _impact(spark, d, "upstream").select("project_id", "node")
    c = e.filter("type = 'DESCRIBES'").join(s.withColumnRenamed("node", "src"), ["project_id", "src"]).select("project_id", F.col("dst").alias("node")).distinct()
    j = s.withColumn("s", F.lit(True)).join(c.withColumn("c", F.lit(True)), ["project_id", "node"], "full")
    return j.select("project_id", "node", F.when(F.col("s") & F.col("c"), "high_risk").when(F.col("s"), "structural").otherwise("hidden").alias("kind"))


@R.add(
    "reverse_dependencies",
    _E + ", ch AS (SELECT project_id, min(dst) AS node FROM edges WHERE type = 'IMPORTS' GROUP BY 1), i1 AS (SELECT DISTINCT e.project_id, e.src AS node FROM edges e JOIN ch ON ch.project_id = e.project_id AND ch.node = e.dst WHERE type = 'IMPORTS'), "
    "i2 AS (SELECT DISTINCT e.project_id, e.src AS node FROM edges e JOIN i1 ON i1.project_id = e.project_id AND i1.node = e.dst WHERE type = 'IMPORTS'), "
    "c1 AS (SELECT DISTINCT e.project_id, e.src AS node FROM edges e JOIN ch ON ch.project_id = e.project_id AND ch.node = e.dst WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS')) "
    "SELECT * FROM (SELECT * FROM i1 UNION SELECT * FROM i2 UNION SELECT * FROM c1) EXCEPT SELECT * FROM ch",
)
def reverse_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Files that import the changed ones in two hops, or call or extend them."""
    e = _edges(spark, d)
    ch = e.filter("type = 'IMPORTS'").groupBy("project_id").agg(F.min("dst").alias("node"))
    imp = G.bfs(e, ch, 2, types=("IMPORTS",)).filter("depth > 0").select("project_id", "node")
    call = G.bfs(e, ch, 1, types=("CALLS", "EXTENDS", "IMPLEMENTS")).filter("depth > 0").select("project_id", "node")
    return imp.union(call).distinct().join(ch, ["project_id", "node"], "left_anti")


@R.add("detect_changes", _E + ", ch AS (SELECT project_id, min(dst) AS node FROM edges GROUP BY 1), dep AS (SELECT DISTINCT e.project_id, e.src AS node FROM edges e JOIN ch ON ch.project_id = e.project_id AND ch.node = e.dst) SELECT project_id, count(*) AS dependents, CASE WHEN count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM dep GROUP BY 1")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    """Inbound dependents of the changed files and their risk."""
    e = _edges(spark, d)
    ch = e.groupBy("project_id").agg(F.min("dst").alias("dst"))
    n = e.join(ch, ["project_id", "dst"], "left_semi").select("project_id", "src").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("dependents"))
    return n.withColumn("risk", F.when(F.col("dependents") >= 10, "HIGH").when(F.col("dependents") >= 5, "MEDIUM").otherwise("LOW"))


@R.add("rename_plan", _E + ", t AS (SELECT project_id, min(src) AS node FROM edges GROUP BY 1) SELECT project_id, file FROM (SELECT t.project_id, e.src AS file FROM edges e JOIN t ON e.project_id = t.project_id AND e.dst = t.node UNION SELECT t.project_id, e.dst FROM edges e JOIN t ON e.project_id = t.project_id AND e.src = t.node UNION SELECT project_id, node FROM t)")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """Files an edit of a symbol's name touches: its own and its neighbours'."""
    e = _edges(spark, d)
    t = e.groupBy("project_id").agg(F.min("src").alias("node"))
    n = G.neighbours(e).join(t, ["project_id", "node"], "left_semi").select("project_id", F.col("other").alias("file"))
    return n.union(t).distinct()


@R.add("list_dependencies", _E + ", i AS (SELECT project_id, split_part(replace(dst, 'File:', ''), '/', 1) || '/' || split_part(replace(dst, 'File:', ''), '/', 2) AS module, src FROM edges WHERE type = 'IMPORTS') SELECT project_id, module, count(*) AS imports, count(DISTINCT src) AS consumers FROM i GROUP BY 1, 2")
def list_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Internal modules (first two path segments) by imports and consumers."""
    p = F.regexp_replace("dst", "^File:", "")
    i = _edges(spark, d).filter("type = 'IMPORTS'").withColumn("module", F.concat_ws("/", F.split_part(p, F.lit("/"), F.lit(1)), F.split_part(p, F.lit("/"), F.lit(2))))
    return i.groupBy("project_id", "module").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("src").alias("consumers"))


@R.add("route_map", _E + "SELECT project_id, dst AS route, count(DISTINCT src) AS consumers, string_agg(DISTINCT src, ',' ORDER BY src) AS consumer_list FROM edges WHERE type = 'FETCHES' GROUP BY 1, 2")
def route_map(spark: SparkSession, d: str) -> DataFrame:
    f = _edges(spark, d).filter("type = 'FETCHES'")
    return f.groupBy("project_id", F.col("dst").alias("route")).agg(F.countDistinct("src").alias("consumers"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("consumer_list"))


_KEYS = """sf AS (SELECT DISTINCT ON (file_id) * FROM source_files),
k AS (SELECT project_id, file_id, unnest(regexp_extract_all(content, '\\{ (\\w+): \\d+, kind:', 1)) AS key FROM sf),
rk AS (SELECT project_id, key, min(file_id) AS owner FROM k GROUP BY 1, 2)"""


@R.add(
    "shape_check",
    "WITH " + _KEYS + ", f AS (SELECT DISTINCT project_id, file_id, key FROM k), g AS (SELECT project_id, file_id, key FROM f WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.project_id = f.project_id AND rk.key = f.key AND rk.owner = f.file_id)) "
    "SELECT project_id, file_id, count(*) AS mismatches, string_agg(key, ',' ORDER BY key) AS missing FROM g GROUP BY 1, 2",
)
def shape_check(spark: SparkSession, d: str) -> DataFrame:
    """Keys a consumer reads that its provider does not answer. Keys come from
    object literals; the first file of a project that writes a key owns it."""
    s = table(spark, d, "source_files").dropDuplicates(["file_id"]).select("project_id", "file_id", "content")
    k = s.select("project_id", "file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\{ (\w+): \d+, kind:"), 1))).alias("key"))
    own = k.groupBy("project_id", "key").agg(F.min("file_id").alias("file_id"))
    g = k.join(own, ["project_id", "key", "file_id"], "left_anti")
    return g.groupBy("project_id", "file_id").agg(F.count(F.lit(1)).alias("mismatches"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("missing"))


@R.add(
    "api_impact",
    _E + ", c AS (SELECT project_id, dst AS route, count(DISTINCT src) AS consumers, count(*) FILTER (WHERE confidence < 0.8) AS mismatches FROM edges WHERE type = 'FETCHES' GROUP BY 1, 2) "
    "SELECT *, CASE WHEN consumers >= 10 OR (mismatches >= 4 AND consumers >= 4) THEN 'HIGH' WHEN consumers >= 4 OR mismatches > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c",
)
def api_impact(spark: SparkSession, d: str) -> DataFrame:
    c = _edges(spark, d).filter("type = 'FETCHES'").groupBy("project_id", F.col("dst").alias("route")).agg(F.countDistinct("src").alias("consumers"), F.count_if(F.col("confidence") < 0.8).alias("mismatches"))
    high = (F.col("consumers") >= 10) | ((F.col("mismatches") >= 4) & (F.col("consumers") >= 4))
    return c.withColumn("risk", F.when(high, "HIGH").when((F.col("consumers") >= 4) | (F.col("mismatches") > 0), "MEDIUM").otherwise("LOW"))


@R.add("fetch_reason_keys", "SELECT update_id, string_split(regexp_extract('fetch-url-match|keys:' || rel_type || ',' || coalesce(reason, 'none') || '|fetches:' || CAST(update_id % 7 AS VARCHAR), 'keys:([^|]*)', 1), ',') AS keys, CAST(regexp_extract('x|fetches:' || CAST(update_id % 7 AS VARCHAR), 'fetches:(\\d+)', 1) AS INTEGER) AS fetches FROM (SELECT DISTINCT ON (update_id) * FROM relation_updates)")
def fetch_reason_keys(spark: SparkSession, d: str) -> DataFrame:
    """Accessed keys and fetch count parsed from the edge's reason text."""
    r = table(spark, d, "relation_updates").dropDuplicates(["update_id"])
    text = F.concat(F.lit("fetch-url-match|keys:"), F.col("rel_type"), F.lit(","), F.coalesce("reason", F.lit("none")), F.lit("|fetches:"), (F.col("update_id") % 7).cast("string"))
    return r.select("update_id", F.split(F.regexp_extract(text, r"keys:([^|]*)", 1), ",").alias("keys"), F.regexp_extract(text, r"fetches:(\d+)", 1).cast("int").alias("fetches"))


@R.add("components", _E + ", b AS (SELECT DISTINCT project_id, src AS a, dst AS b FROM edges WHERE type = 'EXTENDS' AND src <> dst UNION SELECT DISTINCT project_id, dst, src FROM edges WHERE type = 'EXTENDS' AND src <> dst), w AS (SELECT project_id, a AS node, a AS reach FROM b UNION SELECT w.project_id, w.node, b.b FROM w JOIN b ON b.project_id = w.project_id AND b.a = w.reach) SELECT project_id, node, min(reach) AS component FROM w GROUP BY 1, 2")
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_edges(spark, d).filter("type = 'EXTENDS'"))


_LP_E = _E + ", u AS (SELECT DISTINCT project_id, src AS a, dst AS b FROM edges WHERE type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS') AND src <> dst), g AS (SELECT * FROM u UNION SELECT project_id, b, a FROM u), l0 AS (SELECT DISTINCT project_id, a AS node, a AS label FROM g)"


def _label_sql(rounds: int) -> str:
    """Label propagation unrolled: the most frequent label of a node and its
    neighbours, the smaller one of equals."""
    out = _LP_E
    for i in range(1, rounds + 1):
        out += (
            f", v{i} AS (SELECT project_id, node, label, count(*) AS n FROM (SELECT g.project_id, g.a AS node, l.label FROM g JOIN l{i - 1} l ON l.project_id = g.project_id AND l.node = g.b UNION ALL SELECT * FROM l{i - 1}) GROUP BY 1, 2, 3), "
            f"l{i} AS (SELECT project_id, node, label FROM v{i} QUALIFY row_number() OVER (PARTITION BY project_id, node ORDER BY n DESC, label) = 1)"
        )
    return out


@R.add("communities", _label_sql(5) + " SELECT project_id, node, label AS community FROM l5")
def communities(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_edges(spark, d).filter("type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS')"))


@R.add(
    "community_cohesion",
    _label_sql(5) + ", e AS (SELECT u.project_id, x.label AS ca, y.label AS cb FROM u JOIN l5 x ON x.project_id = u.project_id AND x.node = u.a JOIN l5 y ON y.project_id = u.project_id AND y.node = u.b), "
    "s AS (SELECT project_id, community, round(avg(CASE WHEN inside THEN 1.0::DOUBLE ELSE 0 END), 6) AS cohesion FROM (SELECT project_id, ca AS community, ca = cb AS inside FROM e UNION ALL SELECT project_id, cb, ca = cb FROM e) GROUP BY 1, 2), "
    "m AS (SELECT project_id, label AS community, count(*) AS members FROM l5 GROUP BY 1, 2) SELECT m.project_id, m.community, members, coalesce(cohesion, 0.0) AS cohesion FROM m LEFT JOIN s ON s.project_id = m.project_id AND s.community = m.community WHERE members > 1",
)
def community_cohesion(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).filter("type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS')")
    return G.cohesion(G.label_propagation(e), e)


@R.add(
    "topological_levels",
    _E + ", e AS (SELECT DISTINCT project_id, src, dst FROM edges WHERE type = 'IMPORTS' AND src <> dst), n AS (SELECT project_id, src AS node FROM e UNION SELECT project_id, dst FROM e), "
    "w AS (SELECT project_id, src AS node, dst AS reach FROM e UNION SELECT w.project_id, w.node, e.dst FROM w JOIN e ON e.project_id = w.project_id AND e.src = w.reach), "
    "c AS (SELECT DISTINCT project_id, node FROM w WHERE node = reach), bad AS (SELECT * FROM c UNION SELECT w.project_id, w.reach FROM w JOIN c ON c.project_id = w.project_id AND c.node = w.node), "
    "ok AS (SELECT * FROM n EXCEPT SELECT * FROM bad), d AS (SELECT project_id, node, 0 AS level FROM ok UNION SELECT d.project_id, e.dst, d.level + 1 FROM d JOIN e ON e.project_id = d.project_id AND e.src = d.node JOIN ok ON ok.project_id = e.project_id AND ok.node = e.dst) "
    "SELECT project_id, node, max(level) AS level FROM d GROUP BY 1, 2 UNION ALL SELECT project_id, node, -1 FROM bad",
)
def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.topological_levels(_edges(spark, d).filter("type = 'IMPORTS'"))


@R.add("entry_points", _E + ", c AS (SELECT project_id, node, count(*) FILTER (WHERE o) AS calls, count(*) FILTER (WHERE NOT o) AS callers FROM (SELECT project_id, src AS node, true AS o FROM edges WHERE type = 'CALLS' UNION ALL SELECT project_id, dst, false FROM edges WHERE type = 'CALLS') GROUP BY 1, 2) SELECT project_id, node, round(calls / (callers + 1.0) * CASE WHEN regexp_matches(node, '(handler|worker|server)') THEN 1.5 ELSE 1.0 END, 6) AS score FROM c WHERE calls > 0")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    n = G.neighbours(_edges(spark, d).filter("type = 'CALLS'"))
    c = n.groupBy("project_id", "node").agg(F.count_if(F.col("direction") == "out").alias("calls"), F.count_if(F.col("direction") == "in").alias("callers")).filter("calls > 0")
    named = F.when(F.col("node").rlike("(handler|worker|server)"), 1.5).otherwise(1.0)
    return c.select("project_id", "node", F.round(F.col("calls") / (F.col("callers") + 1.0) * named, 6).alias("score"))


_TRACE = (
    ", c AS (SELECT project_id, src, dst, max(confidence) AS confidence FROM edges WHERE type = 'CALLS' AND confidence >= 0.5 AND src <> dst GROUP BY 1, 2, 3), "
    "e AS (SELECT project_id, src, dst FROM c QUALIFY row_number() OVER (PARTITION BY project_id, src ORDER BY confidence DESC, dst) <= 4), "
    "en AS (SELECT project_id, src AS node FROM edges WHERE type = 'CALLS' EXCEPT SELECT project_id, dst FROM edges WHERE type = 'CALLS'), "
    "p AS (SELECT project_id, node AS entry, [node] AS path FROM en UNION ALL SELECT p.project_id, p.entry, list_append(p.path, e.dst) FROM p JOIN e ON e.project_id = p.project_id AND e.src = p.path[-1] WHERE len(p.path) < 10 AND NOT list_contains(p.path, e.dst)), "
    "q AS (SELECT *, '|' || array_to_string(path, '|') || '|' AS s FROM p WHERE len(path) >= 3), "
    "r AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q l WHERE l.project_id = q.project_id AND len(l.path) > len(q.path) AND contains(l.s, q.s))), "
    "b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY project_id, entry, path[-1] ORDER BY len(path) DESC, path) = 1), "
    "t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY project_id, entry ORDER BY len(path) DESC, path) <= 12) "
)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    s = e.filter("type = 'CALLS'")
    entries = s.select("project_id", F.col("src").alias("node")).distinct().join(s.select("project_id", F.col("dst").alias("node")), ["project_id", "node"], "left_anti")
    return G.traces(e, entries)


@R.add("process_traces", _E + _TRACE + "SELECT project_id, entry, array_to_string(path, ' > ') AS trace, len(path) AS steps FROM t")
def process_traces(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d)
    return t.select("project_id", "entry", F.array_join("path", " > ").alias("trace"), F.size("path").alias("steps"))


@R.add(
    "process_steps",
    _label_sql(5) + _TRACE + ", s AS (SELECT project_id, entry, array_to_string(path, ' > ') AS trace, unnest(path) AS node, generate_subscripts(path, 1) AS step FROM t), "
    "m AS (SELECT s.*, l5.label FROM s LEFT JOIN l5 ON l5.project_id = s.project_id AND l5.node = s.node), k AS (SELECT project_id, trace, count(DISTINCT label) AS n FROM m GROUP BY 1, 2) "
    "SELECT m.project_id, entry, m.trace, node, step, CASE WHEN n > 1 THEN 'cross_community' ELSE 'intra_community' END AS process_type FROM m JOIN k ON k.project_id = m.project_id AND k.trace = m.trace",
)
def process_steps(spark: SparkSession, d: str) -> DataFrame:
    members = G.label_propagation(_edges(spark, d).filter("type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS')"))
    return G.process_steps(_traces(spark, d), members)


_SYM = (
    ", s AS (SELECT DISTINCT project_id, source_id AS src, target_id AS dst FROM relation_updates WHERE rel_type = 'CALLS' AND valid_to IS NULL AND txn_to IS NULL), "
    "c AS (SELECT project_id, node, count(*) FILTER (WHERE o) AS calls, count(*) FILTER (WHERE NOT o) AS callers FROM (SELECT project_id, src AS node, true AS o FROM s UNION ALL SELECT project_id, dst, false FROM s) GROUP BY 1, 2), "
    "x AS (SELECT c.*, regexp_extract(node, '([^:]+)$', 1) AS name, coalesce(n.is_exported, false) AS exported FROM c LEFT JOIN nodes n ON n.project_id = c.project_id AND n.id = c.node WHERE calls > 0) "
)


@R.add(
    "symbol_entry_points",
    with_("nodes") + _SYM + f"SELECT project_id, node, round(calls / (callers + 1.0) * CASE WHEN exported THEN 2.0 ELSE 1.0 END * CASE WHEN regexp_matches(name, '{G.HELPER}') THEN 0.3 WHEN regexp_matches(name, '{G.ENTRY}') THEN 1.5 ELSE 1.0 END, 6) AS score FROM x",
)
def symbol_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by how much they look like entry points."""
    r = table(spark, d, "relation_updates").filter("rel_type = 'CALLS' AND valid_to IS NULL AND txn_to IS NULL").select("project_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit("CALLS").alias("type")).distinct()
    c = G.neighbours(r).groupBy("project_id", "node").agg(F.count_if(F.col("direction") == "out").alias("calls"), F.count_if(F.col("direction") == "in").alias("callers")).filter("calls > 0")
    j = c.join(canon.nodes(spark, d).select("project_id", F.col("id").alias("node"), "is_exported"), ["project_id", "node"], "left")
    return j.select("project_id", "node", G.entry_score(F.col("calls"), F.col("callers"), F.regexp_extract("node", "([^:]+)$", 1), F.coalesce("is_exported", F.lit(False))).alias("score"))


@R.add("method_resolution")
def method_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = G.method_resolution(_edges(spark, d))
    return m.select("project_id", "node", F.array_join("mro", ",").alias("mro"), F.col("mro").isNull().alias("ambiguous"))


_REN = "o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders), r AS (SELECT o_custkey AS project, old, o_orderkey AS new FROM o WHERE old IS NOT NULL)"


@R.add("symbol_lineage", "WITH RECURSIVE " + _REN + ", c AS (SELECT project, old AS start, new AS current, 1 AS hops FROM r UNION ALL SELECT c.project, c.start, r.new, c.hops + 1 FROM c JOIN r ON r.project = c.project AND r.old = c.current WHERE c.hops < 10) SELECT * FROM c")
def symbol_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Rename chains (consecutive orders of a customer), up to ten hops."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.lag("o_orderkey").over(w).alias("old"), F.col("o_orderkey").alias("new")).filter("old IS NOT NULL")
    return G.rename_chain(r)


@R.add(
    "architecture_drift",
    "WITH a AS (SELECT p_brand AS set, p_partkey AS member FROM part), b AS (SELECT p_type AS other, p_partkey AS member FROM part), na AS (SELECT set, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT other, count(*) AS nb FROM b GROUP BY 1), "
    "x AS (SELECT set, other, count(*) AS n FROM a JOIN b USING (member) GROUP BY 1, 2) SELECT set, round(max(n / (na + nb - n)), 6) AS best FROM x JOIN na USING (set) JOIN nb USING (other) GROUP BY 1",
)
def architecture_drift(spark: SparkSession, d: str) -> DataFrame:
    """Best overlap of each module with any cluster of co-changing nodes."""
    p = table(spark, d, "part")
    return G.best_jaccard(p.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("member")), p.select(F.col("p_type").alias("set"), F.col("p_partkey").alias("member")))
