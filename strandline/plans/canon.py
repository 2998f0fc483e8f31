"""Canonical tables of the graph model over the project tables.

edges       relation facts between files, one row per fact delivered
nodes       symbols, one row per (project_id, id)
file_change one row per (project_id, commit_hash, file_path)
changed_in / authored: symbol = part, commit = order, author = customer
The SQL twins in ``CTE`` are for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table

FILE_OF = r"^[A-Za-z]+:([^:]+):.*$"


def file_id(c: str) -> Column:
    return F.concat(F.lit("File:"), F.regexp_extract(c, FILE_OF, 1))


def facts(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """Relation facts on file level, each delivered fact once. ``keep`` filters
    the rows as delivered, so it reaches the scan; repeats carry the same facts,
    so it is the same as filtering afterwards."""
    r = table(spark, d, "relation_updates").select(
        "project_id", "update_id", file_id("source_id").alias("src"), file_id("target_id").alias("dst"), F.col("rel_type").alias("type"),
        "confidence", "reason", "valid_from", "valid_to", "txn_from", "txn_to",
    )
    return keep(r).distinct()


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """Ends, type and valid time of the facts as delivered, for plans to which
    a repeat makes no difference."""
    return table(spark, d, "relation_updates").select("project_id", file_id("source_id").alias("src"), file_id("target_id").alias("dst"), F.col("rel_type").alias("type"), "valid_from", "valid_to")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Open and believed edges, one per (project, src, dst, type)."""
    r = table(spark, d, "relation_updates").filter("valid_to IS NULL AND txn_to IS NULL")
    f = r.select("project_id", file_id("source_id").alias("src"), file_id("target_id").alias("dst"), F.col("rel_type").alias("type"), "confidence", "reason")
    # a repeat changes neither maximum nor minimum
    return f.groupBy("project_id", "src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.min("reason").alias("reason"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "parsed_nodes")
    return n.groupBy("project_id", F.col("node_id").alias("id")).agg(
        F.min("node_label").alias("type"), F.min("name").alias("name"), F.min("file_path").alias("file_path"), F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"), F.bool_or("is_exported").alias("is_exported"), F.max("description").alias("description"),
        F.max("parameter_count").alias("parameter_count"),
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "change_sets").dropDuplicates(["change_set_id"])
    return c.select("project_id", F.col("to_commit").alias("hash"), F.col("commit_ts").alias("ts"), "modified", "added", "deleted")


def file_change(spark: SparkSession, d: str) -> DataFrame:
    """Explodes change sets; a path listed twice, or in two writings, in a
    commit counts once."""
    c = commits(spark, d)
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce("modified", empty), F.coalesce("added", empty))
    clean = F.array_distinct(F.transform(F.filter(both, lambda p: p.isNotNull()), lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^\./", "")))
    return c.select("project_id", F.col("hash").alias("commit_hash"), "ts", F.explode(clean).alias("file_path"))


def changed_in(spark: SparkSession, d: str, node: str = "p_brand") -> DataFrame:
    """(node, commit_hash, author, ts): a part column as node, the order as
    commit, the customer as author."""
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    p = p.select("p_partkey", F.col(node).cast("string").alias("node"))
    # an order is one commit: pairs are made distinct before its columns come in
    pair = li.select("l_partkey", "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("node", "l_orderkey").distinct()
    o = o.select("o_orderkey", "o_custkey", "o_orderdate")
    return pair.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("node", F.col("l_orderkey").alias("commit_hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


_CLEAN = r"regexp_replace(replace(p, '\', '/'), '^\./', '')"
CTE = {
    "facts": r"""facts AS (SELECT project_id, update_id, 'File:' || regexp_extract(source_id, '^[A-Za-z]+:([^:]+):.*$', 1) AS src,
        'File:' || regexp_extract(target_id, '^[A-Za-z]+:([^:]+):.*$', 1) AS dst, rel_type AS type, confidence, reason, valid_from, valid_to, txn_from, txn_to
        FROM (SELECT DISTINCT ON (update_id) * FROM relation_updates))""",
    "edges": """edges AS (SELECT project_id, src, dst, type, max(confidence) AS confidence, min(reason) AS reason FROM facts
        WHERE valid_to IS NULL AND txn_to IS NULL GROUP BY 1, 2, 3, 4)""",
    "nodes": """nodes AS (SELECT project_id, node_id AS id, min(node_label) AS type, min(name) AS name, min(file_path) AS file_path, min(start_line) AS start_line,
        max(end_line) AS end_line, bool_or(is_exported) AS is_exported, max(description) AS description, max(parameter_count) AS parameter_count FROM parsed_nodes GROUP BY 1, 2)""",
    "commits": "commits AS (SELECT DISTINCT ON (change_set_id) project_id, to_commit AS hash, commit_ts AS ts, modified, added, deleted FROM change_sets)",
    "file_change": f"""file_change AS (SELECT DISTINCT project_id, commit_hash, ts, {_CLEAN} AS file_path FROM (SELECT project_id, hash AS commit_hash, ts,
        unnest(list_concat(coalesce(modified, []), coalesce(added, []))) AS p FROM commits) WHERE p IS NOT NULL)""",
    "changed_in": """changed_in AS (SELECT DISTINCT p_brand AS node, l_orderkey AS commit_hash, o_custkey AS author, o_orderdate AS ts
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
}
_NEEDS = {"edges": ["facts"], "file_change": ["commits"]}


def with_(*names: str) -> str:
    """WITH clause of the named tables and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in order) + "\n"
