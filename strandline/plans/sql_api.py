"""Read-only SQL over the canonical views, and named query templates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import bfs

from . import canon

_WRITE = re.compile(r"(?is)^\s*(?:insert|update|delete|merge|create|drop|alter|truncate|load|refresh|cache|uncache|set|reset|add|analyze|replace|call)\b")

#: templates with named parameters (:name)
TEMPLATES = {
    "node_by_id": "SELECT * FROM nodes WHERE project_id = :project AND id = :id",
    "nodes_by_name": "SELECT * FROM nodes WHERE project_id = :project AND name = :name",
    "nodes_by_type": "SELECT * FROM nodes WHERE project_id = :project AND type = :type",
    "nodes_in_file": "SELECT * FROM nodes WHERE project_id = :project AND contains(file_path, :file)",
    "nodes_under": "SELECT * FROM nodes WHERE project_id = :project AND startswith(file_path, :prefix)",
    "callers": "SELECT src FROM edges WHERE project_id = :project AND dst = :id AND type = 'CALLS'",
    "callees": "SELECT dst FROM edges WHERE project_id = :project AND src = :id AND type = 'CALLS'",
    "importers": "SELECT src FROM edges WHERE project_id = :project AND dst = :id AND type = 'IMPORTS'",
    "edges_by_type": "SELECT * FROM edges WHERE project_id = :project AND type = :type",
    "count_by_type": "SELECT type, count(*) AS n FROM nodes WHERE project_id = :project GROUP BY type",
    "changes_of_file": "SELECT commit_hash, ts FROM file_change WHERE project_id = :project AND file_path = :file",
    "project_size": "SELECT count(*) AS n FROM nodes WHERE project_id = :project",
    "reach": "breadth-first from :id in :project, at most :depth levels",
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("facts", "edges", "nodes", "commits", "file_change", "changed_in"):
        getattr(canon, name)(spark, sf_dir).createOrReplaceTempView(name)


def read_only(sql: str) -> bool:
    """A single query that writes nothing."""
    body = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    return ";" not in re.sub(r"'(?:[^']|'')*'", "", body) and not _WRITE.match(body) and bool(re.match(r"(?is)\s*(?:select|with|values|from|table)\b", body))


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    if not read_only(sql):
        raise ValueError("only a single read-only query is allowed")
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def safe_query(spark: SparkSession, template: str, **args: object) -> DataFrame:
    """A named template with parameters; depth must be 1 to 10."""
    if template not in TEMPLATES:
        raise KeyError(f"unknown template {template}; there are {sorted(TEMPLATES)}")
    need = set(re.findall(r":(\w+)", TEMPLATES[template]))
    if need - set(args):
        raise ValueError(f"missing parameters {sorted(need - set(args))}")
    if "depth" in need and not 1 <= int(args["depth"]) <= 10:  # type: ignore[call-overload]
        raise ValueError("depth must be 1 to 10")
    if template == "reach":
        # by frontier, each node once; recursive SQL would list every walk
        e = spark.table("edges").filter(F.col("project_id") == args["project"])
        seed = spark.createDataFrame([(args["project"], args["id"])], "project_id string, node string")
        types = [r.type for r in e.select("type").distinct().collect()]  # edge types, a fixed catalogue
        return bfs(e, seed, int(args["depth"]), "downstream", tuple(types) or ("",)).select("node", "depth")  # type: ignore[call-overload]
    return spark.sql(TEMPLATES[template], args={k: args[k] for k in need})
