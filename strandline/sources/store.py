"""Graph store on parquet: upserts, deletes, search and vector rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], partition: str = "project_id") -> None:
    """Latest row wins per key; only the partitions of ``rows`` are rewritten
    (dynamic overwrite). The merged rows are checkpointed first, since they
    come from the files that are replaced."""
    new = rows.withColumn("__n", F.lit(1))
    try:
        old = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no store yet
        rows.dropDuplicates(key).write.partitionBy(partition).parquet(path)
        return
    touched = rows.select(partition).distinct()
    both = new.unionByName(old.join(touched, partition, "left_semi").withColumn("__n", F.lit(0)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*key, "__n")]
    # properties merge: a value of the new row, else the stored one
    best = both.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(c) for c in cols])
    cut(best).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete(spark: SparkSession, path: str, keys: DataFrame, on: list[str], partition: str = "project_id") -> None:
    """Removes the rows of the keys; untouched partitions stay as they are."""
    old = spark.read.parquet(path)
    touched = cut(old.join(keys, on, "left_semi").select(partition).distinct())
    left = cut(old.join(touched, partition, "left_semi").join(keys, on, "left_anti"))
    if touched.join(left.select(partition).distinct(), partition, "left_anti").isEmpty():
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    # a partition without rows can only be dropped by rewriting the table
    rest = cut(old.join(touched, partition, "left_anti").unionByName(left))
    rest.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(path)


def replace_type(spark: SparkSession, path: str, rows: DataFrame, typ: str, partition: str = "project_id") -> None:
    """Replaces all edges of a type in the projects of ``rows`` by them (as for
    co-change edges, which are computed anew); other types and projects stay.
    Without rows nothing is replaced."""
    rows = cut(rows)
    touched = rows.select(partition).distinct()
    if touched.isEmpty():
        return
    try:
        old = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no store yet
        rows.write.partitionBy(partition).parquet(path)
        return
    rest = old.join(touched, partition, "left_semi").filter(F.col("type") != typ)
    cut(rest.unionByName(rows, allowMissingColumns=True)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def orphans(nodes: DataFrame, edges: DataFrame, typ: str) -> DataFrame:
    """Nodes of a type that no edge of their project touches: what a cascade
    leaves behind (authors without files, commits without changes)."""
    used = edges.select("project_id", F.col("src").alias("id")).union(edges.select("project_id", "dst"))
    return nodes.filter(F.col("type") == typ).join(used, ["project_id", "id"], "left_anti")


def edges_with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes of the project."""
    ids = nodes.select("project_id", "id").distinct()
    a = edges.join(ids.withColumnRenamed("id", "src"), ["project_id", "src"], "left_semi")
    return a.join(ids.withColumnRenamed("id", "dst"), ["project_id", "dst"], "left_semi")


def search_rows(nodes: DataFrame, limit_chars: int = 5000) -> DataFrame:
    """Search documents of the symbol types that are indexed."""
    n = nodes.filter(F.col("type").isin("Function", "Class", "Method", "Interface", "File"))
    return n.select("project_id", "id", "name", F.substring(F.coalesce("description", F.lit("")), 1, limit_chars).alias("content"), "file_path", F.col("type").alias("node_type"))


def vector_id(c: str):
    """A node id as a UUID (by MD5), as vector stores need."""
    h = F.md5(c)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
