"""Tools, evolution facts, labels and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from . import canon
from .canon import with_
from .registry import Registry
from .retrieval_queries import _FRESH, entity_freshness

R = Registry()


@R.add("tool_map", with_("nodes") + "SELECT project_id, id, name, substring(description, 1, 200) AS description FROM nodes WHERE contains(lower(name), 'graph') AND description IS NOT NULL")
def tool_map(spark: SparkSession, d: str) -> DataFrame:
    n = canon.nodes(spark, d).filter(F.lower("name").contains("graph") & F.col("description").isNotNull())
    return n.select("project_id", "id", "name", F.substring("description", 1, 200).alias("description"))


@R.add("importance_gate", with_("file_change") + "SELECT project_id, file_path, count(DISTINCT commit_hash) AS commits FROM file_change GROUP BY 1, 2 HAVING count(DISTINCT commit_hash) > 10")
def importance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Files changed often enough for a story of their own."""
    f = canon.file_change(spark, d).groupBy("project_id", "file_path").agg(F.countDistinct("commit_hash").alias("commits"))
    return f.filter("commits > 10")


@R.add("narrative_refs", "WITH r AS (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(text, 'Refs: #(\\d+)', 1)) AS BIGINT) AS ref FROM documents) SELECT doc_id, ref FROM r WHERE NOT EXISTS (SELECT 1 FROM relation_updates u WHERE u.update_id = r.ref)")
def narrative_refs(spark: SparkSession, d: str) -> DataFrame:
    """References in texts that name nothing known (fabricated)."""
    r = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"Refs: #(\d+)"), 1)).alias("ref")).select("doc_id", F.col("ref").cast("bigint").alias("ref")).distinct()
    return r.join(table(spark, d, "relation_updates").select(F.col("update_id").alias("ref")), "ref", "left_anti").select("doc_id", "ref")


@R.add("auto_fix_preview", _FRESH + "SELECT entity_id, CASE state WHEN 'stale' THEN 'refresh' WHEN 'orphaned' THEN 'delete' ELSE 'bind' END AS action FROM st WHERE state <> 'fresh'")
def auto_fix_preview(spark: SparkSession, d: str) -> DataFrame:
    f = entity_freshness(spark, d).filter("state <> 'fresh'")
    return f.select("entity_id", F.when(F.col("state") == "stale", "refresh").when(F.col("state") == "orphaned", "delete").otherwise("bind").alias("action"))


@R.add("community_label", with_("nodes") + ", p AS (SELECT project_id, type, regexp_extract(file_path, '([^/]+)/[^/]+$', 1) AS folder FROM nodes), c AS (SELECT project_id, type, folder, count(*) AS n FROM p WHERE folder NOT IN ('', 'src', 'lib', 'test', 'packages') GROUP BY 1, 2, 3) SELECT project_id, type, folder AS label, n FROM c QUALIFY row_number() OVER (PARTITION BY project_id, type ORDER BY n DESC, folder) = 1")
def community_label(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent parent folder (generic ones left out) of a group."""
    p = canon.nodes(spark, d).withColumn("folder", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)).filter(~F.col("folder").isin("", "src", "lib", "test", "packages"))
    c = p.groupBy("project_id", "type", "folder").agg(F.count(F.lit(1)).alias("n"))
    b = c.groupBy("project_id", "type").agg(F.min(F.struct(-F.col("n"), "folder")).alias("b"))
    return b.select("project_id", "type", F.col("b.folder").alias("label"), (-F.col("b").getField("col1")).alias("n"))


@R.add("evolution_story", with_("facts") + "SELECT project_id, src AS node, count(*) AS facts, count(*) FILTER (WHERE valid_to IS NOT NULL) AS ended, count(*) FILTER (WHERE txn_to IS NOT NULL) AS withdrawn, count(DISTINCT dst) AS partners, min(valid_from) AS first_seen, max(valid_from) AS last_seen FROM facts GROUP BY 1, 2")
def evolution_story(spark: SparkSession, d: str) -> DataFrame:
    """The facts an evolution story of a node is told from."""
    return canon.facts(spark, d).groupBy("project_id", F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("valid_to").isNotNull()).alias("ended"), F.count_if(F.col("txn_to").isNotNull()).alias("withdrawn"),
        F.countDistinct("dst").alias("partners"), F.min("valid_from").alias("first_seen"), F.max("valid_from").alias("last_seen"),
    )


@R.add("orphan_projects", "SELECT DISTINCT project_id FROM documents WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT lower(trim(project_id)) FROM analysis_jobs WHERE project_id IS NOT NULL)")
def orphan_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects with texts but without an analysis: their collections can go."""
    j = table(spark, d, "analysis_jobs").select(F.lower(F.trim("project_id")).alias("project_id"))
    return table(spark, d, "documents").filter("project_id IS NOT NULL").select("project_id").distinct().join(j, "project_id", "left_anti")


@R.add("response_keys", "WITH sf AS (SELECT DISTINCT ON (file_id) * FROM source_files), k AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '\\{ (\\w+): \\d+, kind:', 1)) AS key FROM sf) SELECT file_id, string_agg(key, ',' ORDER BY key) AS keys, count(*) AS n FROM k GROUP BY 1")
def response_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_files").dropDuplicates(["file_id"])
    k = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\{ (\w+): \d+, kind:"), 1)))
    return s.select("file_id", k.alias("k")).filter(F.size("k") > 0).select("file_id", F.array_join("k", ",").alias("keys"), F.size("k").cast("bigint").alias("n"))
