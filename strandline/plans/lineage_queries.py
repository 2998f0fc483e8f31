"""Authors, renames, drift, couplings from history alone, derivation, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..io import table
from ..operators import authors as A
from ..operators import coupling as C
from ..operators import lineage as L
from . import canon, sql_api
from .canon import with_
from .registry import Registry

R = Registry()

_KEYED = r"""WITH RECURSIVE a AS (SELECT DISTINCT ON (record_id) * FROM author_records),
c AS (SELECT trim(name) AS name, email, commit_count, list_filter(regexp_split_to_array(regexp_replace(lower(CASE WHEN contains(name, '@') THEN split_part(name, '@', 1) ELSE name END), '[^a-z0-9\s-]', '', 'g'), '[\s-]+'), lambda x: x <> '') AS w,
  name AS raw FROM a),
k AS (SELECT name, email, commit_count, nullif(CASE WHEN coalesce(raw, '') <> '' THEN CASE WHEN len(w) = 0 THEN '' WHEN len(w) = 1 THEN w[1] ELSE w[1][1] || ' ' || CASE WHEN length(w[-1]) < 2 AND len(w) >= 3 THEN w[-2] ELSE w[-1] END END
  ELSE trim(regexp_replace(lower(split_part(email, '@', 1)), '[._-]', ' ', 'g')) END, '') AS key FROM c),
r AS (SELECT * FROM k WHERE key IS NOT NULL), m AS (SELECT DISTINCT key, email FROM r WHERE email IS NOT NULL AND email <> ''),
e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM m x JOIN m y ON x.email = y.email), ks AS (SELECT DISTINCT key FROM r),
w AS (SELECT key AS node, key AS reach FROM ks UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.reach),
g AS (SELECT node AS key, min(reach) AS author FROM w GROUP BY 1)
"""


@R.add("author_dedup", _KEYED + "SELECT author, coalesce(first(nullif(name, '') ORDER BY CASE WHEN nullif(name, '') IS NULL THEN 1 ELSE 0 END, length(name) DESC, name), author) AS canonical, count(DISTINCT nullif(name, '')) AS names, count(DISTINCT nullif(email, '')) AS emails, CAST(sum(commit_count) AS BIGINT) AS commits FROM r JOIN g ON g.key = r.key GROUP BY author")
def author_dedup(spark: SparkSession, d: str) -> DataFrame:
    return A.dedup(table(spark, d, "author_records").dropDuplicates(["record_id"]))


def _renames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.lag("o_orderkey").over(w).alias("old"), F.col("o_orderkey").alias("new")).filter("old IS NOT NULL")


@R.add(
    "rename_terminals",
    "WITH o AS (SELECT o_custkey AS project, o_orderkey AS start, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current, "
    "count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hops FROM orders) SELECT * FROM o WHERE hops > 0",
)
def rename_terminals(spark: SparkSession, d: str) -> DataFrame:
    """Where each chain of renames (orders of a customer) ends."""
    return L.rename_terminals(_renames(spark, d))


_OWN = (
    "WITH ch AS (SELECT DISTINCT p_brand AS module, l_partkey || '-' || l_suppkey AS node, l_orderkey AS c, o_orderpriority AS author FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), "
    "n AS (SELECT module, node, author, count(*) AS k FROM ch GROUP BY 1, 2, 3), o AS (SELECT module, node, author, round(k / sum(k) OVER (PARTITION BY module, node), 6) AS ownership FROM n), "
    "ma AS (SELECT module, author, count(DISTINCT node) AS nodes, max(ownership) AS ownership FROM o GROUP BY 1, 2)"
)


def _module_authors(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    ch = li.select("l_partkey", "l_suppkey", "l_orderkey").join(p.select("p_partkey", F.col("p_brand").alias("module")), F.col("l_partkey") == F.col("p_partkey")).join(o.select("o_orderkey", F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("ts")), F.col("l_orderkey") == F.col("o_orderkey"))
    ch = ch.select("module", F.concat_ws("-", "l_partkey", "l_suppkey").alias("node"), F.col("l_orderkey").alias("commit_hash"), "author", "ts").distinct()
    return L.module_authors(ch.select("module", "node").distinct(), C.ownership(ch))


@R.add("module_authors", _OWN + " SELECT * FROM ma")
def module_authors(spark: SparkSession, d: str) -> DataFrame:
    """Module - member - author, in two hops."""
    return _module_authors(spark, d)


@R.add(
    "bus_factor_modules",
    _OWN + ", s AS (SELECT * FROM ma WHERE ownership > 0.5), pr AS (SELECT module, author FROM s QUALIFY row_number() OVER (PARTITION BY module ORDER BY ownership DESC, author) = 1), ow AS (SELECT author, count(*) AS owned FROM pr GROUP BY 1), "
    "run AS (SELECT row_number() OVER (ORDER BY owned, author) AS rank, sum(owned) OVER (ORDER BY owned, author) AS orphaned FROM ow), m AS (SELECT count(*) AS modules FROM pr) "
    "SELECT CAST(CASE WHEN modules = 0 THEN -1 ELSE coalesce((SELECT min(rank) FROM run, m WHERE orphaned > floor(modules * 0.5)), (SELECT count(*) FROM ow)) END AS BIGINT) AS bus_factor, (SELECT count(*) FROM ow) AS authors, modules FROM m",
)
def bus_factor_modules(spark: SparkSession, d: str) -> DataFrame:
    return L.community_bus_factor(_module_authors(spark, d))


_FC = with_("file_change") + ", fc AS (SELECT * FROM file_change WHERE commit_hash IS NOT NULL)"
_PAIRS = ", p AS (SELECT a.project_id, a.file_path AS node_a, b.file_path AS node_b, count(*) AS co_changes FROM fc a JOIN fc b ON a.project_id = b.project_id AND a.commit_hash = b.commit_hash WHERE a.file_path < b.file_path GROUP BY 1, 2, 3)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Paths by commit; change sets without a commit name none."""
    return canon.file_change(spark, d).filter("commit_hash IS NOT NULL").select("project_id", "commit_hash", F.col("file_path").alias("node"))


@R.add("history_only", _FC + _PAIRS + ", n AS (SELECT project_id, file_path, count(DISTINCT commit_hash) AS n FROM fc GROUP BY 1, 2), t AS (SELECT project_id, count(DISTINCT commit_hash) AS t FROM fc GROUP BY 1) SELECT p.project_id, node_a, node_b, co_changes, round(co_changes / t, 8) AS support, round(co_changes / n, 8) AS confidence FROM p JOIN n ON n.project_id = p.project_id AND n.file_path = node_a JOIN t ON t.project_id = p.project_id")
def history_only(spark: SparkSession, d: str) -> DataFrame:
    return L.history_only(_changes(spark, d))


@R.add("analysis_level", "WITH f AS (SELECT project_id, count(DISTINCT file_path) AS files FROM source_files GROUP BY 1), j AS (SELECT lower(trim(project_id)) AS project_id, force_level FROM (SELECT DISTINCT ON (job_id) * FROM analysis_jobs) QUALIFY row_number() OVER (PARTITION BY lower(trim(project_id)) ORDER BY queued_at DESC, job_id DESC) = 1) SELECT f.project_id, files, coalesce(force_level, CASE WHEN files >= 100 THEN 'L0_GIT_LOG' ELSE 'L2_FULL' END) AS level FROM f LEFT JOIN j ON j.project_id = f.project_id")
def analysis_level(spark: SparkSession, d: str) -> DataFrame:
    """Forced level of the last job, else by the number of files (here 100)."""
    f = table(spark, d, "source_files").groupBy("project_id").agg(F.countDistinct("file_path").alias("files"))
    j = table(spark, d, "analysis_jobs").groupBy(F.lower(F.trim("project_id")).alias("project_id")).agg(F.max_by(F.struct("force_level"), F.struct("queued_at", "job_id")).alias("j"))
    return f.join(j, "project_id", "left").select("project_id", "files", L.analysis_level(F.col("files"), F.col("j.force_level"), 100).alias("level"))


_DRIFT = (
    _FC + _PAIRS + ", e AS (SELECT project_id, node_a AS a, node_b AS b FROM p WHERE co_changes >= 4), u AS (SELECT * FROM e UNION SELECT project_id, b, a FROM e), "
    "w AS (SELECT DISTINCT project_id, a AS node, a AS reach FROM u UNION SELECT w.project_id, w.node, u.b FROM w JOIN u ON u.project_id = w.project_id AND u.a = w.reach), k AS (SELECT project_id, node, min(reach) AS root FROM w GROUP BY 1, 2), "
    "m AS (SELECT DISTINCT project_id, file_path AS node, regexp_extract(file_path, '^([^/]+(?:/[^/]+)?)/', 1) AS community FROM fc), nm AS (SELECT project_id, community, count(*) AS n FROM m GROUP BY 1, 2), nk AS (SELECT project_id, root, count(*) AS n FROM k GROUP BY 1, 2), "
    "x AS (SELECT m.project_id, m.community, k.root, count(*) AS n FROM m JOIN k ON k.project_id = m.project_id AND k.node = m.node GROUP BY 1, 2, 3), "
    "j AS (SELECT x.project_id, x.community, round(max(x.n / (nm.n + nk.n - x.n)), 6) AS best FROM x JOIN nm ON nm.project_id = x.project_id AND nm.community = x.community JOIN nk ON nk.project_id = x.project_id AND nk.root = x.root GROUP BY 1, 2), "
    "r AS (SELECT nm.project_id, nm.community, coalesce(best, 0.0) AS best, coalesce(best, 0.0) < 0.5 AS drifted FROM nm LEFT JOIN j ON j.project_id = nm.project_id AND j.community = nm.community) "
)


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Folders against files that changed together at least four times."""
    ch = _changes(spark, d)
    members = ch.select("project_id", "node", F.regexp_extract("node", r"^([^/]+(?:/[^/]+)?)/", 1).alias("community")).distinct()
    return L.drift(members, C.pair_counts(ch, ["project_id"], min_count=4))


@R.add("drifted_communities", _DRIFT + "SELECT * FROM r")
def drifted_communities(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)[0]


@R.add("drift_divergence", _DRIFT + ", z AS (SELECT DISTINCT project_id FROM e) SELECT r.project_id, count(*) AS communities, count(*) FILTER (WHERE drifted) AS drifted, CASE WHEN any_value(z.project_id) IS NULL THEN -1.0::DOUBLE ELSE round(1 - avg(best), 6) END AS divergence FROM r LEFT JOIN z ON z.project_id = r.project_id GROUP BY 1")
def drift_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)[1]


@R.add("co_change_edges", _FC + _PAIRS + ", n AS (SELECT project_id, file_path, count(DISTINCT commit_hash) AS n FROM fc GROUP BY 1, 2), t AS (SELECT project_id, count(DISTINCT commit_hash) AS t FROM fc GROUP BY 1), "
    "m AS (SELECT p.project_id, node_a, node_b, co_changes, round(co_changes / t, 8) AS support, round(co_changes / a.n, 8) AS ab, round(co_changes / b.n, 8) AS ba, round(co_changes * t / (a.n * b.n), 8) AS lift FROM p JOIN n a ON a.project_id = p.project_id AND a.file_path = node_a JOIN n b ON b.project_id = p.project_id AND b.file_path = node_b JOIN t ON t.project_id = p.project_id WHERE co_changes >= 2) "
    "SELECT project_id, node_a AS src, node_b AS dst, 'CO_CHANGED_WITH' AS type, ab AS confidence, co_changes, support, lift FROM m UNION ALL SELECT project_id, node_b, node_a, 'CO_CHANGED_WITH', ba, co_changes, support, lift FROM m")  # fmt: skip
def co_change_edges(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of each coupled pair, as they are written to the store."""
    ch = _changes(spark, d)
    t = ch.groupBy("project_id").agg(F.countDistinct("commit_hash").alias("total"))
    return L.both_directions(C.coupling(C.pair_counts(ch, ["project_id"], min_count=2), ch, t, ["project_id"]))


@R.add("derived_entities", with_("nodes") + "SELECT project_id, 'auto-' || file_path || ':' || name AS entity_id, id AS code_id, sha256(type || ' ' || name || ' ' || coalesce(CAST(parameter_count AS VARCHAR), '')) AS signature FROM nodes n WHERE is_exported AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.project_id = n.project_id AND d.file_path = n.file_path)")
def derived_entities(spark: SparkSession, d: str) -> DataFrame:
    """Documentation entities for exported symbols that nobody described."""
    n = canon.nodes(spark, d).filter("is_exported").join(table(spark, d, "documents").select("project_id", "file_path"), ["project_id", "file_path"], "left_anti")
    sig = F.sha2(F.concat("type", F.lit(" "), "name", F.lit(" "), F.coalesce(F.col("parameter_count").cast("string"), F.lit(""))), 256)
    return n.select("project_id", F.concat(F.lit("auto-"), "file_path", F.lit(":"), "name").alias("entity_id"), F.col("id").alias("code_id"), sig.alias("signature"))


@R.add("ingest_plan", "WITH x AS (SELECT project_id, file_path, doc_id, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY project_id, file_path ORDER BY ingested_at, doc_id) AS before FROM documents WHERE project_id IS NOT NULL AND file_path IS NOT NULL) SELECT doc_id, CASE WHEN before IS NULL THEN 'ingest' WHEN before = h THEN 'skip' ELSE 'merge' END AS action FROM x")
def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    """A source whose text has the hash of the one before is skipped."""
    x = table(spark, d, "documents").filter("project_id IS NOT NULL AND file_path IS NOT NULL").select("project_id", "file_path", "doc_id", "ingested_at", F.sha2("text", 256).alias("h"))
    before = F.lag("h").over(Window.partitionBy("project_id", "file_path").orderBy("ingested_at", "doc_id"))
    return x.select("doc_id", F.when(before.isNull(), "ingest").when(before == F.col("h"), "skip").otherwise("merge").alias("action"))


@R.add("event_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


_HUB = "quillmoor-hub"


@R.add("template_count_by_type", with_("nodes") + f"SELECT type, count(*) AS n FROM nodes WHERE project_id = '{_HUB}' GROUP BY 1")
def template_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    sql_api.register_views(spark, d)
    return sql_api.safe_query(spark, "count_by_type", project=_HUB)


@R.add("template_nodes_under", with_("nodes") + f"SELECT id, name, type FROM nodes WHERE project_id = '{_HUB}' AND starts_with(file_path, 'src/')")
def template_nodes_under(spark: SparkSession, d: str) -> DataFrame:
    sql_api.register_views(spark, d)
    return sql_api.safe_query(spark, "nodes_under", project=_HUB, prefix="src/").select("id", "name", "type")


@R.add("read_only_query", with_("facts", "edges") + "SELECT type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges WHERE confidence IN (0.5, 0.7, 1.0) GROUP BY 1")
def read_only_query(spark: SparkSession, d: str) -> DataFrame:
    sql_api.register_views(spark, d)
    return sql_api.query(spark, "SELECT type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges WHERE confidence IN (0.5D, 0.7D, 1.0D) GROUP BY type")
