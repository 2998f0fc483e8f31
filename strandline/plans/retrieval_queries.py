"""Retrieval, documentation layer, ingestion and project queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..io import table
from ..operators import ingest as I
from ..operators import retrieval as S
from ..operators import wiki as K
from . import canon
from .canon import with_
from .registry import Registry

R = Registry()

_INDEX = "WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS term FROM documents), idx AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2)"
_BM = (
    _INDEX + ", l AS (SELECT doc, sum(tf) AS len FROM idx GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avg FROM l), h AS (SELECT * FROM idx WHERE term IN ('snapshot', 'confidence', 'queue')), "
    "dfq AS (SELECT term, count(*) AS df FROM h GROUP BY 1), bm AS (SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM h JOIN dfq USING (term) JOIN l USING (doc), st GROUP BY 1)"
)
_Q = ["snapshot", "confidence", "queue"]


@R.add("inverted_index", _INDEX + " SELECT * FROM idx")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return S.terms(table(spark, d, "documents"), "doc_id", "text")


def _bm(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(table(spark, d, "documents"), "doc_id", "text", _Q)


@R.add("search_code", _BM + " SELECT doc, score FROM bm ORDER BY score DESC, doc LIMIT 10")
def search_code(spark: SparkSession, d: str) -> DataFrame:
    return _bm(spark, d).orderBy(F.col("score").desc(), "doc").limit(10)


_VEC = "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.id % 100 = 0 AND v.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"


def _similar(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.top_similar(v, v.filter(F.col("id") % 100 == 0), k)


@R.add("similar_code", _VEC + " SELECT query, id, rank, score FROM r WHERE rank <= 5")
def similar_code(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 5)


@R.add(
    "hybrid_search",
    _BM + ", v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), vs AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v, v q WHERE q.id % 100 = 0 AND v.id <> q.id), "
    "a AS (SELECT doc AS id, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 50), b AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= 50), "
    "u AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT q.query, a.id, a.rank FROM a, (SELECT DISTINCT query FROM b) q UNION ALL SELECT * FROM b) GROUP BY 1, 2) "
    "SELECT query, id, score FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of 50 keyword and 50 vector hits, for every query
    vector (each id divisible by 100) beside the same words."""
    a = S.ranked(_bm(spark, d), "score", "doc", 50)
    b = _similar(spark, d, 50).select("query", "id", "rank")
    a = b.select("query").distinct().crossJoin(F.broadcast(a))  # 50 rows
    s = S.rrf([a, b], ["query"])
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 10").drop("r")


@R.add("fuzzy_match", "WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, lower(trim(p_name)) AS n FROM n) SELECT p_name, CASE WHEN n = 'red widget' THEN 1.0::DOUBLE WHEN contains(n, 'red widget') OR (contains('red widget', n) AND n <> '') THEN 0.8::DOUBLE ELSE round((CAST(list_contains(string_split(n, ' '), 'red') AS INTEGER) + CAST(list_contains(string_split(n, ' '), 'widget') AS INTEGER)) / 2.0 * 0.5, 6)::DOUBLE END AS score FROM s")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name").distinct().withColumn("score", S.fuzzy(F.col("p_name"), "red widget"))


@R.add("embedding_text", with_("nodes") + "SELECT project_id, id, concat_ws(' ', type, name, regexp_extract(file_path, '([^/]+)$', 1), substring(coalesce(description, ''), 1, 80)) AS text FROM nodes")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return canon.nodes(spark, d).select("project_id", "id", F.concat_ws(" ", "type", "name", F.regexp_extract("file_path", r"([^/]+)$", 1), F.substring(F.coalesce("description", F.lit("")), 1, 80)).alias("text"))


@R.add(
    "doc_classifier",
    "WITH x AS (SELECT doc_id, lower(coalesce(file_path, '')) AS p, text FROM documents) SELECT doc_id, CASE WHEN regexp_matches(p, '\\.(md|mdx|rst|adoc)$') THEN 1.0::DOUBLE WHEN regexp_matches(regexp_extract(p, '([^/]*)$', 1), '^(readme|changelog|contributing|license|authors|notice)(\\..*)?$') THEN 0.9::DOUBLE "
    "WHEN regexp_matches(p, '(^|/)(docs?|documentation|wiki)/') THEN 0.9::DOUBLE WHEN p LIKE '%.txt' AND regexp_matches(substring(text, 1, 1024), '(?m)^#{1,6} |^```|^[-*] |\\[[^\\]]+\\]\\([^)]+\\)') THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x",
)
def doc_classifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", K.doc_class(F.coalesce("file_path", F.lit("")), F.col("text")).alias("confidence"))


#: change sets that took a path away or brought it (back)
_GONE = (
    "ga AS (SELECT project_id, file_path, max(t) AS gone FROM (SELECT project_id, unnest(deleted) AS file_path, commit_ts AS t FROM change_sets WHERE {when}) GROUP BY 1, 2), "
    "ba AS (SELECT project_id, file_path, max(t) AS back FROM (SELECT project_id, unnest(list_concat(coalesce(added, []), coalesce(modified, []))) AS file_path, commit_ts AS t FROM change_sets WHERE {when}) GROUP BY 1, 2)"
)
_FRESH = (
    "WITH x AS (SELECT doc_id, project_id, file_path, ingested_at, sha256(trim(text)) AS sig, sha256(regexp_replace(text, '\\s+', '', 'g')) AS ast FROM documents), "
    "l AS (SELECT project_id, file_path, doc_id AS code_id, ingested_at FROM x WHERE project_id IS NOT NULL AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, file_path ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1), "
    + _GONE.format(when="true")
    + ", th AS (SELECT l.code_id FROM l LEFT JOIN ga ON ga.project_id = l.project_id AND ga.file_path = l.file_path LEFT JOIN ba ON ba.project_id = l.project_id AND ba.file_path = l.file_path WHERE ga.gone IS NULL OR ga.gone <= greatest(l.ingested_at, ba.back)), "
    "st AS (SELECT x.doc_id AS entity_id, l.code_id, CASE WHEN l.code_id IS NULL THEN 'unbound' WHEN c.doc_id IS NULL THEN 'orphaned' WHEN x.sig IS NOT DISTINCT FROM c.sig AND x.ast IS NOT DISTINCT FROM c.ast THEN 'fresh' ELSE 'stale' END AS state "
    "FROM x LEFT JOIN l ON l.project_id = x.project_id AND l.file_path = x.file_path LEFT JOIN (SELECT x.* FROM x JOIN th ON th.code_id = x.doc_id) c ON c.doc_id = l.code_id) "
)



def _standing(spark: SparkSession, d: str, paths: DataFrame, until: str | None = None) -> DataFrame:
    """The rows of ``paths`` (project_id, file_path, ingested_at) without those
    that a change set deleted after the row came and none brought back since."""
    c = table(spark, d, "change_sets")
    if until:
        c = c.filter(F.col("commit_ts") <= F.lit(until).cast("timestamp_ntz"))
    none = F.array().cast("array<string>")
    gone = c.select("project_id", F.explode("deleted").alias("file_path"), F.col("commit_ts").alias("gone"), F.lit(None).cast("timestamp_ntz").alias("back"))
    back = c.select("project_id", F.explode(F.concat(F.coalesce("added", none), F.coalesce("modified", none))).alias("file_path"), F.lit(None).cast("timestamp_ntz").alias("gone"), F.col("commit_ts").alias("back"))
    at = gone.union(back).groupBy("project_id", "file_path").agg(F.max("gone").alias("gone"), F.max("back").alias("back")).filter("gone IS NOT NULL")
    j = paths.join(at, ["project_id", "file_path"], "left")
    return j.filter(F.col("gone").isNull() | (F.col("gone") <= F.greatest("ingested_at", "back"))).drop("gone", "back")


@R.add("entity_freshness", _FRESH + "SELECT entity_id, code_id, state FROM st")
def entity_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Each text bound to the last text of its path: unbound (no project or
    path), orphaned (the path was deleted since), stale or fresh."""
    x = table(spark, d, "documents").select("doc_id", "project_id", "file_path", "text", "ingested_at")
    sig, ast = K.signature(F.col("text"), F.col("text"))
    last = x.filter("project_id IS NOT NULL AND file_path IS NOT NULL").groupBy("project_id", "file_path").agg(F.max(F.struct("ingested_at", "doc_id")).alias("l"))
    last = last.select("project_id", "file_path", F.col("l.doc_id").alias("code_id"), F.col("l.ingested_at").alias("ingested_at"))
    e = x.join(last.drop("ingested_at"), ["project_id", "file_path"], "left").select(F.col("doc_id").alias("entity_id"), "code_id", sig.alias("sig"), ast.alias("ast"))
    there = _standing(spark, d, last).select(F.col("code_id").alias("doc_id"))
    c = x.join(there, "doc_id", "left_semi").select(F.col("doc_id").alias("code_id"), sig.alias("sig"), ast.alias("ast"))
    return K.freshness(e, c)


@R.add("freshness_summary", _FRESH + "SELECT state, count(*) AS n FROM st GROUP BY 1")
def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    return entity_freshness(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "wiki_lint",
    "WITH u AS (SELECT DISTINCT ON (update_id) * FROM relation_updates), o AS (SELECT DISTINCT source_id FROM u) SELECT 'stale' AS issue, update_id AS id FROM u WHERE valid_to IS NOT NULL AND valid_to < TIMESTAMP '2025-06-01' - INTERVAL 30 DAY "
    "UNION ALL SELECT 'orphan_link', update_id FROM u WHERE rel_type = 'DESCRIBES' AND target_id NOT IN (SELECT source_id FROM o) UNION ALL SELECT 'missing_reason', update_id FROM u WHERE reason IS NULL",
)
def wiki_lint(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "relation_updates").dropDuplicates(["update_id"])
    stale = u.filter(F.col("valid_to") < F.lit("2025-05-02 00:00:00").cast("timestamp_ntz")).select(F.lit("stale").alias("issue"), F.col("update_id").alias("id"))
    orphan = u.filter("rel_type = 'DESCRIBES'").join(u.select(F.col("source_id").alias("target_id")), "target_id", "left_anti").select(F.lit("orphan_link"), "update_id")
    return stale.union(orphan).union(u.filter("reason IS NULL").select(F.lit("missing_reason"), "update_id"))


@R.add("wiki_index", "WITH u AS (SELECT DISTINCT ON (update_id) * FROM relation_updates), n AS (SELECT DISTINCT project_id, target_id AS entity FROM u), l AS (SELECT project_id, target_id AS entity, count(*) AS links FROM u WHERE rel_type = 'DESCRIBES' GROUP BY 1, 2) SELECT n.project_id, n.entity, coalesce(links, 0) AS links FROM n LEFT JOIN l ON n.project_id = l.project_id AND n.entity = l.entity")
def wiki_index(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "relation_updates").dropDuplicates(["update_id"])
    n = u.select("project_id", F.col("target_id").alias("entity")).distinct()
    links = u.filter("rel_type = 'DESCRIBES'").groupBy("project_id", F.col("target_id").alias("entity")).agg(F.count(F.lit(1)).alias("links"))
    return n.join(links, ["project_id", "entity"], "left").select("project_id", "entity", F.coalesce("links", F.lit(0)).alias("links"))


@R.add("wiki_status", "SELECT DISTINCT d.project_id, d.file_path FROM documents d WHERE d.project_id IS NOT NULL AND d.file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_files s WHERE s.project_id = d.project_id AND s.file_path = d.file_path)")
def wiki_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose path is no compiled source of the project."""
    x = table(spark, d, "documents").filter("project_id IS NOT NULL AND file_path IS NOT NULL").select("project_id", "file_path").distinct()
    return x.join(table(spark, d, "source_files").select("project_id", "file_path"), ["project_id", "file_path"], "left_anti")


@R.add("wiki_auto_discover", "SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, string_agg(DISTINCT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)), ',' ORDER BY lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))) AS exts, count(*) AS n FROM documents WHERE file_path IS NOT NULL GROUP BY 1")
def wiki_auto_discover(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("file_path IS NOT NULL")
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    return x.groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("dir")).agg(F.array_join(F.array_sort(F.collect_set(ext)), ",").alias("exts"), F.count(F.lit(1)).alias("n"))


@R.add(
    "entity_selection",
    with_("nodes") + ", c AS (SELECT project_id, id, type, coalesce(parameter_count, 0) AS degree, CASE WHEN type = 'Class' THEN 'classes' WHEN is_exported THEN 'exported' END AS rule FROM nodes), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY degree DESC, id) AS r FROM c WHERE rule IS NOT NULL QUALIFY r <= CASE rule WHEN 'classes' THEN 5 ELSE 8 END) "
    "SELECT project_id, id, rule FROM r QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE rule WHEN 'classes' THEN 1 ELSE 2 END, r, id) <= 10",
)
def entity_selection(spark: SparkSession, d: str) -> DataFrame:
    c = canon.nodes(spark, d).select("project_id", "id", "type", "is_exported", F.coalesce("parameter_count", F.lit(0)).alias("degree"))
    return K.select_by_rules(c, [("classes", F.col("type") == "Class", 1, 5), ("exported", F.col("is_exported"), 2, 8)], 10)


# -- ingestion -------------------------------------------------------------

_SF = "sf AS (SELECT DISTINCT ON (file_id) * FROM source_files)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").dropDuplicates(["file_id"])


@R.add("language_detection", "WITH " + _SF + " SELECT file_id, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS language FROM sf")
def language_detection(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", I.language(F.col("file_path")).alias("language"))


@R.add("ignored_files", "WITH " + _SF + " SELECT file_id FROM sf WHERE len(list_intersect(string_split(file_path, '/'), ['node_modules','vendor','dist','build','target','out','.git','.idea','coverage','__pycache__','Pods','bower_components','third_party'])) > 0")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter(I.ignored(F.col("file_path"))).select("file_id")


@R.add(
    "folder_structure",
    "WITH " + _SF + ", p AS (SELECT project_id, string_split(file_path, '/') AS a FROM sf), k AS (SELECT project_id, a, unnest(generate_series(1, len(a))) AS k FROM p) "
    "SELECT DISTINCT project_id, CASE WHEN k = 1 THEN 'Folder:.' ELSE 'Folder:' || array_to_string(a[1:k-1], '/') END AS src, (CASE WHEN k = len(a) THEN 'File:' ELSE 'Folder:' END) || array_to_string(a[1:k], '/') AS dst FROM k",
)
def folder_structure(spark: SparkSession, d: str) -> DataFrame:
    return I.structure(_files(spark, d))


@R.add(
    "markdown_sections",
    "WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), "
    "h AS (SELECT doc, line_no, len(regexp_extract(line, '^(#{1,6}) ', 1)) AS level, trim(regexp_replace(line, '^#{1,6} ', '')) AS title FROM l WHERE regexp_matches(line, '^#{1,6} ')) "
    "SELECT doc, line_no, level, title, coalesce((SELECT max(p.line_no) FROM h p WHERE p.doc = h.doc AND p.line_no < h.line_no AND p.level < h.level), -1) AS parent_line FROM h",
)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return I.markdown_sections(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@R.add(
    "relative_imports",
    "WITH " + _SF + ", r AS (SELECT DISTINCT project_id, file_path, unnest(regexp_extract_all(content, 'from [''\"](\\.{1,2}/[^''\"]+)[''\"]', 1)) AS raw FROM sf), "
    "x AS (SELECT *, string_split(file_path, '/') AS b, string_split(raw, '/') AS q FROM r) SELECT project_id, file_path, raw, "
    "CASE WHEN len(b) - 1 - len(list_filter(q, lambda v: v = '..')) >= 0 THEN array_to_string(list_concat(b[1:len(b) - 1 - len(list_filter(q, lambda v: v = '..'))], list_filter(q, lambda v: v NOT IN ('.', '..'))), '/') END AS target FROM x",
)
def relative_imports(spark: SparkSession, d: str) -> DataFrame:
    return I.relative_imports(_files(spark, d)).distinct()


@R.add("heritage_confidence", "SELECT update_id, round(sqrt(confidence * 0.9), 8) AS confidence FROM (SELECT DISTINCT ON (update_id) * FROM relation_updates) WHERE rel_type IN ('EXTENDS', 'IMPLEMENTS')")
def heritage_confidence(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_updates").dropDuplicates(["update_id"]).filter(F.col("rel_type").isin("EXTENDS", "IMPLEMENTS"))
    return r.select("update_id", F.round(F.sqrt(F.col("confidence") * 0.9), 8).alias("confidence"))


#: instant of the old snapshot
_OLD = "2025-01-01 00:00:00"


def _snapshot(spark: SparkSession, d: str, until: str | None = None) -> DataFrame:
    """(project_id, file_path, hash): the last content of each path that stood
    at ``until`` (None: now)."""
    f = table(spark, d, "source_files")
    if until:
        f = f.filter(F.col("ingested_at") <= F.lit(until).cast("timestamp_ntz"))
    f = f.select("project_id", "file_path", F.struct("ingested_at", "file_id", F.sha2("content", 256).alias("hash")).alias("v"))
    last = f.groupBy("project_id", "file_path").agg(F.max("v").alias("v")).select("project_id", "file_path", F.col("v.ingested_at").alias("ingested_at"), F.col("v.hash").alias("hash"))
    return _standing(spark, d, last, until).drop("ingested_at")


def _snap(name: str, until: str) -> str:
    """A snapshot in SQL; every step is named after it."""
    gone = _GONE.format(when=f"commit_ts <= {until}").replace("ga AS", f"ga{name} AS").replace("ba AS", f"ba{name} AS")
    return (
        f"l{name} AS (SELECT project_id, file_path, ingested_at, sha256(content) AS h FROM source_files WHERE ingested_at <= {until} QUALIFY row_number() OVER (PARTITION BY project_id, file_path ORDER BY ingested_at DESC, file_id DESC) = 1), {gone}, "
        f"{name} AS (SELECT l.project_id, l.file_path, l.h FROM l{name} l LEFT JOIN ga{name} g ON g.project_id = l.project_id AND g.file_path = l.file_path LEFT JOIN ba{name} b ON b.project_id = l.project_id AND b.file_path = l.file_path "
        "WHERE g.gone IS NULL OR g.gone <= greatest(l.ingested_at, b.back))"
    )


@R.add(
    "changed_files",
    "WITH " + _snap("a", f"TIMESTAMP '{_OLD}'") + ", " + _snap("b", "TIMESTAMP '9999-01-01'") + " "
    "SELECT * FROM (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.project_id IS NULL THEN 'added' WHEN b.project_id IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END AS change FROM a FULL JOIN b ON a.project_id = b.project_id AND a.file_path = b.file_path) WHERE change IS NOT NULL",
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """All files as they stood at an instant and now, compared by content hash."""
    return I.changed_files(_snapshot(spark, d, _OLD), _snapshot(spark, d))


@R.add("python_symbols")
def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return I.python_symbols(_files(spark, d).filter(I.language(F.col("file_path")) == "python"))


@R.add("symbol_rows", with_("nodes") + "SELECT * FROM nodes")
def symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    return canon.nodes(spark, d)


# -- projects ----------------------------------------------------------------

_JOB = "j AS (SELECT DISTINCT ON (job_id) *, lower(trim(project_id)) AS p FROM analysis_jobs)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_jobs").dropDuplicates(["job_id"]).withColumn("p", F.lower(F.trim("project_id")))


@R.add("list_repos", "WITH " + _SF + " SELECT project_id, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS lines FROM sf GROUP BY 1")
def list_repos(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("lines"))


@R.add("project_status", "WITH " + _JOB + " SELECT p, stored_last_commit AS last_commit, queued_at, CASE WHEN stored_last_commit IS NULL THEN 'queued' ELSE 'analyzed' END AS state FROM j QUALIFY row_number() OVER (PARTITION BY p ORDER BY queued_at DESC, job_id DESC) = 1")
def project_status(spark: SparkSession, d: str) -> DataFrame:
    b = _jobs(spark, d).groupBy("p").agg(F.max_by(F.struct("stored_last_commit", "queued_at"), F.struct("queued_at", "job_id")).alias("b"))
    return b.select("p", F.col("b.stored_last_commit").alias("last_commit"), F.col("b.queued_at").alias("queued_at"), F.when(F.col("b.stored_last_commit").isNull(), "queued").otherwise("analyzed").alias("state"))


@R.add("incremental_plan", "WITH " + _JOB + " SELECT job_id, CASE WHEN force_level IS NOT NULL THEN 'full' WHEN coalesce(can_auto_incremental, false) AND stored_last_commit IS NOT NULL THEN 'incremental' ELSE 'full' END AS mode FROM j")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("force_level").isNotNull(), "full").when(F.coalesce("can_auto_incremental", F.lit(False)) & F.col("stored_last_commit").isNotNull(), "incremental").otherwise("full")
    return _jobs(spark, d).select("job_id", mode.alias("mode"))


@R.add("webhook_match", "WITH " + _JOB + " SELECT job_id, p FROM j WHERE contains(regexp_replace(lower(git_url), '\\.git$', ''), 'git.nettle.example')")
def webhook_match(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).filter(F.regexp_replace(F.lower("git_url"), r"\.git$", "").contains("git.nettle.example")).select("job_id", "p")


@R.add("consistency", "WITH " + _JOB + " SELECT p, count(*) AS jobs, round(100.0::DOUBLE * count(*) FILTER (WHERE stored_last_commit IS NULL) / count(*), 1) AS fallback_rate, round((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(max(queued_at))) / 1e6 / 86400, 1) AS stale_days FROM j GROUP BY 1")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    age = F.timestamp_diff("MICROSECOND", F.max("queued_at"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")) / 1e6 / 86_400
    return _jobs(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("jobs"), F.round(100.0 * F.count_if(F.col("stored_last_commit").isNull()) / F.count(F.lit(1)), 1).alias("fallback_rate"), F.round(age, 1).alias("stale_days"))


@R.add("event_sessions", "WITH e AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS first_ts, count(*) AS events, round(sum(value), 4) AS value FROM g GROUP BY user_id, s")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events with less than six hours between neighbours."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return s.select("user_id", "first_ts", "events", "value")
