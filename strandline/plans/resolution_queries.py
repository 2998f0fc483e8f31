"""Symbols, imports, calls and routes resolved from the source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import resolve as V
from ..operators import routes as U
from . import canon
from .canon import with_
from .registry import Registry

R = Registry()

_LANG = "CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"
_F = f"WITH f AS (SELECT DISTINCT ON (file_id) file_id, project_id, file_path, content, {_LANG} AS language FROM source_files)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").dropDuplicates(["file_id"])
    return f.select("file_id", "project_id", "file_path", "content", I.language(F.col("file_path")).alias("language"))


def _q(s: str) -> str:
    return s.replace("'", "''")


_LINES = ", l AS (SELECT file_id, language, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS n FROM f) "


@R.add("line_symbols", _F + _LINES + " UNION ALL ".join(f"SELECT file_id, n AS line, '{k}' AS kind, regexp_extract(line, '{_q(p)}', 1) AS name FROM l WHERE language = '{lang}' AND regexp_matches(line, '{_q(p)}')" for lang, k, p in V.DECLARATIONS))
def line_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declared functions, classes and interfaces of six languages."""
    return V.line_symbols(_files(spark, d))


_REL = (
    ", rr AS (SELECT DISTINCT project_id, file_path, unnest(regexp_extract_all(content, 'from [''\"](\\.{1,2}/[^''\"]+)[''\"]', 1)) AS raw FROM f), "
    "rx AS (SELECT *, string_split(file_path, '/') AS b, string_split(raw, '/') AS q FROM rr), "
    "rt AS (SELECT project_id, file_path, CASE WHEN len(b) - 1 - len(list_filter(q, lambda v: v = '..')) >= 0 THEN array_to_string(list_concat(b[1:len(b) - 1 - len(list_filter(q, lambda v: v = '..'))], list_filter(q, lambda v: v NOT IN ('.', '..'))), '/') END AS stem FROM rx), "
    "ri AS (SELECT DISTINCT rt.project_id, rt.file_path AS file, f.file_path AS target FROM rt JOIN f ON f.project_id = rt.project_id AND (f.file_path = rt.stem OR regexp_replace(f.file_path, '(?:/index)?\\.\\w+$', '') = rt.stem))"
)
_MOD = (
    ", mm AS (SELECT DISTINCT project_id, file_path, language, unnest(regexp_extract_all(content, CASE language {cases} END, 0)) AS m FROM f WHERE language IN ('python', 'java', 'rust', 'go')), "
    "mr AS (SELECT DISTINCT project_id, file_path, language, raw, CASE language WHEN 'rust' THEN replace(regexp_replace(raw, '::[A-Z]\\w*$', ''), '::', '/') WHEN 'go' THEN string_split(raw, '/')[-1] ELSE replace(raw, '.', '/') END AS path FROM "
    "(SELECT *, CASE language WHEN 'python' THEN coalesce(nullif(regexp_extract(m, '{py}', 1), ''), regexp_extract(m, '{py}', 2)) WHEN 'java' THEN regexp_extract(m, '{java}', 1) WHEN 'rust' THEN regexp_extract(m, '{rust}', 1) ELSE regexp_extract(m, '{go}', 1) END AS raw FROM mm) WHERE raw <> ''), "
    "sp AS (SELECT project_id, language, CASE WHEN language = 'go' THEN regexp_replace(file_path, '/?[^/]*$', '') ELSE file_path END AS target, string_split(CASE WHEN language = 'go' THEN regexp_replace(file_path, '/?[^/]*$', '') ELSE regexp_replace(file_path, '(?:/__init__|/mod)?\\.\\w+$', '') END, '/') AS p FROM f), "
    "sx AS (SELECT DISTINCT project_id, language, target, array_to_string(p[i:len(p)], '/') AS path FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM sp)), "
    "su AS (SELECT project_id, language, path, min(target) AS target FROM sx WHERE path <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1), "
    "mi AS (SELECT mr.project_id, mr.file_path, mr.raw, su.target FROM mr JOIN su ON su.project_id = mr.project_id AND su.language = mr.language AND su.path = mr.path)"
)
_RULES = {
    "py": r"(?m)^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*))", "java": r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+crate::([A-Za-z_][\w:]*)", "go": r'(?m)^\s*(?:import\s+)?"([A-Za-z_][\w./-]*)"',
}
_MOD = _MOD.replace("{cases}", " ".join(f"WHEN '{'python' if k == 'py' else k}' THEN '{_q(v)}'" for k, v in _RULES.items()))
for _k, _v in _RULES.items():
    _MOD = _MOD.replace("{" + _k + "}", _q(_v))


def _relative(f: DataFrame) -> DataFrame:
    """Relative imports of scripts to files that are there."""
    r = I.relative_imports(f).select("project_id", F.col("file_path").alias("file"), F.col("target").alias("stem")).filter("stem IS NOT NULL").distinct()
    stems = f.select("project_id", F.col("file_path").alias("target"), F.explode(F.array_distinct(F.array("file_path", F.regexp_replace("file_path", r"(?:/index)?\.\w+$", "")))).alias("stem"))
    return r.join(stems, ["project_id", "stem"]).select("project_id", "file", "target").distinct()


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    m = V.resolve_imports(f).select("project_id", F.col("file_path").alias("file"), "target")
    return _relative(f).union(m).distinct()


_IMP = _REL + _MOD + ", im AS (SELECT * FROM ri UNION SELECT project_id, file_path, target FROM mi)"


@R.add("module_imports", _F + _MOD + " SELECT project_id, file_path, raw, target FROM mi")
def module_imports(spark: SparkSession, d: str) -> DataFrame:
    """Python, Java, Rust and Go imports by the suffix index."""
    return V.resolve_imports(_files(spark, d))


@R.add("file_imports", _F + _IMP + " SELECT * FROM im")
def imports(spark: SparkSession, d: str) -> DataFrame:
    return file_imports(spark, d)


_N = ", n AS (SELECT project_id, node_id AS id, min(file_path) AS file, min(name) AS name, min(node_label) AS type FROM parsed_nodes GROUP BY 1, 2)"
_REFS = f", cx AS (SELECT DISTINCT project_id, file_path AS file, unnest(regexp_extract_all(content, '{_q(V.CALL)}', 0)) AS c FROM f), refs AS (SELECT DISTINCT project_id, file, regexp_extract(c, '(\\w+)\\s*\\($', 1) AS name, CASE WHEN c LIKE 'new%' THEN 'constructor' WHEN c LIKE '.%' THEN 'member' ELSE 'free' END AS form FROM cx)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return canon.nodes(spark, d).select("project_id", F.col("file_path").alias("file"), "name", "id", "type")


_CALLS = (
    _F + _IMP + _N + _REFS
    + ", j AS (SELECT r.project_id, r.file, r.name, r.form, n.id, CASE WHEN n.file = r.file THEN 0.95::DOUBLE WHEN im.target IS NOT NULL THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS tier FROM refs r JOIN n ON n.project_id = r.project_id AND n.name = r.name "
    "AND ((form = 'constructor' AND type = 'Class') OR (form = 'member' AND type = 'Method') OR (form = 'free' AND type IN ('Function', 'Class'))) LEFT JOIN im ON im.project_id = r.project_id AND im.file = r.file AND im.target = n.file), "
    "b AS (SELECT *, max(tier) OVER (PARTITION BY project_id, file, name, form) AS best FROM j), "
    "rc AS (SELECT project_id, file, name, form, min(id) AS id, tier AS confidence, CASE tier WHEN 0.95 THEN 'same-file' WHEN 0.9 THEN 'import-resolved' ELSE 'global' END AS reason FROM b WHERE tier = best GROUP BY project_id, file, name, form, tier HAVING count(*) = 1)"
)


@R.add("resolved_calls", _CALLS + " SELECT * FROM rc")
def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the source texts to parsed symbols, by form and tier."""
    return V.resolve_calls(V.calls(_files(spark, d)), _symbols(spark, d), file_imports(spark, d))


_TIERS = """, s AS (SELECT project_id, file AS sf, name, id FROM n), rf AS (SELECT DISTINCT project_id, file, name FROM refs),
same AS (SELECT r.project_id, r.file, r.name, s.id, 0.95::DOUBLE AS tier FROM rf r JOIN s ON s.project_id = r.project_id AND s.name = r.name AND s.sf = r.file),
vi AS (SELECT r.project_id, r.file, r.name, s.id, 0.9::DOUBLE AS tier FROM rf r JOIN im ON im.project_id = r.project_id AND im.file = r.file JOIN s ON s.project_id = r.project_id AND s.name = r.name AND s.sf = im.target),
al AS (SELECT project_id, name, min(id) AS id FROM s GROUP BY 1, 2 HAVING count(*) = 1), g AS (SELECT r.project_id, r.file, r.name, al.id, 0.5::DOUBLE AS tier FROM rf r JOIN al ON al.project_id = r.project_id AND al.name = r.name),
e AS (SELECT * FROM same UNION SELECT * FROM vi UNION SELECT * FROM g), b AS (SELECT *, max(tier) OVER (PARTITION BY project_id, file, name) AS best FROM e)"""


@R.add("tiered_resolution", _F + _IMP + _N + _REFS + _TIERS + " SELECT project_id, file, name, tier, min(id) AS id FROM b WHERE tier = best GROUP BY 1, 2, 3, 4 HAVING count(*) = 1")
def tiered_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names called in the texts, by file, imports and project."""
    refs = V.calls(_files(spark, d)).select("project_id", "file", "name").distinct()
    return I.resolve_tiers(refs, _symbols(spark, d), file_imports(spark, d))


_TEST = r"(?:\.(?:test|spec)\.\w+$|(?:^|/)tests?/)"


_USES = _CALLS + ", us AS (SELECT * FROM im UNION SELECT rc.project_id, rc.file, n.file FROM rc JOIN n ON n.project_id = rc.project_id AND n.id = rc.id WHERE n.file <> rc.file)"


def _uses(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, file, target): files that import or call into others."""
    n = _symbols(spark, d)
    c = resolved_calls(spark, d).join(n.select("project_id", "id", F.col("file").alias("target")), ["project_id", "id"]).filter("file <> target")
    return file_imports(spark, d).union(c.select("project_id", "file", "target")).distinct()


@R.add("affected_tests", _USES + f" SELECT project_id, target AS changed, count(DISTINCT file) AS tests, min(file) AS first_test FROM us WHERE regexp_matches(file, '{_TEST}') GROUP BY 1, 2")
def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test files (by their path) that import a changed file or call into it."""
    t = _uses(spark, d).filter(F.col("file").rlike(_TEST))
    return t.groupBy("project_id", F.col("target").alias("changed")).agg(F.countDistinct("file").alias("tests"), F.min("file").alias("first_test"))


@R.add("untested_files", _USES + f", u AS (SELECT DISTINCT project_id, target FROM us WHERE NOT regexp_matches(target, '{_TEST}')) SELECT project_id, target AS file FROM u WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.project_id = u.project_id AND us.target = u.target AND regexp_matches(us.file, '{_TEST}'))")
def untested_files(spark: SparkSession, d: str) -> DataFrame:
    """Used files that no test uses."""
    i = _uses(spark, d)
    t = i.filter(F.col("file").rlike(_TEST)).select("project_id", "target")
    return i.filter(~F.col("target").rlike(_TEST)).join(t, ["project_id", "target"], "left_anti").select("project_id", F.col("target").alias("file")).distinct()


@R.add("external_packages", _F + ", r AS (SELECT DISTINCT project_id, file_path, unnest(regexp_extract_all(content, '(?:from\\s+|require\\(\\s*|import\\s+)[''\"]([^''\"./][^''\"]*)[''\"]', 1)) AS raw FROM f) SELECT project_id, CASE WHEN raw LIKE '@%/%' THEN string_split(raw, '/')[1] || '/' || string_split(raw, '/')[2] ELSE string_split(raw, '/')[1] END AS package, count(DISTINCT file_path) AS used_by FROM r GROUP BY 1, 2")
def external_packages(spark: SparkSession, d: str) -> DataFrame:
    return V.external_packages(_files(spark, d))


@R.add("name_lookup", with_("nodes") + "SELECT project_id, name, id, n AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY CASE WHEN type IN ('Class', 'Interface') THEN 0 ELSE 1 END, id) AS r, count(*) OVER (PARTITION BY project_id, name) AS n FROM nodes) WHERE r = 1")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    return V.disambiguate(canon.nodes(spark, d))


@R.add("mapped_files", with_("file_change", "nodes") + ", c AS (SELECT DISTINCT project_id, file_path FROM file_change UNION SELECT DISTINCT project_id, file_path FROM source_files) SELECT c.project_id, c.file_path, n.id FROM c LEFT JOIN (SELECT DISTINCT project_id, file_path, id FROM nodes) n ON n.project_id = c.project_id AND n.file_path = c.file_path")
def mapped_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed and stored files with their nodes; the unmapped ones have none."""
    c = canon.file_change(spark, d).select("project_id", "file_path").union(table(spark, d, "source_files").select("project_id", "file_path"))
    return V.map_files(c, canon.nodes(spark, d))


_E = with_("facts", "edges")


@R.add("interface_dispatch", _E + ", c AS (SELECT DISTINCT project_id, src, dst FROM edges WHERE type = 'CALLS'), i AS (SELECT DISTINCT project_id, src AS t, dst FROM edges WHERE type = 'IMPLEMENTS' AND src <> dst), m AS (SELECT DISTINCT c.project_id, c.src, i.t AS dst FROM c JOIN i ON i.project_id = c.project_id AND i.dst = c.dst WHERE c.src <> i.t) SELECT project_id, src, dst, 'CALLS' AS type, 0.7::DOUBLE AS confidence, 'interface-dispatch' AS reason FROM (SELECT * FROM m EXCEPT SELECT * FROM c)")
def interface_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return V.interface_dispatch(canon.edges(spark, d))


_DEAD_T = "('CALLS','EXTENDS','IMPLEMENTS','OVERRIDES','USES')"


@R.add(
    "dead_code",
    _E + ", fn AS (SELECT project_id, src AS id FROM edges UNION SELECT project_id, dst FROM edges UNION SELECT project_id, 'File:' || file_path FROM source_files), "
    "ex AS (SELECT project_id, 'File:' || file_path AS id, bool_or(is_exported) AS is_exported FROM parsed_nodes GROUP BY 1, 2), n AS (SELECT fn.project_id, fn.id, coalesce(is_exported, false) AS is_exported FROM fn LEFT JOIN ex ON ex.project_id = fn.project_id AND ex.id = fn.id), "
    f"u AS (SELECT DISTINCT project_id, dst AS id FROM edges WHERE type IN {_DEAD_T} AND src <> dst), o AS (SELECT DISTINCT project_id, dst AS id FROM edges WHERE type IN {_DEAD_T} AND src = dst) "
    "SELECT n.project_id, n.id, CASE WHEN o.id IS NOT NULL THEN 'only_self' WHEN is_exported THEN 'no_callers_exported' ELSE 'no_callers_internal' END AS reason, CASE WHEN o.id IS NOT NULL THEN 0.95::DOUBLE WHEN is_exported THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence "
    "FROM n LEFT JOIN o ON o.project_id = n.project_id AND o.id = n.id WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.project_id = n.project_id AND u.id = n.id)",
)
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    """Files nobody calls or extends; exported if a symbol of theirs is."""
    e = canon.edges(spark, d)
    n = e.select("project_id", F.col("src").alias("id")).union(e.select("project_id", "dst")).union(table(spark, d, "source_files").select("project_id", F.concat(F.lit("File:"), "file_path"))).distinct()
    ex = table(spark, d, "parsed_nodes").groupBy("project_id", F.concat(F.lit("File:"), "file_path").alias("id")).agg(F.bool_or("is_exported").alias("is_exported"))
    return G.no_inbound(n.join(ex, ["project_id", "id"], "left"), e).select("project_id", "id", "reason", "confidence")


_IGN = ["dist/", "*.min.js", "/packages/tools/", "vendor/**", "!vendor/keep", "**/node_modules/"]


@R.add("gitignored_files", "SELECT DISTINCT project_id, file_path FROM source_files WHERE CASE WHEN regexp_matches(file_path, '(?:^|/)node_modules/') THEN true WHEN regexp_matches(file_path, '^vendor/keep(?:/|$)') THEN false WHEN regexp_matches(file_path, '^vendor/.*(?:/|$)') THEN true WHEN regexp_matches(file_path, '^packages/tools/') THEN true WHEN regexp_matches(file_path, '(?:^|/)[^/]*\\.min\\.js(?:/|$)') THEN true WHEN regexp_matches(file_path, '(?:^|/)dist/') THEN true ELSE false END")
def gitignored_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("project_id", "file_path").distinct().filter(V.gitignore(F.col("file_path"), _IGN))


@R.add(
    "route_match",
    "WITH r AS (SELECT DISTINCT project_id, '/' || regexp_replace(file_path, '[^/]*$', '') || '[name]' AS route, string_split(regexp_replace(file_path, '[^/]*$', ''), '/') AS p FROM source_files), u AS (SELECT DISTINCT project_id, '/' || regexp_replace(file_path, '\\.\\w+$', '') AS url, string_split(regexp_replace(file_path, '\\.\\w+$', ''), '/') AS q FROM source_files) "
    "SELECT u.project_id, url, min(route) AS route FROM u JOIN r ON r.project_id = u.project_id AND len(r.p) = len(u.q) AND r.p[1:len(p)-1] = u.q[1:len(q)-1] GROUP BY 1, 2",
)
def route_match(spark: SparkSession, d: str) -> DataFrame:
    """URLs (paths without extension) and the folder pattern each one meets."""
    s = table(spark, d, "source_files").select("project_id", "file_path").distinct()
    routes = s.select("project_id", F.concat(F.lit("/"), F.regexp_replace("file_path", "[^/]*$", ""), F.lit("[name]")).alias("route"))
    return U.match_routes(s.select("project_id", F.concat(F.lit("/"), F.regexp_replace("file_path", r"\.\w+$", "")).alias("url")), routes)
