"""Symbols, imports and calls of source texts, and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (language, kind, pattern of a declaration's line; group 1 is the name)
DECLARATIONS = (
    ("python", "Function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("python", "Class", r"^\s*class\s+(\w+)"),
    ("javascript", "Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("javascript", "Class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    ("typescript", "Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("typescript", "Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "Interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("java", "Class", r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|enum|record)\s+(\w+)"),
    ("java", "Interface", r"^\s*(?:(?:public|protected|private|static|sealed)\s+)*interface\s+(\w+)"), ("go", "Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("go", "Class", r"^type\s+(\w+)\s+struct\b"), ("go", "Interface", r"^type\s+(\w+)\s+interface\b"), ("rust", "Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("rust", "Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("rust", "Interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
)
#: call forms: constructor, member or free
CALL = r"(new\s+|\.\s*)?\b([A-Za-z_]\w*)\s*\("


def line_symbols(files: DataFrame) -> DataFrame:
    """(file_id, language, content) -> declarations found line by line: name,
    kind, line from 1. One pass over the lines, all inside the JVM."""
    lines = files.select("file_id", "language", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("n", "line"))
    found = F.array_compact(F.array(*[F.when((F.col("language") == lang) & F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for lang, kind, p in DECLARATIONS]))
    return lines.select("file_id", (F.col("n") + 1).alias("line"), F.explode(found).alias("s")).select("file_id", "line", "s.kind", "s.name")


def calls(files: DataFrame) -> DataFrame:
    """(project_id, file_path, content) -> called names with their form; what a
    file declares by ``name(`` counts as well."""
    hit = F.regexp_extract_all("content", F.lit(CALL), 0)
    c = files.select("project_id", F.col("file_path").alias("file"), F.explode(F.array_distinct(hit)).alias("c"))
    form = F.when(F.col("c").startswith("new"), "constructor").when(F.col("c").startswith("."), "member").otherwise("free")
    return c.select("project_id", "file", F.regexp_extract("c", r"(\w+)\s*\($", 1).alias("name"), form.alias("form")).distinct()


def resolve_calls(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (project_id, file, name, form) to symbols (project_id, file, name,
    id, type): a constructor needs a class, a member a method, a free call a
    function or class. Same file .95, imported file .9, elsewhere .5; the best
    tier counts, and more than one candidate there leaves the call open."""
    s = symbols.select("project_id", F.col("file").alias("sf"), "name", "id", "type").distinct()
    fits = F.when(F.col("form") == "constructor", F.col("type") == "Class").when(F.col("form") == "member", F.col("type") == "Method").otherwise(F.col("type").isin("Function", "Class"))
    j = refs.join(s, ["project_id", "name"]).filter(fits)
    i = imports.select("project_id", "file", F.col("target").alias("sf"), F.lit(True).alias("imported")).distinct()
    j = j.join(i, ["project_id", "file", "sf"], "left")
    tier = F.when(F.col("file") == F.col("sf"), 0.95).when(F.col("imported"), 0.9).otherwise(0.5)
    best = j.select("project_id", "file", "name", "form", "id", tier.alias("tier")).groupBy("project_id", "file", "name", "form", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    top = best.groupBy("project_id", "file", "name", "form").agg(F.max(F.struct("tier", "n", "id")).alias("b"))
    reason = F.when(F.col("b.tier") == 0.95, "same-file").when(F.col("b.tier") == 0.9, "import-resolved").otherwise("global")
    return top.filter("b.n = 1").select("project_id", "file", "name", "form", "b.id", F.col("b.tier").alias("confidence"), reason.alias("reason"))


def module_imports(files: DataFrame) -> DataFrame:
    """(project_id, file_path, language, content) -> raw import and the path it
    ends with: dotted Python and Java names, crate paths of Rust, folders of Go."""
    rule = {
        "python": r"(?m)^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*))", "java": r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;",
        "rust": r"(?m)^\s*(?:pub\s+)?use\s+crate::([A-Za-z_][\w:]*)", "go": r'(?m)^\s*(?:import\s+)?"([A-Za-z_][\w./-]*)"',
    }
    hit = None
    for lang, p in rule.items():
        x = F.regexp_extract_all("content", F.lit(p), 0)
        hit = F.when(F.col("language") == lang, x) if hit is None else hit.when(F.col("language") == lang, x)
    r = files.select("project_id", "file_path", "language", F.explode(F.array_distinct(hit)).alias("m"))
    name = F.coalesce(*[F.when(F.col("language") == lang, F.array_join(F.array_compact(F.array(*[F.nullif(F.regexp_extract("m", p, i), F.lit("")) for i in range(1, 1 + p.count("([A-Za-z_]"))])), "")) for lang, p in rule.items()])
    path = F.when(F.col("language") == "rust", F.regexp_replace(F.regexp_replace("raw", "::[A-Z]\\w*$", ""), "::", "/")).when(F.col("language") == "go", F.element_at(F.split("raw", "/"), -1)).otherwise(F.regexp_replace("raw", "[.]", "/"))
    return r.withColumn("raw", name).filter("raw <> ''").select("project_id", "file_path", "language", "raw", path.alias("path")).distinct()


def suffix_index(files: DataFrame) -> DataFrame:
    """Every suffix of a path without its extension (and its folder suffixes for
    Go) -> the only file, or folder, that ends with it."""
    stem = F.regexp_replace("file_path", r"(?:/__init__|/mod)?\.\w+$", "")
    parts = F.split(F.when(F.col("language") == "go", F.regexp_replace("file_path", "/?[^/]*$", "")).otherwise(stem), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    target = F.when(F.col("language") == "go", F.regexp_replace("file_path", "/?[^/]*$", "")).otherwise(F.col("file_path"))
    s = files.select("project_id", "language", target.alias("target"), F.explode(ends).alias("path")).filter("path <> ''").distinct()
    return s.groupBy("project_id", "language", "path").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")


def resolve_imports(files: DataFrame) -> DataFrame:
    """Imports to the only file (Go: folder) of the project whose path ends like
    them; an import with none or several stays open."""
    return module_imports(files).join(suffix_index(files), ["project_id", "language", "path"]).select("project_id", "file_path", "raw", "target")


def external_packages(files: DataFrame) -> DataFrame:
    """(project_id, file_path, content) -> package imports of scripts that name
    no path: package (first segment, or scope and name), files that use it."""
    raw = F.regexp_extract_all("content", F.lit(r"(?:from\s+|require\(\s*|import\s+)['\"]([^'\"./][^'\"]*)['\"]"), 1)
    r = files.select("project_id", "file_path", F.explode(F.array_distinct(raw)).alias("raw"))
    seg = F.split("raw", "/")
    pack = F.when(F.col("raw").startswith("@") & (F.size(seg) > 1), F.concat_ws("/", F.get(seg, F.lit(0)), F.get(seg, F.lit(1)))).otherwise(F.get(seg, F.lit(0)))
    return r.groupBy("project_id", pack.alias("package")).agg(F.countDistinct("file_path").alias("used_by"))


def disambiguate(nodes: DataFrame) -> DataFrame:
    """(project_id, name, id, type) -> the node a bare name means: a class or
    interface before others, then the smallest id; and how many there were."""
    rank = F.when(F.col("type").isin("Class", "Interface"), 0).otherwise(1)
    g = nodes.groupBy("project_id", "name").agg(F.min(F.struct(rank.alias("r"), "id")).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return g.select("project_id", "name", F.col("b.id").alias("id"), "candidates")


def map_files(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, file_path) of changes to node ids; a path without a node
    keeps a row with a null id (the unmapped list)."""
    return changes.select("project_id", "file_path").distinct().join(nodes.select("project_id", "file_path", "id").distinct(), ["project_id", "file_path"], "left")


def interface_dispatch(edges: DataFrame) -> DataFrame:
    """A call to something that others implement may reach each of them: extra
    CALLS edges of confidence .7, but for those called anyway."""
    call = edges.filter("type = 'CALLS'").select("project_id", "src", "dst").distinct()
    impl = edges.filter("type = 'IMPLEMENTS' AND src <> dst").select("project_id", F.col("src").alias("to"), "dst").distinct()
    more = call.join(impl, ["project_id", "dst"]).select("project_id", "src", F.col("to").alias("dst")).filter("src <> dst").distinct()
    return more.join(call, ["project_id", "src", "dst"], "left_anti").select("project_id", "src", "dst", F.lit("CALLS").alias("type"), F.lit(0.7).alias("confidence"), F.lit("interface-dispatch").alias("reason"))


def gitignore(path: Column, rules: list[str]) -> Column:
    """Whether a path is ignored by rules in the usual syntax; the last rule
    that fits decides, ! takes back. The rules become patterns on the driver."""
    import re

    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        body = rule.lstrip("!")
        folder, rooted = body.endswith("/"), "/" in body.rstrip("/")
        rx = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", body.strip("/")) if t)
        p = ("^" if rooted else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(p), F.lit(not back)).otherwise(out)
    return out
