"""Text artefacts into graph rows: folders, languages, git logs, markdown,
imports and name resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: extension -> language (fixed values)
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "dart": "dart", "cob": "cobol", "cbl": "cobol",
}
#: path segments that are never analysed (fixed values)
IGNORED = "node_modules vendor dist build target out .git .idea coverage __pycache__ Pods bower_components third_party".split()


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))


def structure(files: DataFrame) -> DataFrame:
    """CONTAINS edges from each folder to its folders and files."""
    parts = F.split("file_path", "/")
    n = F.size(parts)
    steps = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        F.when(k == 1, F.lit("Folder:.")).otherwise(F.concat(F.lit("Folder:"), F.array_join(F.slice(parts, 1, k - 1), "/"))).alias("src"),
        F.concat(F.when(k == n, F.lit("File:")).otherwise(F.lit("Folder:")), F.array_join(F.slice(parts, 1, k), "/")).alias("dst"),
    ))
    return files.select("project_id", F.explode(steps).alias("e")).select("project_id", "e.src", "e.dst").distinct()


_HEAD = r"^([0-9a-f]{40})\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def parse_git_log(log: DataFrame) -> DataFrame:
    """Rows (repo, text) with ``hash|author|mail|iso|message`` headers and
    ``A/M/D/Rnnn/Cnnn`` lines -> one row per file change. The message may hold
    '|'; R* is a rename with both paths, C* an addition, others are dropped. A
    text may hold any number of commits; each is read in its own row, so nothing
    is ordered or shuffled."""
    text = F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n?", "\n"))
    commit = log.select("repo", F.explode(F.split(text, r"\n(?=[0-9a-f]{40}\|)")).alias("c")).filter(F.col("c").rlike(r"^[0-9a-f]{40}\|"))
    lines = commit.select("repo", F.split("c", "\n").alias("l"))
    head = F.get("l", F.lit(0))
    lines = lines.select("repo", *[F.regexp_extract(head, _HEAD, i).alias(c) for i, c in enumerate(("hash", "author", "email", "iso", "message"), 1)], F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line"))
    f = F.split("line", "\t")
    s = F.substring(F.get(f, F.lit(0)), 1, 1)
    kind = F.when(s.isin("A", "C"), "added").when(s == "M", "modified").when(s == "D", "deleted").when(s == "R", "renamed")
    second = F.get(f, F.lit(2))
    return lines.withColumn("change_type", kind).filter(F.col("change_type").isNotNull() & (F.size(f) > 1) & (F.col("hash") != "")).select(
        "repo", "hash", "author", "email", "iso", "message", "change_type", F.when(s == "C", second).otherwise(F.get(f, F.lit(1))).alias("file_path"), F.when(s == "R", second).alias("new_path")
    )


def parse_blame(blame: DataFrame) -> DataFrame:
    """Porcelain blame texts (path, text) -> lines and share per author mail."""
    l = blame.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^author-mail <([^>]*)>"), 1)).alias("email"))
    n = l.groupBy("path", "email").agg(F.count(F.lit(1)).alias("lines"))
    return n.withColumn("share", F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy("path")), 4))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots (project_id, file_path, hash) -> added, deleted, modified."""
    a, b = old.select("project_id", "file_path", F.col("hash").alias("ha")), new.select("project_id", "file_path", F.col("hash").alias("hb"))
    j = a.join(b, ["project_id", "file_path"], "full")
    kind = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "deleted").when(F.col("ha") != F.col("hb"), "modified")
    return j.withColumn("change", kind).filter("change IS NOT NULL").select("project_id", "file_path", "change")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc, text) -> section headings with level and nearest heading above of
    a smaller level."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    h = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))).filter("level > 0").withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,6} ", "")))
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = F.greatest(*[F.coalesce(F.max(F.when(F.col("level") == k, F.col("line_no"))).over(w), F.lit(-1)) * F.when(F.col("level") > k, 1) for k in range(1, 6)])
    return h.withColumn("parent_line", F.coalesce(F.nullif(above, F.lit(-1)), F.lit(-1))).select("doc", "line_no", "level", "title", "parent_line")


def relative_imports(files: DataFrame) -> DataFrame:
    """(project_id, file_path, content) -> raw relative import and the path it
    names, with . and .. resolved (extension open)."""
    raw = files.select("project_id", "file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"from ['\"](\.{1,2}/[^'\"]+)['\"]"), 1))).alias("raw"))
    base = F.split("file_path", "/")
    ups = F.size(F.filter(F.split("raw", "/"), lambda x: x == ".."))
    rest = F.filter(F.split("raw", "/"), lambda x: ~x.isin(".", ".."))
    keep = F.size(base) - 1 - ups
    return raw.withColumn("target", F.when(keep >= 0, F.array_join(F.concat(F.slice(base, 1, keep), rest), "/")))


def resolve_tiers(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (project_id, file, name) to symbols (project_id, file, name, id):
    same file .95, imported file .9, anywhere .5; the best tier counts, and a
    name with more than one candidate there stays open."""
    s = symbols.select("project_id", F.col("file").alias("sf"), "name", "id").distinct()
    same = refs.join(s, ["project_id", "name"]).filter("file = sf").withColumn("tier", F.lit(0.95))
    imp = refs.join(imports.select("project_id", "file", F.col("target").alias("sf")).distinct(), ["project_id", "file"]).join(s, ["project_id", "name", "sf"]).withColumn("tier", F.lit(0.9))
    # one candidate at most is needed anywhere: names with one symbol
    alone = s.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("sf").alias("sf")).filter("n = 1").drop("n")
    glob = refs.join(alone, ["project_id", "name"]).withColumn("tier", F.lit(0.5))
    cols = ["project_id", "file", "name", "id", "tier"]
    every = same.select(*cols).union(imp.select(*cols)).union(glob.select(*cols)).distinct()
    best = every.groupBy("project_id", "file", "name").agg(F.max("tier").alias("tier"))
    hit = every.join(best, ["project_id", "file", "name", "tier"])
    return hit.groupBy("project_id", "file", "name", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def python_symbols(files: DataFrame) -> DataFrame:
    """(file_id, content) of Python files -> functions and classes with lines,
    by the ast module; files that do not parse give nothing."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast
        import warnings

        warnings.simplefilter("ignore")
        for f in frames:
            out = []
            for i, text in zip(f["file_id"], f["content"]):
                try:
                    tree = ast.parse((text or "").removeprefix("﻿"))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        out.append((i, n.name, "Class" if isinstance(n, ast.ClassDef) else "Function", n.lineno, n.end_lineno))
            yield pd.DataFrame(out, columns=["file_id", "name", "kind", "start_line", "end_line"])

    return files.select("file_id", "content").mapInPandas(parse, "file_id bigint, name string, kind string, start_line int, end_line int")
