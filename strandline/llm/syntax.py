"""Source files that do not parse.

The language follows from the extension of the path. A file is flagged if every
dialect of that language rejects it (scripts and modules for JavaScript and
TypeScript run together in one generalised LL parse); a leading byte order mark
does not matter, and a file without text is valid.

Scale: files are spread by their key, so a project that holds a third of all
files is no hot spot; a parse is linear in the tokens where one token decides,
and needs memory for one file at a time. Rates are a map-side combined
aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once

#: extension -> language (fixed values)
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "go": "go", "rs": "rust",
}


def path_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def valid(text: str | None, language: str | None) -> bool | None:
    """Whether the text parses; None where there is no text or language."""
    from .grammars import parses

    if text is None or language is None:
        return None
    return not text.strip("﻿ \t\r\n\f") or parses(text, language)


def parsed_files(files: DataFrame) -> DataFrame:
    """file_id, project_id, file_path, language, valid: one row per file.

    ``files`` has file_id, project_id, file_path and content. Null ids take no
    part; a null content or path, or an extension without a grammar, gives
    valid = null and is never flagged; repeated rows count once; whole texts are
    read, however long; other columns are ignored.
    """
    rows = once(files.select("file_id", "project_id", "file_path", "content").filter("file_id IS NOT NULL"), "file_id")
    rows = rows.withColumn("language", path_language(F.col("file_path")))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.astype(object).where(f.notna(), None)
            f["valid"] = [valid(c, lang) for c, lang in zip(f["content"], f["language"])]
            yield f[["file_id", "project_id", "file_path", "language", "valid"]]

    return rows.mapInPandas(parse, "file_id bigint, project_id string, file_path string, language string, valid boolean")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that do not parse."""
    return parsed_files(files).filter("valid = false").select("file_id")


def invalid_rates(files: DataFrame) -> DataFrame:
    """project_id, language, n_files, n_invalid, share per project and language."""
    p = parsed_files(files).filter("language IS NOT NULL")
    g = p.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("valid") == F.lit(False)).alias("n_invalid"))
    return g.withColumn("share", F.round(F.col("n_invalid") / F.col("n_files"), 6))
