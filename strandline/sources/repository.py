"""Repository files and git exports as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ignored, language, parse_git_log

MAX_BYTES = 512 * 1024
#: stands before each commit of an exported log
RECORD = "\x1e"
#: extensions of binary files (fixed values)
BINARY = "png jpg jpeg gif ico pdf zip gz tar jar class exe dll so dylib woff woff2 ttf eot mp3 mp4 mov wav bin dat parquet".split()


def walk(spark: SparkSession, root: str, project_id: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of a repository: project_id, file_path, size, language, content.
    Size, extension and folder filters act on the listing, before contents are
    read; files that hold a null byte are binary and left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + root.rstrip("/") + "/" if not root.startswith(("file:", "hdfs:", "s3")) else root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^(file:)/+", "file:/")
    rel = F.substring(path, F.lit(len(base) + 1), F.length(path))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    f = raw.filter((F.col("length") <= max_bytes) & ~ext.isin(*BINARY)).withColumn("file_path", rel).filter(~ignored(F.col("file_path")))
    text = f.withColumn("content", F.decode("content", "UTF-8")).filter(~F.col("content").contains("\0"))
    return text.select(F.lit(project_id).alias("project_id"), "file_path", F.col("length").alias("size"), language(F.col("file_path")).alias("language"), "content")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """File changes from exported logs (text files, a record separator before
    each commit, so a long log is read as many rows)."""
    t = spark.read.text(path, lineSep=RECORD).withColumn("repo", F.col("_metadata.file_name"))
    return parse_git_log(t.select("repo", F.col("value").alias("text")))


def export_git_log(repo: str, since: str | None = None, max_commits: int = 10_000) -> str:
    """Runs git on the driver and returns the log text git_log reads."""
    cmd = ["git", "-C", repo, "log", "--no-merges", "--name-status", f"-n{max_commits}", f"--format={RECORD}%H|%an|%ae|%aI|%s"]
    if since:
        cmd.append(f"{since}..HEAD" if len(since) >= 7 and all(c in "0123456789abcdef" for c in since) else f"--since={since}")
    return subprocess.run(cmd, check=True, capture_output=True, text=True, timeout=300).stdout
