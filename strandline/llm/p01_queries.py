"""p1: functions with their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..io import table
from ..plans.registry import Registry
from .docs import functions_with_docs

R = Registry()


@R.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return functions_with_docs(table(spark, d, "source_files"), content=False).filter("origin = 'own'").select("file_id", "name", "start_line").distinct()


@R.add("p1_pairs")
def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every documented function."""
    return functions_with_docs(table(spark, d, "source_files"))
