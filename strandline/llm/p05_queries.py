"""p5: files not written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..plans.registry import Registry
from .handwritten import file_scores, machine_files

R = Registry()


@R.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return machine_files(table(spark, d, "source_files"))


@R.add("p5_handwritten")
def p5_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """The files that stay, with their score."""
    return file_scores(table(spark, d, "source_files")).filter("score < 0.5").select("file_id", F.round("score", 4).alias("score"))
