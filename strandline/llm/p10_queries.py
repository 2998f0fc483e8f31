"""p10: template residue and error pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..io import table
from ..plans.registry import Registry
from .residue import clean_documents, residue_documents

R = Registry()


@R.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents"))


@R.add("p10_kept")
def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents that stay once residue is left out."""
    return clean_documents(table(spark, d, "documents"))
