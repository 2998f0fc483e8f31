"""p7: source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..io import table
from ..plans.registry import Registry
from .syntax import invalid_files, invalid_rates

R = Registry()


@R.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(table(spark, d, "source_files"))


@R.add("p7_rates")
def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(table(spark, d, "source_files"))
