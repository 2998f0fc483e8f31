"""p2: variant spellings of author names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..plans.registry import Registry
from .names import resolve, variant_pairs

R = Registry()


@R.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(table(spark, d, "author_records"))


@R.add("p2_entities")
def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its author (smallest record_id) and the number of
    records of that author."""
    e = resolve(table(spark, d, "author_records"))
    n = e.groupBy("entity").agg(F.count(F.lit(1)).alias("n_records"))
    return e.join(n, "entity").select("record_id", "entity", "n_records")
