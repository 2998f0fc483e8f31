"""p8: evaluation items that leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..plans.registry import Registry
from .leakage import leaked_items

R = Registry()


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@R.add("p8_items")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that give it away."""
    items = table(spark, d, "eval_items").select("item_id", "suite").dropDuplicates(["item_id"])
    n = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), (F.col("n_docs").isNotNull()).alias("leaked"))
