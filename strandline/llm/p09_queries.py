"""p9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..io import table
from ..plans.registry import Registry
from ..session import cut
from .mixing import counted_documents, mix, mix_report

R = Registry()


@R.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(counted_documents(table(spark, d, "documents")))
    return mix(docs, table(spark, d, "mix_targets"))


@R.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(counted_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))
