"""p6: history of changing attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..operators.history import OPEN, attribute_log, believed_facts, version_history
from .registry import Registry

R = Registry()

_ENTITY = ("project_id", "relation_id")
_ATTRIBUTES = ("confidence", "reason")

_SQL = """
WITH f AS (
  SELECT project_id, relation_id, confidence, reason, update_id,
         coalesce(epoch_us(valid_from), 0) AS vf, epoch_us(valid_to) AS vt, txn_from
  FROM relation_updates WHERE txn_to IS NULL
), one AS (
  SELECT * FROM f
  QUALIFY row_number() OVER (PARTITION BY project_id, relation_id, vf ORDER BY txn_from DESC, update_id DESC) = 1
), held AS (
  SELECT *, least(coalesce(vt, 4611686018427387904),
                  coalesce(lead(vf) OVER (PARTITION BY project_id, relation_id ORDER BY vf), 4611686018427387904)) AS u
  FROM one
), v AS (SELECT * FROM held WHERE u > vf),
isl AS (
  SELECT *, CASE WHEN lag(u) OVER w IS NOT DISTINCT FROM vf AND lag(confidence) OVER w IS NOT DISTINCT FROM confidence
                  AND lag(reason) OVER w IS NOT DISTINCT FROM reason THEN 0 ELSE 1 END AS n
  FROM v WINDOW w AS (PARTITION BY project_id, relation_id ORDER BY vf)
), g AS (SELECT *, sum(n) OVER (PARTITION BY project_id, relation_id ORDER BY vf) AS i FROM isl),
h AS (
  SELECT project_id, relation_id, confidence, reason, min(vf) AS valid_from_us,
         CASE WHEN max(u) >= 4611686018427387904 THEN -1 ELSE max(u) END AS valid_to_us
  FROM g GROUP BY project_id, relation_id, i, confidence, reason
)
"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    return version_history(table(spark, d, "relation_updates"), _ENTITY, _ATTRIBUTES)


@R.add("p6_found", _SQL + "SELECT project_id, relation_id, CAST(valid_from_us AS BIGINT) AS valid_from_us, CAST(valid_to_us AS BIGINT) AS valid_to_us FROM h")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("project_id", "relation_id", "valid_from_us", "valid_to_us")


@R.add("p6_versions", _SQL + "SELECT project_id, relation_id, confidence, reason, CAST(valid_from_us AS BIGINT) AS valid_from_us, CAST(valid_to_us AS BIGINT) AS valid_to_us FROM h")
def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


@R.add(
    "p6_reason_intervals",
    _SQL
    + """, r AS (SELECT project_id, relation_id, reason, vf, u,
         CASE WHEN lag(u) OVER w IS NOT DISTINCT FROM vf AND lag(reason) OVER w IS NOT DISTINCT FROM reason THEN 0 ELSE 1 END AS n
       FROM v WINDOW w AS (PARTITION BY project_id, relation_id ORDER BY vf)),
     k AS (SELECT *, sum(n) OVER (PARTITION BY project_id, relation_id ORDER BY vf) AS i FROM r)
     SELECT project_id, relation_id, reason, CAST(min(vf) AS BIGINT) AS valid_from_us,
       CAST(CASE WHEN max(u) >= 4611686018427387904 THEN -1 ELSE max(u) END AS BIGINT) AS valid_to_us
     FROM k GROUP BY project_id, relation_id, i, reason""",
)
def p6_reason_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The change log of one attribute, with that attribute's own intervals."""
    log = attribute_log(believed_facts(table(spark, d, "relation_updates"), _ENTITY, _ATTRIBUTES), 2, 2)
    return log.filter("k = 1").select(
        F.col("__e0").alias("project_id"),
        F.col("__e1").alias("relation_id"),
        F.col("a1").alias("reason"),
        F.col("__vf").alias("valid_from_us"),
        F.when(F.col("__end") >= OPEN, F.lit(-1)).otherwise(F.col("__end")).cast("bigint").alias("valid_to_us"),
    )
