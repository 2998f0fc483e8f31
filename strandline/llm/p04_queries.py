"""p4: files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..plans.registry import Registry
from .cooccurrence import change_baskets, pairs_together

R = Registry()

_SQL = r"""
WITH cs AS (SELECT DISTINCT ON (change_set_id) change_set_id, project_id, modified, added FROM change_sets),
x AS (SELECT DISTINCT project_id, change_set_id,
        regexp_replace(replace(p, '\', '/'), '^\./', '') AS item
      FROM (SELECT project_id, change_set_id, unnest(list_concat(coalesce(modified, []), coalesce(added, []))) AS p FROM cs)
      WHERE p IS NOT NULL),
t AS (SELECT project_id, count(DISTINCT change_set_id) AS t FROM x GROUP BY 1),
n AS (SELECT project_id, item, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT a.project_id, a.item AS file_a, b.item AS file_b, count(*) AS n_ab
      FROM x a JOIN x b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.change_set_id = b.change_set_id AND a.item < b.item
      GROUP BY 1, 2, 3 HAVING count(*) >= 4),
r AS (SELECT p.*, na.n AS n_a, nb.n AS n_b, t.t AS n_sets
      FROM p JOIN n na ON na.project_id IS NOT DISTINCT FROM p.project_id AND na.item = file_a
             JOIN n nb ON nb.project_id IS NOT DISTINCT FROM p.project_id AND nb.item = file_b
             JOIN t ON t.project_id IS NOT DISTINCT FROM p.project_id
      WHERE n_ab * t.t >= 2 * na.n * nb.n)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs_together(change_baskets(table(spark, d, "change_sets")))


@R.add("p4_found", _SQL + "SELECT project_id, file_a, file_b FROM r")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("grp").alias("project_id"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


@R.add("p4_lift", _SQL + "SELECT project_id, file_a, file_b, n_ab, n_a, n_b, n_sets, round(n_ab * n_sets / (n_a * n_b), 6) AS lift FROM r")
def p4_lift(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(
        F.col("grp").alias("project_id"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"),
        "n_ab", "n_a", "n_b", F.col("n_baskets").alias("n_sets"), F.round("lift", 6).alias("lift"),
    )
