"""Derived documentation: classification, selection, freshness, lint, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def doc_class(path: Column, head: Column) -> Column:
    """Confidence that a file is documentation: by extension 1.0, known name
    .9, docs folder .9, text that looks like markdown .7, else 0."""
    p = F.lower(path)
    name = F.element_at(F.split(p, "/"), -1)
    marks = F.substring(head, 1, 1024).rlike(r"(?m)^#{1,6} |^```|^[-*] |\[[^\]]+\]\([^)]+\)")
    return (
        F.when(p.rlike(r"\.(md|mdx|rst|adoc)$"), 1.0).when(name.rlike(r"^(readme|changelog|contributing|license|authors|notice)(\..*)?$"), 0.9)
        .when(p.rlike(r"(^|/)(docs?|documentation|wiki)/"), 0.9).when(p.endswith(".txt") & marks, 0.7).otherwise(0.0)
    )


def signature(header: Column, body: Column) -> tuple[Column, Column]:
    """Hashes of the header line and of the body without blanks."""
    return F.sha2(F.trim(header), 256), F.sha2(F.regexp_replace(body, r"\s+", ""), 256)


def freshness(entities: DataFrame, code: DataFrame) -> DataFrame:
    """entities (entity_id, code_id, sig, ast), code (code_id, sig, ast) ->
    unbound, orphaned, stale or fresh."""
    c = code.select("code_id", F.col("sig").alias("csig"), F.col("ast").alias("cast_"), F.lit(True).alias("there"))
    j = entities.join(c, "code_id", "left")
    state = (
        F.when(F.col("code_id").isNull(), "unbound").when(F.col("there").isNull(), "orphaned")
        .when(F.col("sig").eqNullSafe(F.col("csig")) & F.col("ast").eqNullSafe(F.col("cast_")), "fresh").otherwise("stale")
    )
    return j.select("entity_id", "code_id", state.alias("state"))


def select_by_rules(candidates: DataFrame, rules: list[tuple[str, Column, int, int]], total: int) -> DataFrame:
    """Entities picked by rules (name, condition, priority, cap): the first
    rule that fits counts, at most ``cap`` per rule and ``total`` per project,
    by degree. The caps are the feature."""
    name = pri = cap = None
    for n, cond, p, c in sorted(rules, key=lambda r: r[2]):
        name = F.when(cond, n) if name is None else name.when(cond, n)
        pri = F.when(cond, p) if pri is None else pri.when(cond, p)
        cap = F.when(cond, c) if cap is None else cap.when(cond, c)
    c = candidates.withColumn("rule", name).withColumn("__p", pri).withColumn("__c", cap).filter("rule IS NOT NULL")
    w = Window.partitionBy("project_id", "rule").orderBy(F.col("degree").desc(), "id")
    c = c.withColumn("__r", F.row_number().over(w)).filter("__r <= __c")
    wt = Window.partitionBy("project_id").orderBy("__p", "__r", "id")
    return c.withColumn("__t", F.row_number().over(wt)).filter(F.col("__t") <= total).select("project_id", "id", "rule")
