"""Rename chains to their end, community bus factor, drift, history-only level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import coupling as C
from .graph import best_jaccard, components_by


def rename_terminals(renames: DataFrame) -> DataFrame:
    """(project, old, new) -> every old path with its last name and the number
    of renames to it. Of several renames of one path the smallest new name
    counts. Pointers double each round, so a chain of n renames takes log n
    joins; paths on a cycle have no end and are left out."""
    r = renames.filter("old <> new").groupBy("project", F.col("old").alias("start")).agg(F.min("new").alias("at"))
    r = cut(r.withColumn("hops", F.lit(1).cast("bigint")))
    longest = r.groupBy("project").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        step = r.select("project", F.col("start").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        r = cut(r.join(step, ["project", "at"], "left").select("project", "start", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    ends = r.join(r.select("project", F.col("start").alias("at")), ["project", "at"], "left_anti")
    return ends.select("project", "start", F.col("at").alias("current"), "hops")


def community_bus_factor(owned: DataFrame, least: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """(module, author, ownership) -> bus factor over modules: only shares above
    ``least`` count, the largest of a module (ties: smaller author) is its
    primary author; -1 where there is none."""
    strong = owned.filter(F.col("ownership") > least)
    top = strong.groupBy("module").agg(F.max("ownership").alias("ownership"))
    primary = strong.join(top, ["module", "ownership"]).groupBy("module").agg(F.min("author").alias("author"))
    b = C.bus_factor(primary.select(F.col("module").alias("node"), "author"), threshold)
    return b.select(F.when(F.col("modules") == 0, F.lit(-1).cast("bigint")).otherwise(F.col("bus_factor")).alias("bus_factor"), "authors", "modules")


def module_authors(members: DataFrame, owned: DataFrame) -> DataFrame:
    """Two hops: (module, node) and (node, author, ...) -> authors of a module."""
    return members.join(owned, "node").groupBy("module", "author").agg(F.countDistinct("node").alias("nodes"), F.max("ownership").alias("ownership"))


def drift(communities: DataFrame, coupled: DataFrame, limit: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Structural communities (project_id, community, node) against clusters of
    coupled nodes (project_id, node_a, node_b).

    -> per community its best Jaccard similarity and whether it drifted (below
    ``limit``); per project the divergence 1 - mean, -1 without coupled nodes.
    """
    cluster = components_by(coupled, ["project_id"], "node_a", "node_b")
    one = lambda d, c: d.select(F.struct("project_id", F.col(c).alias("c")).alias("set"), F.struct("project_id", "node").alias("member")).distinct()
    best = best_jaccard(one(communities, "community"), one(cluster, "root")).select("set.project_id", F.col("set.c").alias("community"), "best")
    has = coupled.select("project_id").distinct().withColumn("has", F.lit(True))
    per = best.withColumn("drifted", F.col("best") < limit)
    total = per.groupBy("project_id").agg(F.count(F.lit(1)).alias("communities"), F.count_if("drifted").alias("drifted"), F.round(1 - F.avg("best"), 6).alias("d"))
    total = total.join(has, "project_id", "left").select("project_id", "communities", "drifted", F.when(F.col("has"), F.col("d")).otherwise(-1.0).alias("divergence"))
    return per, total


def history_only(changes: DataFrame) -> DataFrame:
    """(project_id, commit_hash, node) -> every pair of files that changed
    together, from history alone: no window, no noise filter; support over the
    project's commits, confidence over those of node_a."""
    pairs = C.pair_counts(changes, ["project_id"])
    n = changes.groupBy("project_id", F.col("node").alias("node_a")).agg(F.countDistinct("commit_hash").alias("n"))
    t = changes.groupBy("project_id").agg(F.countDistinct("commit_hash").alias("t"))
    j = pairs.join(n, ["project_id", "node_a"]).join(t, "project_id")
    return j.select("project_id", "node_a", "node_b", "co_changes", F.round(F.col("co_changes") / F.col("t"), 8).alias("support"), F.round(F.col("co_changes") / F.col("n"), 8).alias("confidence"))


def analysis_level(files: Column, forced: Column, threshold: int = 50_000) -> Column:
    """Level of analysis: the forced one, else history only for large projects."""
    return F.coalesce(forced, F.when(files >= threshold, "L0_GIT_LOG").otherwise("L2_FULL"))


def both_directions(metrics: DataFrame) -> DataFrame:
    """CO_CHANGED_WITH edges of coupling metrics (group columns first), one per
    direction with that direction's confidence."""
    group = [c for c in metrics.columns if c not in ("node_a", "node_b", "co_changes", "support", "confidence_ab", "confidence_ba", "lift")]
    one = lambda a, b, c: metrics.select(*group, F.col(a).alias("src"), F.col(b).alias("dst"), F.lit("CO_CHANGED_WITH").alias("type"), F.col(c).alias("confidence"), "co_changes", "support", "lift")
    return one("node_a", "node_b", "confidence_ab").union(one("node_b", "node_a", "confidence_ba"))
