"""Change history mining: hotspots, ownership, coupling, bus factor, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONTH_S = 86_400 * 30.44


def seconds(a: Column | str, b: Column | str) -> Column:
    """Seconds from a to b (timestamps without zone)."""
    return F.timestamp_diff("MICROSECOND", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b) / F.lit(1e6)


def hotspots(changes: DataFrame, keys: list[str], group: list[str], high: float = 50, medium: float = 10) -> DataFrame:
    """Changes per month of each key; months span the group's history."""
    per = changes.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("change_count"), F.max("ts").alias("last_change"))
    span = changes.groupBy(*group).agg(F.min("ts").alias("__a"), F.max("ts").alias("__b")) if group else changes.agg(F.min("ts").alias("__a"), F.max("ts").alias("__b"))
    j = per.join(span, group) if group else per.crossJoin(F.broadcast(span))  # one row
    months = F.greatest(F.lit(1.0), seconds("__a", "__b") / MONTH_S)
    j = j.withColumn("per_month", F.round(F.col("change_count") / months, 6)).drop("__a", "__b")
    return j.withColumn("risk", F.when(F.col("per_month") > high, "high").when(F.col("per_month") >= medium, "medium").otherwise("low"))


def ownership(changes: DataFrame) -> DataFrame:
    """Share of each author in the changes of a node."""
    per = changes.groupBy("node", "author").agg(F.count(F.lit(1)).alias("change_count"), F.max("ts").alias("last_change"))
    total = per.groupBy("node").agg(F.sum("change_count").alias("__t"))
    return per.join(total, "node").withColumn("ownership", F.round(F.col("change_count") / F.col("__t"), 6)).drop("__t")


def experts(owned: DataFrame) -> DataFrame:
    """The author with the largest share of each node (ties: smaller id)."""
    best = owned.groupBy("node").agg(F.max(F.struct("ownership", -F.col("author"))).alias("b"))
    return best.select("node", (-F.col("b").getField("col2")).alias("author"), F.col("b.ownership").alias("ownership"))


def primary_authors(changes: DataFrame) -> DataFrame:
    """(node, author): who changed a node most often (ties: smaller id)."""
    per = changes.groupBy("node", "author").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("node").agg(F.max(F.struct("n", -F.col("author"))).alias("b"))
    return best.select("node", (-F.col("b").getField("col2")).alias("author"))


def bus_factor(primary: DataFrame, threshold: float = 0.5, order: str = "asc") -> DataFrame:
    """Authors that must leave until more than floor(N * threshold) nodes have
    no primary author; authors leave by owned nodes (asc as the reference
    does, or desc). ``primary`` has node and author, one row per node."""
    owned = primary.groupBy("author").agg(F.count(F.lit(1)).alias("owned"))
    # authors with equally many nodes are one row: with N nodes there are at
    # most sqrt(2N) such rows, so one task can take their running totals
    level = owned.groupBy("owned").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy(F.col("owned").asc() if order == "asc" else F.col("owned").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = level.withColumn("__left", F.coalesce(F.sum("__c").over(w), F.lit(0))).withColumn("__lost", F.coalesce(F.sum(F.col("__c") * F.col("owned")).over(w), F.lit(0)))
    n = primary.agg(F.count(F.lit(1)).alias("modules"))
    most = F.floor(F.col("modules") * threshold)
    # inside a row every author takes the same number
    rank = F.col("__left") + F.floor((most - F.col("__lost")) / F.col("owned")) + 1
    inside = (F.col("__lost") <= most) & (most < F.col("__lost") + F.col("__c") * F.col("owned"))
    hit = run.crossJoin(F.broadcast(n)).agg(F.min(F.when(inside, rank)).alias("f"), F.sum("__c").alias("authors"), F.max("modules").alias("modules"))  # one row
    authors = F.coalesce("authors", F.lit(0))
    return hit.select(F.coalesce("f", authors).cast("bigint").alias("bus_factor"), authors.cast("bigint").alias("authors"), F.coalesce("modules", F.lit(0)).alias("modules"))


#: nodes of a commit that are paired at once
PAIR_BLOCK = 256


def pair_counts(changes: DataFrame, group: list[str], max_width: int | None = None, min_count: int = 1) -> DataFrame:
    """How often two nodes change in one commit (node_a < node_b), pairs with
    at least ``min_count`` commits. A node in fewer commits has no such pair and
    is left out before anything is paired. Each commit is cut into blocks and
    pairs of blocks are expanded row by row, so a wide commit is never squared
    in memory; ``max_width`` leaves out wider commits (off by default)."""
    rows = changes.select(*group, "node", "commit_hash").distinct()
    if min_count > 1:
        often = rows.groupBy(*group, "node").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_count)
        rows = rows.join(often.drop("__n"), [*group, "node"], "left_semi")
    packed = rows.groupBy(*group, "commit_hash").agg(F.array_sort(F.collect_list("node")).alias("ns")).filter(F.size("ns") > 1)
    if max_width:
        packed = packed.filter(F.size("ns") <= max_width)
    last = F.floor((F.size("ns") - 1) / PAIR_BLOCK).cast("int")
    block = lambda i: F.slice("ns", F.col(i) * PAIR_BLOCK + 1, PAIR_BLOCK)
    at = packed.select(*group, "ns", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    at = at.select(*group, block("i").alias("xs"), "i", "ns", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    pairs = at.select(*group, F.explode("xs").alias("node_a"), block("j").alias("ys")).select(*group, "node_a", F.explode("ys").alias("node_b")).filter("node_a < node_b")
    pairs = pairs.groupBy(*group, "node_a", "node_b").agg(F.count(F.lit(1)).alias("co_changes"))
    return pairs.filter(F.col("co_changes") >= min_count) if min_count > 1 else pairs


def coupling(pairs: DataFrame, changes: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Support, both confidences and lift of pairs. ``totals`` has the number
    of commits (col total) per group, or one row."""
    n = changes.groupBy(*group, "node").agg(F.countDistinct("commit_hash").alias("n"))
    a = n.select(*group, F.col("node").alias("node_a"), F.col("n").alias("n_a"))
    b = n.select(*group, F.col("node").alias("node_b"), F.col("n").alias("n_b"))
    j = pairs.join(a, [*group, "node_a"]).join(b, [*group, "node_b"])
    j = j.join(totals, group) if group else j.crossJoin(F.broadcast(totals))  # one row
    s = F.col("co_changes") / F.col("total")
    both = F.col("n_a") * F.col("n_b")
    return j.select(
        *group, "node_a", "node_b", "co_changes", F.round(s, 8).alias("support"), F.round(F.col("co_changes") / F.col("n_a"), 8).alias("confidence_ab"),
        F.round(F.col("co_changes") / F.col("n_b"), 8).alias("confidence_ba"), F.round(F.when(both > 0, F.col("co_changes") * F.col("total") / both).otherwise(0.0), 8).alias("lift"),
    )


def strong(metrics: DataFrame, support: float = 0.01, count: int = 2, lift: float = 1.0) -> DataFrame:
    return metrics.filter((F.col("support") >= support) & (F.col("co_changes") >= count) & (F.col("lift") > lift))


def stability(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Route rows (keys, commit, ts; null commit = never changed) -> stability
    and class."""
    g = routes.groupBy(*keys).agg(F.countDistinct("commit").alias("change_count"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("change_count") * 0.1))
    months = seconds("a", "b") / MONTH_S
    f = F.when(F.col("change_count") == 0, 0.0).when(months >= 1, F.col("change_count") / months).otherwise(F.col("change_count").cast("double"))
    out = g.withColumn("stability", F.round(s, 6)).withColumn("frequency", F.round(f, 6))
    return out.withColumn("class", F.when(F.col("stability") >= 0.8, "stable").when(F.col("stability") >= 0.5, "moderate").otherwise("volatile")).drop("a", "b")


def active_islands(days: DataFrame, group: list[str], factor: float = 2.0, least: int = 7) -> DataFrame:
    """Runs of at least ``least`` consecutive days, each with more than
    ``factor`` times the average commits per day. ``days`` has day and n."""
    span = days.groupBy(*group).agg((F.sum("n") / (F.datediff(F.max("day"), F.min("day")) + 1)).alias("avg"))
    hot = days.join(span, group).filter(F.col("n") > factor * F.col("avg"))
    w = Window.partitionBy(*group).orderBy("day")
    isl = hot.withColumn("g", F.date_sub("day", F.row_number().over(w)))
    return isl.groupBy(*group, "g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= least).drop("g")


def gaps(commits: DataFrame, group: list[str], more_than_days: int = 30) -> DataFrame:
    """Pauses longer than so many days between neighbouring commits."""
    w = Window.partitionBy(*group).orderBy("ts", "hash")
    g = commits.withColumn("prev", F.lag("ts").over(w)).withColumn("gap_days", F.round(seconds("prev", "ts") / 86_400, 6))
    return g.filter(F.col("gap_days") > more_than_days).select(*group, "hash", F.col("prev").alias("gap_from"), F.col("ts").alias("gap_to"), "gap_days")
