"""Point-in-time and change queries over bi-temporal facts.

Intervals are half-open [from, to); a null ``to`` is open, a null ``from`` is
the beginning of time. All are row filters or a join on the entity key, so they
push down to the scan and need no shuffle beyond the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ts(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def holds(frm: str, to: str, t: str) -> Column:
    return (F.col(frm).isNull() | (F.col(frm) <= _ts(t))) & (F.col(to).isNull() | (F.col(to) > _ts(t)))


def valid_at(facts: DataFrame, t: str) -> DataFrame:
    return facts.filter(holds("valid_from", "valid_to", t))


def known_at(facts: DataFrame, t: str) -> DataFrame:
    return facts.filter(holds("txn_from", "txn_to", t))


def as_of(facts: DataFrame, valid_t: str, known_t: str) -> DataFrame:
    """What was valid at one instant as believed at another."""
    return known_at(valid_at(facts, valid_t), known_t)


def within_range(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Facts wholly inside [start, end]."""
    return facts.filter(F.coalesce("valid_from", _ts("1970-01-01 00:00:00")).between(_ts(start), _ts(end)) & (F.coalesce("valid_to", _ts("9999-12-31 23:59:59")) <= _ts(end)))


def changes_between(facts: DataFrame, start: str, end: str, active_only: bool = True) -> DataFrame:
    """Facts that began in (start, end] with the action they stand for."""
    f = facts.filter((F.col("valid_from") > _ts(start)) & (F.col("valid_from") <= _ts(end)))
    if active_only:
        f = f.filter("valid_to IS NULL")
    return f.withColumn("action", F.when(F.col("valid_to").isNull(), "created").otherwise("superseded"))


def truncated(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows and, on each, whether there were more."""
    top = df.orderBy(*order).limit(limit + 1)
    n = top.agg(F.count(F.lit(1)).alias("__n"))
    return top.orderBy(*order).limit(limit).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("__n") > limit).drop("__n")  # one row


def snapshot_diff(facts: DataFrame, key: list[str], t1: str, t2: str) -> DataFrame:
    """Keys added and removed between two instants."""
    a, b = valid_at(facts, t1).select(*key).distinct(), valid_at(facts, t2).select(*key).distinct()
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full")
    return j.filter("a IS NULL OR b IS NULL").select(*key, F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


def supersede(facts: DataFrame, key: list[str], order: list[str], frm: str = "valid_from", to: str = "valid_to") -> DataFrame:
    """Closes each version of a key where the next begins (append-only)."""
    w = Window.partitionBy(*key).orderBy(*order)
    nxt = F.lead(frm).over(w)
    return facts.withColumn(to, F.when(F.col(to).isNull() | (nxt < F.col(to)), nxt).otherwise(F.col(to)))


def archived(facts: DataFrame, now: str, retention_days: int = 90) -> DataFrame:
    """Marks versions that ended before the retention; nothing is deleted."""
    return facts.withColumn("archived", F.coalesce(F.col("valid_to") < F.timestamp_add("DAY", F.lit(-retention_days), _ts(now)), F.lit(False)))


def close_for_nodes(facts: DataFrame, nodes: DataFrame, t: str) -> DataFrame:
    """Closes, in both times, the open documentation edges of nodes (project_id,
    id): DESCRIBES to them and DOCUMENTED_BY from them. Closed edges stay as they
    are, so closing again changes nothing."""
    end = F.when(F.col("type") == "DESCRIBES", F.col("dst")).when(F.col("type") == "DOCUMENTED_BY", F.col("src"))
    n = nodes.select("project_id", F.col("id").alias("__id"), F.lit(True).alias("__hit")).distinct()
    j = facts.withColumn("__id", end).join(n, ["project_id", "__id"], "left")
    hit = F.col("__hit") & F.col("valid_to").isNull()
    return j.withColumn("txn_to", F.when(hit, _ts(t)).otherwise(F.col("txn_to"))).withColumn("valid_to", F.when(hit, _ts(t)).otherwise(F.col("valid_to"))).drop("__id", "__hit")


def temporal_edges(changes: DataFrame) -> DataFrame:
    """(project_id, commit_hash, ts, file_path) -> CHANGED_IN edges from files to
    commits, valid from the commit on."""
    c = changes.filter("commit_hash IS NOT NULL").select("project_id", F.concat(F.lit("File:"), "file_path").alias("src"), F.concat(F.lit("Commit:"), "commit_hash").alias("dst"), "ts")
    return c.groupBy("project_id", "src", "dst").agg(F.min("ts").alias("valid_from")).withColumn("type", F.lit("CHANGED_IN"))
