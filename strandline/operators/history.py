"""History of changing entity attributes (bi-temporal facts -> versions).

An event-sourced log per attribute: each attribute of an entity gets its own
intervals; the attributes are then combined by splitting at the union of the
boundary instants and equal neighbours are coalesced.

Scale: facts of one instant are reduced map-side (groupBy on entity and
instant). Entities with more than ``hot`` instants are cut into buckets whose
edges are instants of that entity, so a bucket is closed: its last fact ends
where the next bucket starts. All windows run inside (entity, bucket); only
the first and last version of a bucket take part in the merge over bucket
edges. No task ever sees all rows of a hot entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: distinct instants of one entity that one task may order
HOT_INSTANTS = 200_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone (or with one,
    read in the session's zone)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def believed_facts(
    facts: DataFrame,
    entity: Sequence[str],
    attributes: Sequence[str],
    fact_id: str = "update_id",
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    txn_from: str = "txn_from",
    txn_to: str = "txn_to",
) -> DataFrame:
    """The fact that holds at each (entity, valid_from) as now believed.

    Facts with a txn_to are withdrawn. A null valid_from is the epoch. Of facts
    with the same valid_from the one with the latest txn_from holds (a null
    txn_from is the earliest), then the larger fact id. A fact that was
    delivered twice competes with itself, so repeats need no extra pass.
    Returns __e0.. (entity), __vf, __vt (null = open) and __a0.. (attributes).
    """
    rows = facts.filter(F.col(txn_to).isNull()).select(
        *[F.col(c).alias(f"__e{i}") for i, c in enumerate(entity)],
        F.coalesce(micros(valid_from), F.lit(0)).cast("bigint").alias("__vf"),
        F.struct(
            F.coalesce(micros(txn_from), F.lit(-(2**62))).alias("o1"),
            F.col(fact_id).alias("o2"),
        ).alias("__o"),
        F.struct(micros(valid_to).alias("vt"), *[F.col(a).alias(f"a{i}") for i, a in enumerate(attributes)]).alias("__f"),
    )
    keys = [f"__e{i}" for i in range(len(entity))]
    best = rows.groupBy(*keys, "__vf").agg(F.max_by("__f", "__o").alias("__f"))
    return best.select(*keys, "__vf", F.col("__f.vt").alias("__vt"), *[F.col(f"__f.a{i}").alias(f"__a{i}") for i in range(len(attributes))])


def _bucketed(rows: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """Adds __b, the bucket of the row, and __edge, the start of the next
    bucket (null in the last). Bucket edges are instants of the entity."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot)
    # edges per hot entity: 1000 buckets at most, so a bucket holds a thousandth
    hot_keys = rows.join(n.select(*[F.col(k).alias(f"h{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys], "left_semi")
    edges = hot_keys.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("__vf", [i / 1000.0 for i in range(1, 1000)], 10_000)).alias("__edges")
    )
    edges = edges.select(*[F.col(k).alias(f"h{k}") for k in keys], F.array_sort("__edges").alias("__edges"))
    r = rows.join(edges, [F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys], "left")
    passed = F.coalesce(F.size(F.filter("__edges", lambda e: e <= F.col("__vf"))), F.lit(0))
    passed = F.when(F.col("__edges").isNull(), F.lit(0)).otherwise(passed)
    return r.withColumn("__b", passed).withColumn("__edge", F.get("__edges", F.col("__b"))).drop("__edges", *[f"h{k}" for k in keys])


def _islands(rows: DataFrame, keys: list[str], order: str, until: str, same: list[str]) -> DataFrame:
    """Coalesces rows that touch (until == next order) and agree on ``same``
    (null equals null) within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~(F.lag(until).over(w).eqNullSafe(F.col(order)))
    for c in same:
        new = new | ~F.lag(F.struct(F.col(c))).over(w).eqNullSafe(F.struct(F.col(c)))
    r = rows.withColumn("__new", F.when(new, 1).otherwise(0))
    r = r.withColumn("__i", F.sum("__new").over(w))
    return r.groupBy(*keys, "__i", *same).agg(F.min(order).alias(order), F.max(until).alias(until)).drop("__i")


#: an open end, larger than any instant in micros
OPEN = 2**62


def attribute_log(believed: DataFrame, n_entity: int, n_attr: int, hot: int = HOT_INSTANTS) -> DataFrame:
    """Per-attribute change log: one row per (entity, bucket, attribute
    number, interval) with the value kept in the attribute's own column."""
    keys = [f"__e{i}" for i in range(n_entity)]
    b = _bucketed(believed, keys, hot)
    w = Window.partitionBy(*keys, "__b").orderBy("__vf")
    nxt = F.coalesce(F.lead("__vf").over(w), F.col("__edge"), F.lit(OPEN))
    held = b.withColumn("__end", F.least(F.coalesce("__vt", F.lit(OPEN)), nxt)).filter(F.col("__end") > F.col("__vf"))
    each = [F.struct(F.lit(k).alias("k"), *[(F.col(f"__a{i}") if i == k else F.lit(None).cast(believed.schema[f"__a{i}"].dataType)).alias(f"a{i}") for i in range(n_attr)]) for k in range(n_attr)]
    one = held.select(*keys, "__b", "__vf", "__end", F.inline(F.array(*each)))
    return _islands(one, [*keys, "__b", "k"], "__vf", "__end", [f"a{i}" for i in range(n_attr)])


def version_history(
    facts: DataFrame,
    entity: Sequence[str],
    attributes: Sequence[str],
    hot: int = HOT_INSTANTS,
    **columns: str,
) -> DataFrame:
    """One row per version of an entity: entity, attributes, valid_from_us,
    valid_to_us (-1 while open).

    Defined cases: an empty table gives no rows; null entity keys form an
    entity of their own; null attributes are values (null equals null); other
    columns of ``facts`` are ignored, whatever their names; repeated rows
    count once; facts of no (or negative) length end the one before and are no
    version.
    """
    n_e, n_a = len(entity), len(attributes)
    keys = [f"__e{i}" for i in range(n_e)]
    vals = [f"a{i}" for i in range(n_a)]
    log = attribute_log(believed_facts(facts, entity, attributes, **columns), n_e, n_a, hot)
    # boundary events: a start sets the attribute's state, an end clears it; at
    # the same instant the start wins
    start = F.struct(F.col("__vf").alias("t"), F.lit(1).alias("on"))
    end = F.struct(F.col("__end").alias("t"), F.lit(0).alias("on"))
    ev = log.withColumn("__x", F.explode(F.array(start, end))).select(*keys, "__b", "k", *vals, F.col("__x.t").alias("t"), F.col("__x.on").alias("on"))
    state = [
        F.max_by(F.struct("on", F.when(F.col("on") == 1, F.col(v)).alias("v")), F.when(F.col("k") == i, F.col("on"))).alias(f"s{i}")
        for i, v in enumerate(vals)
    ]
    at = ev.groupBy(*keys, "__b", "t").agg(*state)
    w = Window.partitionBy(*keys, "__b").orderBy("t")
    seg = at.select(
        *keys,
        "__b",
        F.col("t").alias("f"),
        F.lead("t").over(w).alias("u"),
        *[F.last(f"s{i}", ignorenulls=True).over(w).alias(f"s{i}") for i in range(n_a)],
    ).filter(F.col("u").isNotNull())
    alive = F.lit(False)
    for i in range(n_a):
        alive = alive | (F.coalesce(F.col(f"s{i}.on"), F.lit(0)) == 1)
    seg = seg.filter(alive).select(*keys, "__b", "f", "u", *[F.col(f"s{i}.v").alias(v) for i, v in enumerate(vals)])
    inner = _islands(seg, [*keys, "__b"], "f", "u", vals)
    # merge over bucket edges: only the first and the last version of a bucket
    wb = Window.partitionBy(*keys, "__b")
    inner = inner.withColumn("__edge_row", (F.col("__b") >= 0) & ((F.col("f") == F.min("f").over(wb)) | (F.col("f") == F.max("f").over(wb))))
    # an entity in one bucket has nothing to merge, and stays where it is
    edge = _islands(inner.filter("__edge_row").drop("__edge_row", "__b"), keys, "f", "u", vals)
    done = edge.unionByName(inner.filter("NOT __edge_row").drop("__edge_row", "__b"))
    return done.select(
        *[F.col(k).alias(c) for k, c in zip(keys, entity)],
        *[F.col(v).alias(c) for v, c in zip(vals, attributes)],
        F.col("f").alias("valid_from_us"),
        F.when(F.col("u") >= OPEN, F.lit(-1)).otherwise(F.col("u")).cast("bigint").alias("valid_to_us"),
    )
