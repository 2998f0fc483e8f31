"""Queries on bi-temporal facts and change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..io import table
from ..operators import bitemporal as B
from ..operators import coupling as C
from . import canon
from .canon import with_
from .registry import Registry

R = Registry()
T1, T2 = "2024-06-01 00:00:00", "2025-03-01 00:00:00"
_E = "project_id, src, dst, type"
_FACT = "update_id, project_id, src, dst, type, confidence, reason"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return canon.facts(spark, d)


def _cols(df: DataFrame) -> DataFrame:
    return df.select(*_FACT.split(", "))


_VALID = "(valid_from IS NULL OR valid_from <= TIMESTAMP '{t}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{t}')"
_KNOWN = "(txn_from IS NULL OR txn_from <= TIMESTAMP '{t}') AND (txn_to IS NULL OR txn_to > TIMESTAMP '{t}')"


@R.add("asof_valid", with_("facts") + f"SELECT {_FACT} FROM facts WHERE {_VALID.format(t=T1)}")
def asof_valid(spark: SparkSession, d: str) -> DataFrame:
    return _cols(canon.facts(spark, d, lambda f: B.valid_at(f, T1)))


@R.add("asof_known", with_("facts") + f"SELECT {_FACT} FROM facts WHERE {_KNOWN.format(t=T1)}")
def asof_known(spark: SparkSession, d: str) -> DataFrame:
    return _cols(canon.facts(spark, d, lambda f: B.known_at(f, T1)))


@R.add("asof_both", with_("facts") + f"SELECT {_FACT} FROM facts WHERE {_VALID.format(t=T1)} AND {_KNOWN.format(t=T2)}")
def asof_both(spark: SparkSession, d: str) -> DataFrame:
    return _cols(canon.facts(spark, d, lambda f: B.as_of(f, T1, T2)))


@R.add("code_as_of", with_("facts") + f"SELECT project_id, src AS node, 'out' AS direction, dst AS other, type FROM facts WHERE {_VALID.format(t=T1)} UNION ALL SELECT project_id, dst, 'in', src, type FROM facts WHERE {_VALID.format(t=T1)}")
def code_as_of(spark: SparkSession, d: str) -> DataFrame:
    v = canon.facts(spark, d, lambda f: B.valid_at(f, T1))
    out = v.select("project_id", F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "type")
    return out.union(v.select("project_id", "dst", F.lit("in"), "src", "type"))


@R.add("relations_in_range", with_("facts") + f"SELECT {_FACT} FROM facts WHERE coalesce(valid_from, TIMESTAMP '1970-01-01') BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}' AND coalesce(valid_to, TIMESTAMP '9999-12-31 23:59:59') <= TIMESTAMP '{T2}'")
def relations_in_range(spark: SparkSession, d: str) -> DataFrame:
    return _cols(canon.facts(spark, d, lambda f: B.within_range(f, T1, T2)))


@R.add("changes_between", with_("facts") + f"SELECT update_id, project_id, type, valid_from, CASE WHEN valid_to IS NULL THEN 'created' ELSE 'superseded' END AS action FROM facts WHERE valid_from > TIMESTAMP '{T1}' AND valid_from <= TIMESTAMP '{T2}'")
def changes_between(spark: SparkSession, d: str) -> DataFrame:
    return canon.facts(spark, d, lambda f: B.changes_between(f, T1, T2, active_only=False)).select("update_id", "project_id", "type", "valid_from", "action")


@R.add(
    "changes_between_top",
    with_("facts") + f"SELECT update_id, valid_from, (SELECT count(*) FROM facts WHERE valid_from > TIMESTAMP '{T1}' AND valid_from <= TIMESTAMP '{T2}' AND valid_to IS NULL) > 50 AS truncated FROM facts "
    f"WHERE valid_from > TIMESTAMP '{T1}' AND valid_from <= TIMESTAMP '{T2}' AND valid_to IS NULL ORDER BY valid_from DESC, update_id LIMIT 50",
)
def changes_between_top(spark: SparkSession, d: str) -> DataFrame:
    c = canon.facts(spark, d, lambda f: B.changes_between(f, T1, T2)).select("update_id", "valid_from")
    return B.truncated(c, [F.col("valid_from").desc(), F.col("update_id")], 50)


@R.add(
    "snapshot_diff",
    with_("facts") + f", a AS (SELECT DISTINCT {_E} FROM facts WHERE {_VALID.format(t=T1)}), b AS (SELECT DISTINCT {_E} FROM facts WHERE {_VALID.format(t=T2)}) "
    f"SELECT {_E}, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT {_E}, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return B.snapshot_diff(canon.delivered(spark, d), _E.split(", "), T1, T2)


@R.add(
    "supersede_chain",
    "SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders",
)
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return B.supersede(o, ["o_custkey"], ["valid_from", "o_orderkey"])


@R.add("archived_versions", with_("facts") + f"SELECT update_id, coalesce(valid_to < TIMESTAMP '{T2}' - INTERVAL 90 DAY, false) AS archived FROM facts")
def archived_versions(spark: SparkSession, d: str) -> DataFrame:
    return B.archived(_facts(spark, d), T2).select("update_id", "archived")


_END = "TIMESTAMP '2026-01-01'"


@R.add(
    "cross_domain_closed",
    with_("facts", "edges") + ", g AS (SELECT DISTINCT project_id, dst AS id FROM facts WHERE type = 'DESCRIBES' EXCEPT SELECT project_id, src FROM edges) "
    f"SELECT update_id, CASE WHEN g.id IS NOT NULL AND valid_to IS NULL THEN {_END} ELSE valid_to END AS valid_to, CASE WHEN g.id IS NOT NULL AND valid_to IS NULL THEN {_END} ELSE txn_to END AS txn_to "
    "FROM facts f LEFT JOIN g ON g.project_id = f.project_id AND ((f.type = 'DESCRIBES' AND g.id = f.dst) OR (f.type = 'DOCUMENTED_BY' AND g.id = f.src))",
)
def cross_domain_closed(spark: SparkSession, d: str) -> DataFrame:
    """Documentation edges of files without any open edge of their own close."""
    f = _facts(spark, d)
    gone = f.filter("type = 'DESCRIBES'").select("project_id", F.col("dst").alias("id")).distinct().join(canon.edges(spark, d).select("project_id", F.col("src").alias("id")), ["project_id", "id"], "left_anti")
    return B.close_for_nodes(f, gone, "2026-01-01 00:00:00").select("update_id", "valid_to", "txn_to")


@R.add("temporal_edges", with_("file_change") + "SELECT project_id, 'File:' || file_path AS src, 'Commit:' || commit_hash AS dst, min(ts) AS valid_from, 'CHANGED_IN' AS type FROM file_change WHERE commit_hash IS NOT NULL GROUP BY 1, 2, 3")
def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.temporal_edges(canon.file_change(spark, d))


@R.add("current_edges", with_("edges") + "SELECT project_id, src, dst, type, confidence, reason FROM edges")
def current_edges(spark: SparkSession, d: str) -> DataFrame:
    return canon.edges(spark, d)


@R.add("relation_type_summary", with_("facts") + "SELECT project_id, type, count(*) AS n, count(*) FILTER (WHERE txn_to IS NOT NULL) AS withdrawn, count(DISTINCT src) AS sources FROM facts GROUP BY 1, 2")
def relation_type_summary(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("txn_to").isNotNull()).alias("withdrawn"), F.countDistinct("src").alias("sources"))


_MONTHS = "greatest(1.0, (epoch_us({b}) - epoch_us({a})) / 1e6 / (86400 * 30.44))"


@R.add(
    "hotspots",
    with_("changed_in") + f", s AS (SELECT min(ts) AS a, max(ts) AS b FROM changed_in), n AS (SELECT node, count(*) AS change_count, max(ts) AS last_change FROM changed_in GROUP BY 1), "
    f"p AS (SELECT node, change_count, last_change, round(change_count / {_MONTHS.format(a='a', b='b')}, 6) AS per_month FROM n, s) "
    "SELECT *, CASE WHEN per_month > 50 THEN 'high' WHEN per_month >= 10 THEN 'medium' ELSE 'low' END AS risk FROM p",
)
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return C.hotspots(canon.changed_in(spark, d), ["node"], [])


@R.add(
    "hotspots_by_project",
    with_("file_change") + f", s AS (SELECT project_id, min(ts) AS a, max(ts) AS b FROM file_change GROUP BY 1), n AS (SELECT project_id, file_path, count(*) AS change_count, max(ts) AS last_change FROM file_change GROUP BY 1, 2), "
    f"p AS (SELECT project_id, file_path, change_count, last_change, round(change_count / {_MONTHS.format(a='a', b='b')}, 6) AS per_month FROM n JOIN s USING (project_id)) "
    "SELECT *, CASE WHEN per_month > 2 THEN 'high' WHEN per_month >= 0.3 THEN 'medium' ELSE 'low' END AS risk FROM p",
)
def hotspots_by_project(spark: SparkSession, d: str) -> DataFrame:
    return C.hotspots(canon.file_change(spark, d), ["file_path"], ["project_id"], 2, 0.3)


_OWN = """, n AS (SELECT node, author, count(*) AS change_count, max(ts) AS last_change FROM changed_in GROUP BY 1, 2),
own AS (SELECT node, author, change_count, last_change, round(change_count / sum(change_count) OVER (PARTITION BY node), 6) AS ownership FROM n)
"""


@R.add("ownership", with_("changed_in") + _OWN + "SELECT * FROM own")
def ownership(spark: SparkSession, d: str) -> DataFrame:
    return C.ownership(canon.changed_in(spark, d))


@R.add("experts", with_("changed_in") + _OWN + "SELECT node, author, ownership FROM own QUALIFY row_number() OVER (PARTITION BY node ORDER BY ownership DESC, author) = 1")
def experts(spark: SparkSession, d: str) -> DataFrame:
    return C.experts(C.ownership(canon.changed_in(spark, d)))


_PRIMARY = """, ch AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS commit_hash, o_custkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pn AS (SELECT node, author, count(*) AS n FROM ch GROUP BY 1, 2),
pr AS (SELECT node, author FROM pn QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, author) = 1),
ow AS (SELECT author, count(*) AS owned FROM pr GROUP BY 1),
"""


def _primary(spark: SparkSession, d: str) -> DataFrame:
    return C.primary_authors(canon.changed_in(spark, d, "p_partkey"))


def _bus_sql(order: str) -> str:
    return (
        "WITH " + _PRIMARY[2:] + f"run AS (SELECT author, row_number() OVER (ORDER BY owned {order}, author) AS rank, sum(owned) OVER (ORDER BY owned {order}, author) AS orphaned FROM ow), "
        "m AS (SELECT count(*) AS modules FROM pr) SELECT CAST(coalesce((SELECT min(rank) FROM run, m WHERE orphaned > floor(modules * 0.5)), (SELECT count(*) FROM ow)) AS BIGINT) AS bus_factor, "
        "(SELECT count(*) FROM ow) AS authors, modules FROM m"
    )


@R.add("bus_factor", _bus_sql("ASC"))
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return C.bus_factor(_primary(spark, d))


@R.add("bus_factor_desc", _bus_sql("DESC"))
def bus_factor_desc(spark: SparkSession, d: str) -> DataFrame:
    return C.bus_factor(_primary(spark, d), order="desc")


@R.add("risk_modules", "WITH o AS (SELECT DISTINCT c_nationkey AS module, o_orderpriority AS author, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT o_custkey, count(*) AS n, min(author) AS author FROM (SELECT DISTINCT o_custkey, o_orderpriority AS author FROM orders) GROUP BY 1) SELECT o_custkey, author FROM c WHERE n = 1")
def risk_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules with exactly one author."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("author")).distinct()
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("author").alias("author")).filter("n = 1").drop("n")


_PAIR = with_("changed_in") + """, t AS (SELECT count(*) AS total FROM orders), n AS (SELECT node, count(DISTINCT commit_hash) AS n FROM changed_in GROUP BY 1),
c AS (SELECT DISTINCT node, commit_hash FROM changed_in WHERE ts >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY),
p AS (SELECT a.node AS node_a, b.node AS node_b, count(*) AS co_changes FROM c a JOIN c b USING (commit_hash) WHERE a.node < b.node GROUP BY 1, 2),
m AS (SELECT node_a, node_b, co_changes, round(co_changes / total, 8) AS support, round(co_changes / a.n, 8) AS confidence_ab, round(co_changes / b.n, 8) AS confidence_ba,
  round(co_changes * total / (a.n * b.n), 8) AS lift FROM p, t, n a, n b WHERE a.node = node_a AND b.node = node_b)
"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    ch = canon.changed_in(spark, d)
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = ch.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.timestamp_add("DAY", F.lit(-365), F.col("last")))  # one row
    return C.coupling(C.pair_counts(recent, []), ch, o.agg(F.count(F.lit(1)).alias("total")), [])


@R.add("coupling_metrics", _PAIR + "SELECT * FROM m")
def coupling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@R.add("coupling_strong", _PAIR + "SELECT * FROM m WHERE support >= 0.001 AND co_changes >= 2 AND lift > 0.15")
def coupling_strong(spark: SparkSession, d: str) -> DataFrame:
    return C.strong(_metrics(spark, d), 0.001, 2, 0.15)


@R.add("co_changes_top", _PAIR + ", b AS (SELECT node_a AS node, node_b AS other, confidence_ab AS confidence FROM m UNION ALL SELECT node_b, node_a, confidence_ba FROM m) SELECT node, other, confidence FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, other) <= 5")
def co_changes_top(spark: SparkSession, d: str) -> DataFrame:
    """The strongest partners of each node."""
    m = _metrics(spark, d)
    both = m.select(F.col("node_a").alias("node"), F.col("node_b").alias("other"), F.col("confidence_ab").alias("confidence")).union(m.select("node_b", "node_a", "confidence_ba"))
    w = Window.partitionBy("node").orderBy(F.col("confidence").desc(), "other")
    return both.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")


@R.add(
    "api_stability",
    with_("facts") + ", r AS (SELECT project_id, dst AS route, update_id AS c, valid_from AS ts FROM facts WHERE type = 'FETCHES'), g AS (SELECT project_id, route, count(DISTINCT c) AS change_count, min(ts) AS a, max(ts) AS b FROM r GROUP BY 1, 2), "
    "f AS (SELECT project_id, route, change_count, round(least(1.0, greatest(0.0, 1.0 - change_count * 0.1)), 6) AS stability, (epoch_us(b) - epoch_us(a)) / 1e6 / (86400 * 30.44) AS m FROM g) "
    "SELECT project_id, route, change_count, stability, round(CASE WHEN m >= 1 THEN change_count / m ELSE change_count END, 6) AS frequency, CASE WHEN stability >= 0.8 THEN 'stable' WHEN stability >= 0.5 THEN 'moderate' ELSE 'volatile' END AS class FROM f",
)
def api_stability(spark: SparkSession, d: str) -> DataFrame:
    f = canon.facts(spark, d, lambda f: f.filter("type = 'FETCHES'")).select("project_id", F.col("dst").alias("route"), F.col("update_id").alias("commit"), F.col("valid_from").alias("ts"))
    return C.stability(f, ["project_id", "route"])


_DAYS = "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


@R.add(
    "growth_periods",
    _DAYS + ", s AS (SELECT user_id, sum(n) / (max(day) - min(day) + 1) AS a FROM d GROUP BY 1), h AS (SELECT user_id, day, n FROM d JOIN s USING (user_id) WHERE n > 0.8 * a), "
    "i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM h) "
    "SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, g HAVING count(*) >= 4",
)
def growth_periods(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return C.active_islands(days, ["user_id"], 0.8, 4)


@R.add(
    "maintenance_gaps",
    with_("commits") + ", g AS (SELECT project_id, hash, ts, lag(ts) OVER (PARTITION BY project_id ORDER BY ts, hash) AS p FROM commits) "
    "SELECT project_id, hash, p AS gap_from, ts AS gap_to, round((epoch_us(ts) - epoch_us(p)) / 1e6 / 86400, 6) AS gap_days FROM g WHERE round((epoch_us(ts) - epoch_us(p)) / 1e6 / 86400, 6) > 5",
)
def maintenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    return C.gaps(canon.commits(spark, d).select("project_id", "hash", "ts"), ["project_id"], 5)


@R.add(
    "founding_commits",
    with_("commits") + ", r AS (SELECT project_id, hash, ts, row_number() OVER (PARTITION BY project_id ORDER BY ts, hash) AS r, count(*) OVER (PARTITION BY project_id) AS n FROM commits) "
    "SELECT project_id, hash, ts FROM r WHERE r <= least(10, greatest(1, ceil(n * 0.1)))",
)
def founding_commits(spark: SparkSession, d: str) -> DataFrame:
    """The first tenth of a project's commits, 1 to 10."""
    c = canon.commits(spark, d).select("project_id", "hash", "ts")
    n = c.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project_id").orderBy("ts", "hash")
    # at most ten rows per project leave a partition before the shuffle
    first = c.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    return first.join(n, "project_id").filter(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).select("project_id", "hash", "ts")


@R.add("large_refactors", with_("commits") + "SELECT project_id, hash, len(coalesce(modified, [])) + len(coalesce(added, [])) + len(coalesce(deleted, [])) AS paths FROM commits WHERE len(coalesce(modified, [])) + len(coalesce(added, [])) + len(coalesce(deleted, [])) > 15")
def large_refactors(spark: SparkSession, d: str) -> DataFrame:
    size = sum(F.coalesce(F.array_size(c), F.lit(0)) for c in ("modified", "added", "deleted"))
    return canon.commits(spark, d).withColumn("paths", size.cast("bigint")).filter("paths > 15").select("project_id", "hash", "paths")


@R.add("author_rollup", "WITH a AS (SELECT DISTINCT ON (record_id) * FROM author_records) SELECT lower(trim(email)) AS email, CAST(sum(commit_count) AS BIGINT) AS commits, count(*) AS records, count(DISTINCT CAST(last_commit_at AS DATE)) AS days, min(name) AS first_name FROM a WHERE email IS NOT NULL GROUP BY 1")
def author_rollup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "author_records").dropDuplicates(["record_id"]).filter("email IS NOT NULL")
    return a.groupBy(F.lower(F.trim("email")).alias("email")).agg(
        F.sum("commit_count").alias("commits"), F.count(F.lit(1)).alias("records"), F.countDistinct(F.to_date("last_commit_at")).alias("days"), F.min("name").alias("first_name")
    )
