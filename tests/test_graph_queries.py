"""Depth of rename chains and call traces."""

from datetime import date

from strandline.operators import graph as G
from strandline.plans.graph_queries import symbol_lineage


def test_lineage_goes_ten_hops(spark, tmp_path):
    rows = [(k, 1, date(2024, 1, k)) for k in range(1, 14)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.project, r.start, r.current, r.hops) for r in symbol_lineage(spark, str(tmp_path)).collect()}
    assert got == {(1, a, b, b - a) for a in range(1, 14) for b in range(a + 1, 14) if b - a <= 10}


def test_traces_reach_ten_nodes(spark):
    rows = [("p", f"n{k:02}", f"n{k + 1:02}", "CALLS", 0.9) for k in range(14)]
    e = spark.createDataFrame(rows, "project_id string, src string, dst string, type string, confidence double")
    got = G.traces(e, spark.createDataFrame([("p", "n00")], "project_id string, node string")).collect()
    assert max(map(len, (r.path for r in got))) == 10 and got[0].path == [f"n{k:02}" for k in range(10)]
