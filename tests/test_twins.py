"""Registered queries against their SQL on the small tables, where they are there."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
NAMES = (
    "hotspots ownership bus_factor coupling_metrics snapshot_diff current_edges impact_upstream components topological_levels search_code hybrid_search entity_freshness changed_files "
    "resolved_calls tiered_resolution line_symbols author_dedup rename_terminals drift_divergence history_only route_match cross_domain_closed p6_found"
).split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else str(v) if hasattr(v, "isoformat") else v


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], Counter(tuple(norm(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, duck, name):
    df = entry.queries()[name](spark, TABLES)
    r = duck.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([x[0] for x in r.description], r.fetchall())
