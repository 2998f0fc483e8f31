"""All queries of this package, in one registry."""

from __future__ import annotations

from ..plans.registry import Registry
from . import p01_queries, p02_queries, p03_queries, p04_queries, p05_queries, p07_queries, p08_queries, p09_queries, p10_queries

R = Registry()
for _m in (p01_queries, p02_queries, p03_queries, p04_queries, p05_queries, p07_queries, p08_queries, p09_queries, p10_queries):
    R.queries.update(_m.R.queries)
    R.sql.update(_m.R.sql)
