"""Named queries and, where SQL can say the same, the SQL: one module for each part of the inventory."""

from __future__ import annotations

from quarrystone.plans import analytics, flagship, relational, scalars, vectors
from quarrystone.plans.registry import ORACLES, QUERIES, query

query(flagship.SQL)(flagship.nation_year_rollup)

__all__ = ["ORACLES", "QUERIES", "analytics", "relational", "scalars", "vectors"]
