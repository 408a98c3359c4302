"""All queries over the line-item relations and their SQL, by name."""

from __future__ import annotations

from tallymill.plans import aggregates, composites, joins, rule_queries, scalars, streams  # noqa: F401
from tallymill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
