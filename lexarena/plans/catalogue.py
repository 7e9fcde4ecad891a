"""All registered queries of the engine."""

from __future__ import annotations

from lexarena.plans import domain, records, relational  # noqa: F401 - they register their queries
from lexarena.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
