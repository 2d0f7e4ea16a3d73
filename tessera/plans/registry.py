"""All queries over the supplied tables, with their SQL."""

from __future__ import annotations

from tessera.plans import reports, retrieval, upkeep, versions  # noqa: F401  they register their queries
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
