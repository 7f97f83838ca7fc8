"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from redactlake.plans import identity, runs, text, timeline
from redactlake.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "identity", "runs", "text", "timeline"]
