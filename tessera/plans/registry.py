"""Names of all registered queries; importing it registers them."""

from __future__ import annotations

from . import agreements, analyses, derived, feeds, lookups, models, networks, panels, partitions, protocols, resolution, sampling, statistics, verification
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "agreements", "analyses", "derived", "feeds", "lookups", "models", "networks", "panels", "partitions", "protocols", "resolution", "sampling", "statistics", "verification"]
