"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from .plans import base, relational, resolution, selection, service, temporal, textual  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
