"""All registered queries of the library with their SQL."""

from __future__ import annotations

from quillstone.plans import entity, extensions, governance, ingest, retrieval, sourcing
from quillstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "entity", "extensions", "governance", "ingest", "retrieval", "sourcing"]
