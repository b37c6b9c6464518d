"""All core queries and oracles by name."""

from __future__ import annotations

from graniteloom.plans import documents, equipment, linking_queries, profiles, quality, search, stated

MODULES = (quality, search, profiles, documents, linking_queries, equipment, stated)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
