"""Queries and SQL of this package, collected from its modules."""

from __future__ import annotations

# Imported here and not on demand, so that a missing module shows where this one is imported.
from . import batch_dedup, copies, languages, linkage, lookalikes, packing, reference_match, token_ids

MODULES = (linkage, lookalikes, copies, reference_match, batch_dedup, token_ids, packing, languages)


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(module, name, {}))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
