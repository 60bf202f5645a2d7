"""All session-history queries with their SQL, gathered from the plan modules."""

from __future__ import annotations

from loglattice.plans import dialogue, endings, ledger, lists, live, native, records, rollups, skilled, stores, timing

MODULES = (ledger, dialogue, records, native, lists, live, stores, endings, rollups, timing, skilled)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
