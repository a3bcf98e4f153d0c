"""All registered queries and the SQL that must agree with them."""

from __future__ import annotations

from . import fleet, masking, migrations, refreshes, snapshots, streams

MODULES = (masking, refreshes, snapshots, migrations, fleet, streams)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
