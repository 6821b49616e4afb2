"""Registered queries over the given tables, each with its SQL twin."""

from twinsync.checks import apply, capture, events, migration, reports, sync

MODULES = (migration, events, apply, capture, reports, sync)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
