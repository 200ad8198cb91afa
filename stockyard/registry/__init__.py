"""Registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All queries and their SQL, by name."""
    from stockyard.registry import (  # noqa: F401
        aggregates,
        cleaning,
        control,
        extras,
        imports,
        lookups,
        measures,
        rules,
        scans,
    )
    from stockyard.registry.core import ORACLES, QUERIES

    return QUERIES, ORACLES
