"""Named queries and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "matching", "decisions", "reports", "profiling")


def all_queries():
    """The registered queries and their SQL, as two dicts."""
    from reconloom.plans import catalog

    for m in MODULES:
        import_module(f"reconloom.plans.q_{m}")
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
