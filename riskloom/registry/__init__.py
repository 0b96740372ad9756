"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["q_clean", "q_text", "q_costs", "q_ml", "q_stream"]


def _load():
    for module in _MODULES:
        import_module(f"riskloom.registry.{module}")
    from riskloom.registry.core import ORACLES, QUERIES

    return QUERIES, ORACLES


def all_queries():
    return dict(_load()[0])


def all_oracles():
    return dict(_load()[1])


def approximate_queries():
    """Registered queries without SQL."""
    _load()
    from riskloom.registry.core import APPROXIMATE

    return dict(APPROXIMATE)
