"""Registered queries by group: sales and items, promotions, posts, files and increments."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, oracles) of every group."""
    from shelfwise.plans import files, posts, promo, registry, retail  # noqa: F401

    return registry.QUERIES, registry.ORACLES
