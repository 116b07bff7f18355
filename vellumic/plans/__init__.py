"""Registered queries with fixed parameters, and the SQL each is compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lexical", "dense", "quality", "passages", "graph", "upkeep", "more", "rules", "modes")


def queries() -> dict:
    """Every registered query of the library."""
    return {k: v for m in MODULES for k, v in import_module(f"vellumic.plans.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return {k: v for m in MODULES for k, v in import_module(f"vellumic.plans.{m}").ORACLES.items()}
