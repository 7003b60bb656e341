"""Fixture views and the registered queries, each with its DuckDB check."""

from importlib import import_module

MODULES = ["reads", "conflicts", "aggregates", "text", "people", "quality", "lifecycle", "layout", "roster", "logs"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"rollbook.plans.{m}")
