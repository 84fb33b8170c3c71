"""Queries over the test tables, with the SQL each is checked against."""

from importlib import import_module

MODULES = ("q_metrics", "q_exprs", "q_sources", "q_joins", "q_windows", "q_reduce", "q_models")


def load() -> None:
    """Register the queries of every module."""
    for name in MODULES:
        import_module(f"workload.{name}")
