"""Named queries of the engine and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_text", "q_features", "q_blocking", "q_metrics", "q_files")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"kinspark.plans.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
