"""Registered queries over the driver's tables, with equivalent DuckDB SQL."""

from collections.abc import Callable
from importlib import import_module

AREAS = ("retrieval", "search", "evaluation", "frames", "jobs", "audit", "planning", "validation", "graph", "comparison", "records")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for area in AREAS:
        out |= import_module(f"tessella.plans.{area}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in AREAS:
        out |= import_module(f"tessella.plans.{area}").SQL
    return out
