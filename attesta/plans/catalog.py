"""Queries over the given tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "ag4_case_verdict"
#: Modules of this folder that hold QUERIES (name: function) and SQL (name: text).
MODULES: tuple[str, ...] = ("decisions", "sessions", "measures", "geometry")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in MODULES:
        out |= import_module(f"attesta.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"attesta.plans.{name}").SQL
    return out
