"""Registered queries of the graph operators over the driver's tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, baselines, closures, crates, elections, graphs, reports, scalars, sections, technology, wiring
from .registry import ORACLES, QUERIES

__all__ = ["assembly", "baselines", "closures", "crates", "elections", "graphs", "reports", "scalars", "sections", "technology", "wiring"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
