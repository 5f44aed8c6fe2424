"""All named queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytefold.queries import catalog, detect, findings, images, store

_MODULES = [store, images, findings, catalog, detect]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
