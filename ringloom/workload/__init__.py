"""Every operator as a query over the driver tables, next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringloom.workload import catalogues, placement, published, rasters

_GROUPS = (placement, catalogues, rasters, published)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for group in _GROUPS for name, run in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
