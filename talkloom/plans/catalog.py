"""All queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more, relational, scalars, streams  # noqa: F401 (more registers queries with relational)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.queries() | scalars.queries() | streams.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | scalars.oracle_sql() | streams.oracle_sql()
