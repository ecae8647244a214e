"""Registry of the engine's queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import core, increment


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """A search from chunks to a ranked page."""
    return core.rank_full(spark, base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.QUERIES | {"p6_found": increment.p6_found, "p6_state": increment.p6_state}


def oracle_sql() -> dict[str, str]:
    return core.SQL | {"p6_found": increment.P6_SQL, "p6_state": increment.P6_STATE_SQL}
