"""The registered queries. Each reads the given tables whole; most have an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import AS_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Sums of doubles depend on row order in the last bits, so results are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def days_sql(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


def ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 AND ({num}) <> 0 THEN 0.0 WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / ({den}) END"
