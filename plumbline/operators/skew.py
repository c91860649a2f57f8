"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot with more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 200
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64_000_000


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys with more than one in ``share`` rows: fewer than ``share`` rows by construction."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    total = df.agg(F.count("*").alias("all_rows"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n_rows") * share > F.col("all_rows")).select(*keys)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``limit`` rows and ``BROADCAST_BYTES`` of text, found without counting past the limit."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    size = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    row = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["n"] <= limit and row["bytes"] <= BROADCAST_BYTES


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", *, small: bool | None = None) -> DataFrame:
    """Join to a table that is unique on ``keys``, whatever the key distribution on the left.

    A right side counted to be small is broadcast. Otherwise the rows of hot left keys meet the few
    right rows they need in a broadcast join, and only the remaining rows are shuffled by key. Each
    left row takes exactly one of the two ways. ``how`` is inner, left, left_semi or left_anti.
    ``small`` tells that the right side was counted before.
    """
    if small or (small is None and fits_broadcast(right)):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(left, keys)
    is_hot = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    hot_left = left.filter(is_hot).join(F.broadcast(hot), keys, "left_semi")
    hot_right = right.join(F.broadcast(hot), keys, "left_semi")
    cold_left = left.join(F.broadcast(hot), keys, "left_anti")
    return hot_left.join(F.broadcast(hot_right), keys, how).unionByName(cold_left.join(right, keys, how))
