"""Order-dependent columns over long series: rolling frames, lags, fills and the latest earlier event.

A window keeps all rows of one key in one task. That is used only where the largest key was counted to
have at most ``BLOCK_ROWS`` rows. Longer series are cut into blocks of consecutive rows; each block also
gets the few rows before it that its frames reach back to, so every result equals that of one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import pct_change
from plumbline.operators.rank import bucket_of, pick_splits

BLOCK_ROWS = 1_000_000
ORDER_CHUNKS = 1024  # at least; more where these would hold more than BLOCK_ROWS each
KEY_GROUPS = 65_536


def longest_key(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def short_keys(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether no key has more than ``rows`` rows.

    Rows are counted by a hash of the key first, into few groups that no key exceeds. Only where one of these is
    larger are the keys themselves counted.
    """
    if keys:
        groups = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("_group")).agg(F.count("*").alias("n"))
        if (groups.agg(F.max("n")).first()[0] or 0) <= rows:
            return True
    return longest_key(df, keys) <= rows


def _blocked(df: DataFrame, keys: list[str], order: list[str], block_rows: int) -> DataFrame:
    """Add ``_row``, the 0-based position within the key, and ``_block`` of ``block_rows`` positions.

    Positions are counted inside ranges of the first order column and shifted by the rows of the
    ranges before, so no task sees more than one range of one key. There are as many ranges as keep their mean size
    below ``BLOCK_ROWS``; rows without a first order value are one range. Ranges are cut at percentiles of the first
    order column, or, if it is a text, at a fixed number of its values.
    """
    chunks = max(ORDER_CHUNKS, -(-df.count() // BLOCK_ROWS))
    shares = [i / chunks for i in range(1, chunks)]
    first, kind = F.col(order[0]), df.schema[order[0]].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        first = F.unix_micros(first.cast("timestamp"))
    elif isinstance(kind, T.DecimalType):
        first = first.cast("double")  # decimals of one double fall into one range and are ordered inside it
    elif isinstance(kind, T.BooleanType):
        first = first.cast("int")
    placed = df.withColumn("_first", first)
    if isinstance(kind, T.StringType):
        splits = pick_splits(placed, "_first", keys=["_first"])
    else:
        splits = placed.agg(F.percentile_approx("_first", shares, 10 * chunks)).first()[0] or []
    chunk = bucket_of(F.col("_first"), sorted(set(splits)), placed.schema["_first"].dataType.simpleString())
    chunked = placed.withColumn("_chunk", F.when(F.col("_first").isNull(), -1).otherwise(chunk)).drop("_first")
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # A row for each range of a key reaches this window.
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    local = chunked.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)))
    match = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = local.join(offsets, match).withColumn("_row", F.col("_offset") + F.col("_local") - 1)
    return numbered.withColumn("_block", F.floor(F.col("_row") / F.lit(block_rows))).drop(
        "_chunk", "_k_chunk", "_offset", "_local", *[f"_k_{k}" for k in keys]
    )


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    fill: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns built on a window ordered by ``order`` whose frames reach back ``reach`` rows at most.

    ``order`` must order the rows of a key fully. ``fill`` adds columns with the latest non-missing value
    of an expression first, which the built columns may use.
    """
    if short_keys(df, keys, block_rows):
        w = W.partitionBy(*keys).orderBy(*order)
        filled = df.withColumns({n: _last(c, w) for n, c in fill.items()}) if fill else df
        return filled.withColumns(build(w))
    if fill:
        df = _fill_blocks(df, keys, order, fill, block_rows)
    block_rows = max(block_rows, 2 * reach)
    blocks = _blocked(df, keys, order, block_rows)
    ends = F.col("_row") % block_rows >= block_rows - reach
    spread = F.when(ends, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = blocks.withColumn("_ahead", F.explode(spread)).withColumn("_block", F.col("_block") + F.col("_ahead"))
    window = W.partitionBy(*keys, "_block").orderBy("_row")
    return rows.withColumns(build(window)).filter("_ahead = 0").drop("_ahead", "_block", "_row")


def _last(c: str | Column, w: WindowSpec, end: int = 0) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, end))


def fill_forward(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add, per name, the latest non-missing value of an expression up to and including each row."""
    if short_keys(df, keys, block_rows):
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: _last(c, w) for name, c in columns.items()})
    return _fill_blocks(df, keys, order, columns, block_rows)


def _fill_blocks(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], block_rows: int) -> DataFrame:
    blocks = _blocked(df, keys, order, block_rows).withColumns({f"_v_{n}": c for n, c in columns.items()})
    ends = blocks.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_row"))).alias(f"_e_{n}") for n in columns]
    )
    across = W.partitionBy(*keys).orderBy("_block")
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_k_block"),
        *[_last(f"_e_{n}", across, -1).alias(f"_c_{n}") for n in columns],
    )
    match = F.col("_block") == F.col("_k_block")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = W.partitionBy(*keys, "_block").orderBy("_row")
    filled = blocks.withColumns({f"_w_{n}": _last(f"_v_{n}", within) for n in columns})
    return (
        filled.join(carried, match)
        .withColumns({n: F.coalesce(F.col(f"_w_{n}"), F.col(f"_c_{n}")) for n in columns})
        .drop("_row", "_block", "_k_block", *[f"_k_{k}" for k in keys],
              *[f"_{p}_{n}" for n in columns for p in ("v", "w", "c")])
    )


def number(column: str) -> Column:
    """A number column as double, with NaN as NULL."""
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


def rolling_mean(column: str, window: WindowSpec, rows: int) -> Column:
    return F.avg(number(column)).over(window.rowsBetween(1 - rows, 0))


def rolling_std(column: str, window: WindowSpec, rows: int) -> Column:
    """Sample deviation; a frame with one value has 0."""
    return F.coalesce(F.stddev_samp(number(column)).over(window.rowsBetween(1 - rows, 0)), F.lit(0.0))


def growth(column: str, window: WindowSpec, lag: int) -> Column:
    return pct_change(F.col(column), F.lag(column, lag).over(window))


def session_durations(
    events: DataFrame,
    *,
    user: str = "user_id",
    ts: str = "ts",
    kind: str = "event_type",
    tie: str = "event_id",
    ttl_seconds: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Seconds from the latest login to each logout. A login older than ``ttl_seconds`` has expired."""
    relevant = events.filter(F.col(kind).isin("login", "logout"))
    seen = fill_forward(
        relevant, [user], [ts, tie], {"session_start": F.when(F.col(kind) == "login", F.col(ts))}, block_rows=block_rows
    )
    seconds = (F.unix_micros(F.col(ts)) - F.unix_micros("session_start")) / F.lit(1_000_000)
    ended = seen.filter((F.col(kind) == "logout") & F.col("session_start").isNotNull()).withColumn(
        "session_duration", seconds
    )
    if ttl_seconds is not None:
        ended = ended.filter(F.col("session_duration") <= ttl_seconds)
    return ended.select(user, tie, "session_start", F.col(ts).alias("session_end"), "session_duration")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Each task keeps one row per key before the shuffle."""
    numbered = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")
