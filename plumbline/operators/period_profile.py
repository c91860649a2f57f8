"""Profiles kept up by period: a small mergeable state for each period and column, so that new rows alone are read.

A state holds exact counts, extremes, mean and sum of squares, and three sketches of fixed size: distinct values
(HyperLogLog, relative error about 1.04 / sqrt(2 ** ``LG_DISTINCT``)), quantiles (KLL, rank error about 1 % at
``QUANTILE_SIZE``) and frequent values. States of any set of periods merge to the profile of their rows; no row
is read again. Counts by (period, column, value) beside them keep distinct and top values exact where that is asked for.

Defined results: NULL and NaN are missing; rows without a time have a period of their own (NULL); a column with
missing values only has NULL for its figures and 0 distinct values; a period that has lost all its rows keeps a
state of no rows, which changes no merged figure; an empty table has no state and no profile. ``_period`` is
reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.quality import is_numeric
from plumbline.operators.quantiles import clean
from plumbline.session import materialise

PERIOD = "_period"
LG_DISTINCT = 14
QUANTILE_SIZE = 400
TRACKED = 1_000  # values that a sketch of frequent ones follows
TOP = T.StructType([
    T.StructField("sketch", T.BinaryType()), T.StructField("maxItemsTracked", T.IntegerType()),
    T.StructField("itemDataType", T.StringType()), T.StructField("itemDataTypeDDL", T.StringType()),
])
STATE = T.StructType([T.StructField(name, kind) for kind, names in (
    (T.StringType(), ["column", "data_type"]), (T.BooleanType(), ["is_numeric"]), (T.LongType(), ["n_rows", "non_null_count"]),
    (T.DoubleType(), ["lo", "hi", "mean", "m2"]), (T.BinaryType(), ["distinct", "quantiles"]), (TOP, ["frequent"]),
) for name in names])


def period_of(ts: str, unit: str) -> Column:
    return F.trunc(F.to_date(ts), unit) if unit != "day" else F.to_date(ts)


def period_states(df: DataFrame, ts: str, columns: Sequence[str] | None = None, unit: str = "day") -> DataFrame:
    """``_period`` and one state for each column. Tasks reduce their rows to states first, so a busy period is a row per task."""
    fields = [f for f in df.schema.fields if (columns is None and f.name != ts) or (columns is not None and f.name in columns)]
    aggregates = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        value = clean(df, f.name)
        aggregates += [
            F.count(value).alias(f"v{i}"),
            F.hll_sketch_agg(value.cast("string"), LG_DISTINCT).alias(f"d{i}"),
            F.call_function("approx_top_k_accumulate", value.cast("string"), F.lit(TRACKED)).alias(f"t{i}"),
        ]
        if is_numeric(f.dataType):
            number = value.cast("double")
            aggregates += [
                F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"m{i}"), F.var_pop(number).alias(f"s{i}"),
                F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias(f"q{i}"),
            ]
    none, no_sketch = F.lit(None).cast("double"), F.lit(None).cast("binary")
    states = []
    for i, f in enumerate(fields):
        numeric = is_numeric(f.dataType)
        states.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(numeric).alias("is_numeric"),
            F.col("n").alias("n_rows"), F.col(f"v{i}").alias("non_null_count"),
            *[(F.col(f"{p}{i}") if numeric else none).alias(name) for p, name in (("lo", "lo"), ("hi", "hi"), ("m", "mean"))],
            (F.col(f"s{i}") * F.col(f"v{i}") if numeric else none).alias("m2"),
            F.col(f"d{i}").alias("distinct"), (F.col(f"q{i}") if numeric else no_sketch).alias("quantiles"), F.col(f"t{i}").alias("frequent"),
        ))
    return df.groupBy(period_of(ts, unit).alias(PERIOD)).agg(*aggregates).select(PERIOD, F.inline(F.array(*states)))


def period_counts(df: DataFrame, ts: str, columns: Sequence[str], unit: str = "day") -> DataFrame:
    """Rows by period, column and value (as text), from one scan; missing values are not counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), clean(df, c).cast("string").alias("value")) for c in columns])
    rows = df.select(period_of(ts, unit).alias(PERIOD), F.inline(pairs)).where("value IS NOT NULL")
    return rows.groupBy(PERIOD, "column", "value").agg(F.count("*").alias("n_rows"))


def rows_of(df: DataFrame, ts: str, first: str, end: str) -> DataFrame:
    """Rows from ``first`` up to but not including ``end``, as a range on the raw column that the scan can use to skip data."""
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(first).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def store_states(df: DataFrame, path: str, ts: str, columns: Sequence[str] | None = None, unit: str = "day") -> None:
    """States of all rows, in a folder for each period."""
    _write(period_states(df, ts, columns, unit), path)


def refresh_states(
    df: DataFrame, path: str, ts: str, first: str, end: str, columns: Sequence[str] | None = None, unit: str = "day"
) -> None:
    """Replace the states of the periods from ``first`` to before ``end`` (both at period borders); other rows and states aren't read.

    Doing it again gives the same states. A stored period that has no rows any more gets states of no rows.
    """
    spark = df.sparkSession
    new = materialise(period_states(rows_of(df, ts, first, end), ts, columns, unit), "states")
    old = stored(spark, path).where((F.col(PERIOD) >= F.lit(first).cast("date")) & (F.col(PERIOD) < F.lit(end).cast("date")))
    gone = old.join(new.select(PERIOD, "column"), [PERIOD, "column"], "left_anti").select(
        PERIOD, "column", "data_type", "is_numeric", *[F.lit(0).cast("long").alias(c) for c in ("n_rows", "non_null_count")],
        *[F.lit(None).cast(STATE[c].dataType).alias(c) for c in ("lo", "hi", "mean", "m2", "distinct", "quantiles", "frequent")],
    )
    # Stored before it is written, since it reads the folders that it replaces.
    _write(new.unionByName(materialise(gone, "emptied")), path)


def _write(states: DataFrame, path: str) -> None:
    states.hint("rebalance", PERIOD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*STATE.fields, T.StructField(PERIOD, T.DateType())])).parquet(path)


def _moments(states: Column) -> Column:
    """Count, mean and sum of squares of all states, added pair by pair so that large means lose no digits."""

    def add(a: Column, b: Column) -> Column:
        n, step = a.n + b.n, b.mean - a.mean
        return F.struct(
            n.alias("n"), (a.mean + step * b.n / n).alias("mean"), (a.m2 + b.m2 + step * step * a.n * b.n / n).alias("m2"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(states, zero, add)


def merged_profile(states: DataFrame, by: Sequence[str] = (), top: int = 5, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all rows behind ``states``, one row a column (and value of ``by``).

    Counts, extremes, mean and deviation are exact; ``unique_estimate``, ``quantile_estimates`` (at ``shares``) and
    ``top_estimates`` (values with counts) come from the sketches. What is gathered per column is a few numbers a period.
    """
    some = F.col("non_null_count") > 0
    parts = F.struct(F.col("non_null_count").alias("n"), "mean", "m2")
    merged = states.where("n_rows > 0").groupBy(*by, "column", "data_type", "is_numeric").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("non_null_count").alias("non_null_count"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sort_array(F.collect_list(F.when(some & F.col("is_numeric"), parts))).alias("parts"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_estimate"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )
    m = merged.withColumn("m", _moments(F.col("parts")))
    numbers = F.col("m.n") > 0
    points = F.array(*[F.lit(float(s)) for s in shares])
    return m.select(
        *by, "column", "data_type", "n_rows", "non_null_count", (F.col("n_rows") - F.col("non_null_count")).alias("null_count"),
        "min", "max", F.when(numbers, F.col("m.mean")).alias("mean"),
        F.when(F.col("m.n") > 1, F.sqrt(F.col("m.m2") / (F.col("m.n") - 1))).alias("std"),
        F.coalesce("unique_estimate", F.lit(0)).alias("unique_estimate"),
        F.when(numbers, F.kll_sketch_get_quantile_double("quantiles", points)).alias("quantile_estimates"),
        F.when(F.col("non_null_count") > 0, F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top))).alias("top_estimates"),
    )


def merged_counts(counts: DataFrame, k: int = 5) -> DataFrame:
    """Exact distinct values of each column and the ``k`` most frequent ones, from counts by period; smaller values first among equals."""
    totals = counts.groupBy("column", "value").agg(F.sum("n_rows").alias("n_rows"))
    ranked = totals.withColumn("position", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n_rows"), "value"))).where(F.col("position") <= k)
    distinct = totals.groupBy("column").agg(F.count("*").alias("unique_count"))
    return ranked.join(F.broadcast(distinct), "column")  # one row a column
