"""Column profiles, correlations and the fit of a table to the blueprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.blueprints import BLUEPRINTS, Blueprint, get_blueprint
from plumbline.operators.gram import gram_correlations
from plumbline.operators.quality import Anomaly, Moments, is_numeric, numeric_columns, with_distinct_counts
from plumbline.operators.quantiles import clean

# Weights and limits of the compatibility scores.
REQUIRED_WEIGHT, OPTIONAL_WEIGHT, COMPLETE_BONUS, ISSUE_PENALTY = 0.7, 0.2, 0.1, 0.1
COMPATIBLE_COMPLETENESS, COMPATIBLE_MAX_ISSUES = 0.8, 2
SCHEMA_REQUIRED_WEIGHT, SCHEMA_OPTIONAL_WEIGHT = 0.8, 0.2


PLAIN_COLUMNS = 24  # up to so many, an aggregate for every pair compiles well


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, *, exact: bool = True) -> DataFrame:
    """One row per column: type, counts, distinct values and number statistics, from one aggregation.

    ``exact=False`` estimates distinct values and then needs no shuffle of the values.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggregates = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        value = clean(df, f.name)
        aggregates.append(F.count(value).alias(f"v{i}"))
        if not exact:
            aggregates.append(F.approx_count_distinct(value, 0.02).alias(f"d{i}"))
        if is_numeric(f.dataType):
            number = value.cast("double")
            aggregates += [
                F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"),
                F.avg(number).alias(f"m{i}"), F.stddev_samp(number).alias(f"s{i}"),
            ]
    none = F.lit(None).cast("double")
    rows = []
    for i, f in enumerate(fields):
        numeric = is_numeric(f.dataType)
        rows.append(F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(numeric).alias("is_numeric"),
            F.lit(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))).alias("is_datetime"),
            F.col(f"v{i}").alias("non_null_count"),
            (F.col("n") - F.col(f"v{i}")).alias("null_count"),
            F.col(f"d{i}").alias("unique_count"),
            *[(F.col(f"{p}{i}") if numeric else none).alias(a) for p, a in (("lo", "min"), ("hi", "max"), ("m", "mean"), ("s", "std"))],
        ))
    totals = df.agg(*aggregates)
    if exact:
        totals = with_distinct_counts(totals, df, [f.name for f in fields])
    return totals.select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """The first non-missing values of each column in key order, as text. Few rows leave each task."""
    present = F.filter(
        F.array(*[
            F.when(clean(df, c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(key).alias("at")))
            for c in df.columns
        ]),
        lambda v: v.isNotNull(),
    )
    rows = df.select(F.explode(present).alias("p")).select("p.*")
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("column").orderBy("at", "value"))).filter(F.col("n") <= limit)
    return ranked.select("column", "n", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) of text columns; NULL is not counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n_rows"))
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column, the smaller value first among equals."""
    w = W.partitionBy("column").orderBy(F.desc("n_rows"), "value")
    return value_counts(df, columns).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def mixed_profile(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Profile of all or the given columns, with the top values of the text columns joined to one string."""
    columns = list(columns or df.columns)
    text = [c for c in columns if c not in numeric_columns(df)]
    profile = column_profile(df, columns)
    if not text:
        return profile.withColumn("top_values", F.lit(None).cast("string"))
    tops = top_values(df, text, k).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("position", F.concat_ws("=", "value", "n_rows").alias("item")))).alias("items")
    )
    joined = profile.join(F.broadcast(tops), "column", "left")  # one row per text column
    return joined.withColumn("top_values", F.array_join(F.transform("items", lambda i: i["item"]), ",")).drop("items")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregation of fixed size; of many columns by a Gram matrix."""
    columns = list(columns or numeric_columns(df))
    if len(columns) > PLAIN_COLUMNS:
        return gram_correlations(df, columns).drop("n_rows")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    number = {c: clean(df, c).cast("double") for c in columns}
    row = df.agg(*[F.corr(number[a], number[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])))


def missing_and_outliers(df: DataFrame, *, method: str = "iqr", threshold: float = 3.0, exact: bool = True) -> DataFrame:
    """Per column the percentage of missing values and, for numbers, the count of outliers."""
    rule = Anomaly(method, threshold, exact=exact)
    rule.prepare(df, Moments(df))
    outliers = {c: F.count_if(rule.condition(df, c)) for c in rule.fitted}
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)],
        *[outliers.get(c, F.max(F.lit(None).cast("bigint"))).alias(f"o{i}") for i, c in enumerate(df.columns)],
    )
    n = F.nullif(F.col("n"), F.lit(0))
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (100 * (F.col("n") - F.col(f"v{i}")) / n).alias("missing_percent"),
            F.col(f"o{i}").alias("outlier_count"),
        )
        for i, c in enumerate(df.columns)
    ])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum and maximum per column."""
    profile = column_profile(df, columns, exact=False)
    return profile.select("column", F.col("non_null_count").alias("count"), "mean", "std", "min", "max")


def schema_compatibility(columns: Sequence[str], blueprint: str | Blueprint) -> dict:
    """Fit by column names alone. No job runs."""
    blueprint = get_blueprint(blueprint)
    have = set(columns)
    missing = [c for c in blueprint.required if c not in have]
    found = [c for c in blueprint.optional if c in have]
    share = len(found) / len(blueprint.optional) if blueprint.optional else 1.0
    required = 0.0 if missing else 1.0
    return {
        "blueprint": blueprint.name,
        "compatible": not missing,
        "score": required * SCHEMA_REQUIRED_WEIGHT + share * SCHEMA_OPTIONAL_WEIGHT,
        "required_missing": missing,
        "optional_found": found,
        "optional_missing": [c for c in blueprint.optional if c not in have],
        "optional_share": share,
    }


def compatibility(df: DataFrame, blueprints: Sequence[str | Blueprint] | None = None) -> DataFrame:
    """Fit of a table to each blueprint, best first, from one aggregation over the needed columns."""
    chosen = [get_blueprint(b) for b in (blueprints or list(BLUEPRINTS))]
    needed = [c for c in dict.fromkeys(c for b in chosen for c in b.required) if c in df.columns]
    row = df.agg(F.count("*").alias("n"), *[F.count(clean(df, c)).alias(f"v_{c}") for c in needed])
    n = F.nullif(F.col("n"), F.lit(0))
    rows = []
    for b in chosen:
        by_name = schema_compatibility(df.columns, b)
        poor = [
            F.when(F.coalesce(F.col(f"v_{c}") / n, F.lit(0.0)) < COMPATIBLE_COMPLETENESS, F.lit(c))
            for c in b.required if c in needed
        ]
        issues = F.array_compact(F.array(*poor)) if poor else F.array().cast("array<string>")
        complete = by_name["compatible"]
        base = REQUIRED_WEIGHT * complete + OPTIONAL_WEIGHT * by_name["optional_share"] + COMPLETE_BONUS * complete
        rows.append(F.struct(
            F.lit(b.name).alias("blueprint"),
            (F.lit(complete) & (F.size(issues) <= COMPATIBLE_MAX_ISSUES)).alias("compatible"),
            F.round(F.greatest(F.lit(0.0), F.lit(base) - ISSUE_PENALTY * F.size(issues)), 3).alias("score"),
            F.lit(",".join(by_name["required_missing"])).alias("required_missing"),
            F.lit(",".join(by_name["optional_missing"])).alias("optional_missing"),
            F.array_join(issues, ",").alias("quality_issues"),
        ))
    return row.select(F.inline(F.array(*rows))).orderBy(F.desc("score"), "blueprint")  # one row per blueprint
