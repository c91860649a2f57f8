"""Writing tables: files, day partitions and merged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialise

BUCKET = "_bucket"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_features(df: DataFrame, root: str, job: str, target: str | None = None) -> None:
    """``<job>_features.parquet`` and, with a target column, ``<job>_target.parquet``."""
    features = df.drop(target) if target else df
    features.write.mode("overwrite").parquet(f"{root}/{job}_features.parquet")
    if target:
        df.select(target).write.mode("overwrite").parquet(f"{root}/{job}_target.parquet")


def read_features(spark: SparkSession, root: str, job: str, target: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    features = spark.read.parquet(f"{root}/{job}_features.parquet")
    return features, spark.read.parquet(f"{root}/{job}_target.parquet") if target else None


def stage_by_day(df: DataFrame, root: str, table: str, ts: str) -> str:
    """Write below ``staging/<table>/date=…``, replacing only the days present in ``df``.

    Rows of a day are spread over as many files as adaptive execution sees fit, so a heavy day is split.
    """
    path = f"{root}/staging/{table}"
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return path


def changed_on(df: DataFrame, ts: str, day: str | Column) -> DataFrame:
    """Rows of one day as a half-open range on the raw column, which the scan can use to skip data."""
    start = (F.lit(day) if isinstance(day, str) else day).cast("date")
    kind = df.schema[ts].dataType
    return df.filter((F.col(ts) >= start.cast(kind)) & (F.col(ts) < F.date_add(start, 1).cast(kind)))


def read_incremental(spark: SparkSession, path: str, ts: str, day: str) -> DataFrame:
    return changed_on(spark.read.parquet(path), ts, day)


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The merged table: updated rows win, except that ``keep`` columns stay as they were.

    Both sides are unique on the keys. Columns only one side has are kept.
    """
    keys = list(keys)
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_old"), F.lit(True).alias("_had"))
    new = updates.select(*keys, F.struct(*[c for c in updates.columns if c not in keys]).alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, keys, "full_outer")
    names = list(dict.fromkeys([c for c in current.columns if c not in keys] + [c for c in updates.columns if c not in keys]))
    out = []
    for c in names:
        before = F.col(f"_old.{c}") if c in current.columns else None
        after = F.col(f"_new.{c}") if c in updates.columns else None
        if before is None:
            value = after
        elif after is None:
            value = before
        elif c in keep:
            value = F.when(F.col("_had"), before).otherwise(after)
        else:
            value = F.when(F.col("_has"), after).otherwise(before)
        out.append(value.alias(c))
    return both.select(*keys, *out)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> None:
    """A table in folders by a hash of its keys, for ``upsert_touched``. Adaptive execution splits heavy folders into files."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    df.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def touched(updates: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The folders that hold a key of ``updates``: at most ``buckets`` numbers."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("b")
    return sorted(r["b"] for r in updates.select(bucket).distinct().collect())


def upsert_touched(
    spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = (), buckets: int = 256
) -> list[int]:
    """Merge ``updates`` into a table of ``write_bucketed`` in place; only folders with a changed key are read and written.

    ``updates`` are unique on the keys, which have the types of the table's, and bring no new columns. The merged folders are stored in the
    scratch folder first, so the write never reads what it replaces and can be repeated if it is cut off.
    Returns the folders.
    """
    current = spark.read.parquet(path)
    new = sorted(set(updates.columns) - set(current.columns))
    if new:
        raise ValueError(f"columns that the table does not have: {', '.join(new)}")
    kinds = {c: current.schema[c].dataType for c in updates.columns}
    updates = materialise(updates.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]), "updates")
    folders = touched(updates, keys, buckets)
    if not folders:
        return []
    merged = upsert(current.where(F.col(BUCKET).isin(folders)).drop(BUCKET), updates, keys, keep)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    merged = materialise(merged.withColumn(BUCKET, bucket), "merged").hint("rebalance", BUCKET)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return folders
