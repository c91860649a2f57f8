"""Ranks and quantile tiers over a whole table without sorting it in one task."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.quantiles import EXACT_LIMIT, clean, count_values, order_statistics
from plumbline.operators.skew import HOT_SHARE

RANK_BUCKETS = 4096
RANK_RANGES = 1024  # at least; more where these would hold more than RANGE_ROWS each
RANGE_ROWS = 1_000_000
FEW_ROWS = 1000  # rows of equal value among which a cut is found by a plain top-k

# Tier names for four and three tiers.
TIER_LABELS = {4: ("low", "medium", "high", "premium"), 3: ("low", "medium", "high")}


@dataclass
class TierModel:
    """Cut rows of a quantile tiering. A row's tier is one more than the number of cuts it lies above.

    Rows of equal value are ordered by the tie columns, compared one after the other with NULL first.
    """

    column: str
    ties: tuple[str, ...]
    labels: tuple[str, ...]
    cuts: list[tuple[object, tuple | None]] = field(default_factory=list)

    def expression(self) -> Column:
        """Tier label as a projection. A missing value has no tier."""
        value = F.col(self.column)
        missing = value.isNull() | F.isnan(value.cast("double"))
        above = F.lit(0)
        for cut, keys in self.cuts:
            beyond = value > F.lit(cut)
            if keys is not None:
                beyond = beyond | ((value == F.lit(cut)) & _after(self.ties, keys))
            above = above + beyond.cast("int")
        names = F.array(*[F.lit(label) for label in self.labels])
        return F.when(~missing, F.get(names, above))


def _after(columns: tuple[str, ...], keys: tuple) -> Column:
    """Whether a row comes after the one of these keys, NULL first."""
    later, equal = F.lit(False), F.lit(True)
    for name, key in zip(columns, keys):
        here = F.col(name)
        greater = here.isNotNull() if key is None else F.coalesce(here > F.lit(key), F.lit(False))
        later = later | (equal & greater)
        equal = equal & here.eqNullSafe(F.lit(key))
    return later


def _cut_ranks(n: int, q: int, pandas_edges: bool) -> list[int]:
    """0-based position of the last row of each tier but the highest."""
    if n < 2:
        return []
    if not pandas_edges:
        return [k * (n - 1) // q for k in range(1, q)]
    cuts = []
    for k in range(1, q):
        # The edge as pandas computes it in floating point: percent, back to a share, interpolated rank.
        position = (n - 1) * (k * (1.0 / q) * 100 / 100)
        share = position - math.floor(position)
        first, second = math.floor(position) + 1.0, min(math.floor(position) + 2.0, n)
        step = second - first
        edge = first + step * share if share < 0.5 else second - step * (1 - share)
        cuts.append(min(n - 1, math.floor(edge) - 1))
    return cuts


def _string_at(rows: DataFrame, column: str, rank: int, total: int, limit: int) -> str:
    """The string at ``rank`` in sort order, found one character at a time until few candidates are left."""
    prefix = ""
    while total > limit:
        heads = (
            rows.filter(F.col(column).startswith(prefix))
            .groupBy(F.substring(column, 1, len(prefix) + 1).alias("head"))
            .count()
            .orderBy("head")
            .collect()  # one row per next character
        )
        for head in heads:
            if rank < head["count"]:
                break
            rank -= head["count"]
        if head["head"] == prefix:
            return prefix
        prefix, total = head["head"], head["count"]
    found = rows.filter(F.col(column).startswith(prefix)).agg(F.sort_array(F.collect_list(column)).alias("v"))
    return found.select(F.get("v", F.lit(rank))).first()[0]


def fit_tiers(
    df: DataFrame,
    column: str,
    q: int,
    *,
    tie: str | Sequence[str] | None = None,
    labels: tuple[str, ...] | None = None,
    pandas_edges: bool = False,
    exact_limit: int = EXACT_LIMIT,
) -> TierModel:
    """Find the rows that end each of ``q`` equal-count tiers of ``column``, ties ordered by the columns of ``tie``.

    Only ``q - 1`` order statistics are needed, so assigning tiers is a projection: no window and no
    shuffle. Without ``tie`` equal values share a tier.
    """
    labels = labels or TIER_LABELS.get(q) or tuple(str(i + 1) for i in range(q))
    ties = (tie,) if isinstance(tie, str) else tuple(tie or ())
    model = TierModel(column, ties, tuple(labels))
    n = count_values(df, [column])[column]
    ranks = _cut_ranks(n, q, pandas_edges)
    if not ranks:
        return model
    values = order_statistics(df, {column: ranks}, counts={column: n}, exact_limit=exact_limit)[column]
    if not ties:
        model.cuts = [(values[r], None) for r in ranks]
        return model

    value = clean(df, column)
    row = df.agg(
        *[F.count_if(value < F.lit(values[r])).alias(f"lt{i}") for i, r in enumerate(ranks)],
        *[F.count_if(value == F.lit(values[r])).alias(f"eq{i}") for i, r in enumerate(ranks)],
    ).first()
    for i, r in enumerate(ranks):
        within, equal = r - row[f"lt{i}"], row[f"eq{i}"]
        if within == equal - 1:  # the cut is the last of its equals
            model.cuts.append((values[r], None))
            continue
        equals = df.filter(value == F.lit(values[r])).select(*ties)
        model.cuts.append((values[r], _row_at(equals, ties, within, equal, exact_limit)))
    return model


def _row_at(rows: DataFrame, columns: tuple[str, ...], rank: int, total: int, limit: int) -> tuple:
    """The keys of the row at ``rank`` in the order of the columns, NULL first."""
    if total <= FEW_ROWS:
        ordered = rows.orderBy(*[F.col(c).asc_nulls_first() for c in columns]).limit(rank + 1).collect()
        return tuple(ordered[-1])
    first, *rest = columns
    nulls = rows.filter(F.col(first).isNull()).count()
    if rank < nulls:
        key, equals, within, left = None, rows.filter(F.col(first).isNull()), rank, nulls
    else:
        known = rows.filter(F.col(first).isNotNull()).select(*columns)
        if isinstance(rows.schema[first].dataType, T.StringType):
            key = _string_at(known, first, rank - nulls, total - nulls, limit)
        else:
            key = order_statistics(known, {first: [rank - nulls]}, exact_limit=limit)[first][rank - nulls]
        if not rest:
            return (key,)
        row = known.agg(F.count_if(F.col(first) < F.lit(key)).alias("lt"), F.count_if(F.col(first) == F.lit(key)).alias("eq")).first()
        equals, within, left = known.filter(F.col(first) == F.lit(key)), rank - nulls - row["lt"], row["eq"]
    return (key, *(_row_at(equals.select(*rest), tuple(rest), within, left, limit) if rest else ()))


def pick_splits(counts: DataFrame, value: str, keys: list[str] | None = None) -> list:
    """Fewer than ``RANK_BUCKETS`` distinct values, those with the smallest hashes, in order."""
    picked = counts.filter(F.col(value).isNotNull()).select(value)
    if keys:  # a value may be there more than once
        picked = picked.groupBy(value).agg(F.lit(1).alias("_one")).select(value)
    return sorted(row[0] for row in picked.orderBy(F.xxhash64(value), value).limit(RANK_BUCKETS - 1).collect())


def running_totals(
    counts: DataFrame, value: str, measures: list[str], *, keys: list[str] | None = None, splits: list | None = None
) -> DataFrame:
    """Add ``<measure>_before``: the total of each measure over all smaller values of the same key.

    ``counts`` has one row per key and distinct number or text. The values with the smallest
    hashes, a fixed number of them, cut the values into ranges; each range is summed by itself in a
    window and the ranges before it are added from a table of at most ``RANK_BUCKETS`` rows per key. A range
    follows from the value alone, so a task that runs again puts a row in the same place.
    """
    keys = list(keys or [])
    if splits is None:
        splits = pick_splits(counts, value, keys)
    ranged = counts.withColumn("_bucket", bucket_of(F.col(value), splits, counts.schema[value].dataType.simpleString()))
    totals = ranged.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most RANK_BUCKETS rows per key reach this window.
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    match = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumns({f"_w_{m}": F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures})
        .join(offsets if keys else F.broadcast(offsets), match)
        .withColumns({f"{m}_before": F.col(f"_w_{m}") + F.col(f"_o_{m}") for m in measures})
        .drop("_bucket", "_k_bucket", *[f"_k_{k}" for k in keys], *[f"_{p}_{m}" for m in measures for p in "wo"])
    )


def bucket_of(value: Column, splits: list, kind: str) -> Column:
    """The number of sorted ``splits`` below the value, by a binary search in one expression.

    The splits travel as one JSON text, which is folded to a constant, and not as thousands of literals.
    """
    if not splits:
        return F.lit(0)
    ordered = F.from_json(F.lit(json.dumps(splits)), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(splits).bit_length() - 1, -1, -1)])
    # Past the end ``get`` is NULL, which compares as not below.
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(ordered, at + step - 1) < value, step).otherwise(0)
    )


def with_range(df: DataFrame, value: str, splits: list[float], output: str) -> DataFrame:
    """Add the number of sorted ``splits`` below a double, NULL for NULL, by Spark ML's binary search.

    ``bucket_of`` takes any type but steps through its search row by row in an interpreted lambda, too slow for every row of a
    large table. A ``Bucketizer`` range has its lower end and not its upper one, so values and splits change their signs.
    """
    if not any(math.isfinite(s) for s in splits):  # two at most
        return df.withColumn(output, F.when(F.col(value).isNotNull(), bucket_of(F.col(value), splits, "double")))
    infinity = float("inf")
    ends = sorted({0.0 - s for s in splits} | {-infinity, infinity})
    negative = df.withColumn("_negative", F.lit(0.0) - F.col(value))
    placed = Bucketizer(splits=ends, inputCol="_negative", outputCol="_place", handleInvalid="keep").transform(negative)
    # Ends that had to be added are no splits, and the highest range takes its upper end in.
    top = len(splits) - (infinity in splits)
    below = F.when(F.col(value) == -infinity, F.lit(0)).otherwise(F.lit(top) - F.col("_place").cast("int"))
    return placed.withColumn(output, F.when(F.col(value).isNotNull(), below)).drop("_negative", "_place")


def percent_rank_average(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add the rank of each value over the number of values, equal values sharing their mean rank.

    Approximate percentiles cut the values into ranges. One aggregation counts them; each row is then ranked inside
    its range by one window, and the rows of the ranges before are added from a constant. A percentile that holds
    many rows itself is known to be hot from the same counts: the rank of its rows follows without the window, so
    they are dealt out evenly, and so are rows without a value; if there are no other rows, none is moved at all. The number of
    ranges follows from the rows counted, so a range stays of bounded size. Nothing is joined back.
    """
    data = df.withColumn("_value", clean(df, column).cast("double") + F.lit(0.0))
    ranges = RANK_RANGES
    while True:
        shares = [i / ranges for i in range(1, ranges)]
        splits = sorted(set(data.agg(F.percentile_approx("_value", shares, 10 * ranges)).first()[0] or []))
        ranged = with_range(data, "_value", splits, "_range")
        # Range i holds what lies above split i - 1, up to split i itself.
        top = F.get(_constant(splits, "double"), F.col("_range"))
        counted = ranged.filter("_value IS NOT NULL").groupBy("_range").agg(
            F.count("*").alias("n"), F.count_if(F.col("_value") == top).alias("tops")
        ).collect()  # one row for each range
        sizes = {row["_range"]: (row["n"], row["tops"]) for row in counted}
        total = sum(n for n, _ in sizes.values())
        if total <= ranges * RANGE_ROWS:
            break
        ranges = -(-total // RANGE_ROWS)  # too few for so many rows: cut once more
    if not total:
        return df.withColumn(output, F.lit(None).cast("double"))
    before, hot, running = [], [], 0
    for i in range(len(splits) + 1):
        n, tops = sizes.get(i, (0, 0))
        before.append(running)
        running += n
        hot.append(float(running - tops + (tops + 1) / 2) if tops * HOT_SHARE > total else None)
    hot_rank = F.when(F.col("_value") == top, F.get(_constant(hot, "double"), F.col("_range")))
    if all(n == tops and h is not None for (n, tops), h in ((sizes[i], hot[i]) for i in sizes)):
        # No row needs the window, so none is shuffled.
        return ranged.withColumn(output, hot_rank / F.lit(total)).drop("_value", "_range")
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(HOT_SHARE))
    placed = ranged.withColumn("_hot", hot_rank).withColumn("_part", F.when(F.col("_hot").isNull() & F.col("_range").isNotNull(), F.lit(0)).otherwise(spread))
    inside = W.partitionBy("_range", "_part").orderBy("_value")
    # The places of the first and the last of the equal rows, from one window: a frame by value ends with the last of them.
    first, last = F.rank().over(inside), F.count("*").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    rank = F.get(_constant(before, "bigint"), F.col("_range")) + (first + last) / F.lit(2.0)
    ranked = placed.withColumn(output, F.when(F.col("_range").isNotNull(), F.coalesce("_hot", rank) / F.lit(total)))
    return ranked.drop("_value", "_range", "_hot", "_part")


def _constant(values: list, kind: str) -> Column:
    """A list of numbers as one folded constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
