"""Cleaning steps as fit/transform pairs.

A fit runs a few aggregations and keeps a small set of parameters; a transform is a projection (for a
large label dictionary, a join), so a fitted step also runs on new data and on a stream. Parameters are
saved as one JSON row, dictionaries as Parquet tables.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.gram import gram_correlations
from plumbline.operators.profile import value_counts
from plumbline.operators.quality import is_numeric, numeric_columns, string_columns
from plumbline.operators.quantiles import clean, exact_quantiles
from plumbline.operators.rank import running_totals
from plumbline.operators.skew import balanced_join

# Share of missing values that drops a column, capping factors, one-hot cardinality.
DROP_COLUMN_SHARE = 0.5
IQR_FACTOR = 1.5
ZSCORE_FACTOR = 3.0
ONE_HOT_MIN, ONE_HOT_MAX = 3, 10
MISSING = "missing"
INLINE_CODES = 200

_TIMES = (T.TimestampType, T.TimestampNTZType)


def _targets(df: DataFrame, columns: Sequence[str] | None, skip: Sequence[str]) -> list[str]:
    return [c for c in (df.columns if columns is None else columns) if c in df.columns and c not in set(skip)]


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest among equals. Values are counted before they meet."""
    out: dict[str, object] = {}
    text = [c for c in columns if not is_numeric(df.schema[c].dataType)]
    numbers = [c for c in columns if is_numeric(df.schema[c].dataType)]
    for names, kind in ((text, "string"), (numbers, "double")):
        if not names:
            continue
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), clean(df, c).cast(kind).alias("value")) for c in names])
        counts = df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("best"))
        out.update({row["column"]: row["best"]["value"] for row in best.collect()})  # one row per column
    return out


@dataclass
class ImputeModel:
    fills: dict[str, object] = field(default_factory=dict)
    strategies: dict[str, str] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    drop_columns: list[str] = field(default_factory=list)
    drop_rows: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.drop_rows:
            df = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in self.drop_rows))
        changes = {}
        for c, value in self.fills.items():
            if c not in df.columns:
                continue
            kind = df.schema[c].dataType
            if isinstance(kind, _TIMES + (T.DateType,)):
                changes[c] = F.coalesce(F.col(c), F.timestamp_micros(F.lit(int(value))).cast(kind))
            elif is_numeric(kind):
                changes[c] = F.coalesce(clean(df, c).cast("double"), F.lit(float(value)))
            else:
                changes[c] = F.coalesce(F.col(c), F.lit(value).cast(kind))
        return (df.withColumns(changes) if changes else df).drop(*self.drop_columns)


def fit_impute(
    df: DataFrame, strategy: str = "auto", *, columns: Sequence[str] | None = None, skip: Sequence[str] = (),
    constant: object = "unknown", exact: bool = True,
) -> ImputeModel:
    """``auto`` drops a mostly missing column and fills text with the mode and other types with the median.

    Other strategies: ``drop`` rows, ``mean``, ``median`` (numbers only), ``mode``, ``constant`` (text only).
    """
    columns = _targets(df, columns, skip)
    row = df.agg(F.count("*").alias("n"), *[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    n = row["n"]
    model = ImputeModel(missing={c: n - row[f"v{i}"] for i, c in enumerate(columns) if row[f"v{i}"] < n})
    kind = {c: df.schema[c].dataType for c in model.missing}
    number = [c for c in model.missing if is_numeric(kind[c])]
    time = [c for c in model.missing if isinstance(kind[c], _TIMES + (T.DateType,))]
    text = [c for c in model.missing if c not in number + time]
    plan: dict[str, str] = {}
    if strategy == "auto":
        model.drop_columns = [c for c in model.missing if model.missing[c] > DROP_COLUMN_SHARE * n]
        plan = {c: "mode" if c in text else "median" for c in model.missing if c not in model.drop_columns}
        model.strategies = {c: "drop_column" for c in model.drop_columns}
    elif strategy == "drop":
        model.drop_rows = list(model.missing)
        model.strategies = {c: "drop_rows" for c in model.missing}
    elif strategy in ("mean", "median"):
        plan = {c: strategy for c in number}
    elif strategy == "mode":
        plan = {c: "mode" for c in model.missing}
    elif strategy == "constant":
        plan = {c: "constant" for c in text}
    else:
        raise ValueError(f"unknown strategy: {strategy}")

    median = [c for c, s in plan.items() if s == "median"]
    if median:
        micros = df.select(*[
            F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in time else clean(df, c).alias(c) for c in median
        ])
        counts = {c: n - model.missing[c] for c in median}
        for c, (value,) in exact_quantiles(micros, {c: [0.5] for c in median}, counts=counts, exact=exact).items():
            model.fills[c] = value
    mean = [c for c, s in plan.items() if s == "mean"]
    if mean:
        means = df.agg(*[F.avg(clean(df, c)).alias(f"m{i}") for i, c in enumerate(mean)]).first()
        model.fills.update({c: means[f"m{i}"] for i, c in enumerate(mean)})
    mode = [c for c, s in plan.items() if s == "mode"]
    if mode:
        found = modes(df.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in time else F.col(c) for c in mode]), mode)
        model.fills.update({c: found.get(c, "unknown" if c in text else None) for c in mode})
    model.fills.update({c: constant for c, s in plan.items() if s == "constant"})
    model.fills = {c: v for c, v in model.fills.items() if v is not None}
    for c in model.missing:
        model.strategies.setdefault(c, f"{plan[c]}_fill" if c in model.fills else "no_action")
    return model


def group_median_impute(df: DataFrame, column: str, groups: Sequence[str]) -> DataFrame:
    """Fill a column with the median of its group, then with the overall median.

    Stands in for a nearest-neighbour fill: ``groups`` are coarse bins of the other columns. Each group's
    values are counted first, and the counts are summed in value order inside ranges of bounded size.
    """
    value = clean(df, column).cast("double")
    data = df.withColumn("_value", value + F.lit(0.0))
    counts = data.filter("_value IS NOT NULL").groupBy(*groups, "_value").agg(F.count("*").alias("n"))
    placed = running_totals(counts, "_value", ["n"], keys=list(groups))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    ranged = balanced_join(placed, totals, list(groups), "inner")

    def at(position: Column) -> Column:
        here = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col("_value")))

    low, high = F.floor((F.col("total") - 1) / F.lit(2)), F.floor(F.col("total") / F.lit(2))
    medians = ranged.groupBy(*groups).agg(((at(low) + at(high)) / F.lit(2.0)).alias("_median"))
    overall = exact_quantiles(df, {column: [0.5]})[column][0]
    joined = balanced_join(data, medians, list(groups), "left")
    return joined.withColumn(column, F.coalesce("_value", "_median", F.lit(overall).cast("double"))).drop("_value", "_median")


@dataclass
class CapModel:
    method: str
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        changes = {
            c: F.when(clean(df, c).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(c).cast("double"))))
            for c, (lo, hi) in self.bounds.items() if c in df.columns
        }
        return df.withColumns(changes) if changes else df

    def report(self, df: DataFrame) -> DataFrame:
        """Outliers per column and the bounds they are capped to."""
        columns = [c for c in self.bounds if c in df.columns]
        row = df.agg(*[
            F.count_if((clean(df, c) < self.bounds[c][0]) | (clean(df, c) > self.bounds[c][1])).alias(f"o{i}")
            for i, c in enumerate(columns)
        ])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers"),
                     F.lit(float(self.bounds[c][0])).alias("lower_bound"), F.lit(float(self.bounds[c][1])).alias("upper_bound"))
            for i, c in enumerate(columns)
        ])))


def fit_cap(
    df: DataFrame, method: str = "iqr", *, factor: float | None = None, columns: Sequence[str] | None = None,
    skip: Sequence[str] = (), exact: bool = True,
) -> CapModel:
    """Bounds for capping outliers by quartiles or deviations; a column with one value has none."""
    model = CapModel(method)
    if method == "none":
        return model
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method: {method}")
    numbers = [c for c in _targets(df, columns, skip) if is_numeric(df.schema[c].dataType)]
    if not numbers:
        return model
    row = df.agg(
        *[F.count(clean(df, c)).alias(f"n{i}") for i, c in enumerate(numbers)],
        *[F.min(clean(df, c)).alias(f"lo{i}") for i, c in enumerate(numbers)],
        *[F.max(clean(df, c)).alias(f"hi{i}") for i, c in enumerate(numbers)],
        *[F.avg(clean(df, c)).alias(f"m{i}") for i, c in enumerate(numbers)],
        *[F.stddev_samp(clean(df, c)).alias(f"s{i}") for i, c in enumerate(numbers)],
    ).first()
    varied = [(i, c) for i, c in enumerate(numbers) if row[f"lo{i}"] != row[f"hi{i}"]]
    if method == "iqr":
        factor = IQR_FACTOR if factor is None else factor
        counts = {c: row[f"n{i}"] for i, c in varied}
        for c, (q1, q3) in exact_quantiles(df, {c: [0.25, 0.75] for _, c in varied}, counts=counts, exact=exact).items():
            model.bounds[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    else:
        factor = ZSCORE_FACTOR if factor is None else factor
        model.bounds = {c: (row[f"m{i}"] - factor * row[f"s{i}"], row[f"m{i}"] + factor * row[f"s{i}"]) for i, c in varied}
    return model


@dataclass
class EncodeModel:
    methods: dict[str, str] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)  # one-hot values or inline label order
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    default_target: float | None = None
    fill: str | None = None
    dummy_missing: bool = True
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for c, method in self.methods.items():
            if c not in df.columns:
                continue
            value = F.col(c).cast("string")
            if method == "one_hot":
                if self.fill is not None:
                    value = F.coalesce(value, F.lit(self.fill))
                columns = {f"{c}_{v}": F.coalesce(value == v, F.lit(False)) for v in self.values[c]}
                if self.dummy_missing:
                    columns[f"{c}_nan"] = value.isNull()
                df = df.withColumns(columns).drop(c)
            elif method == "label" and c in self.dictionaries:
                keyed = df.withColumn("_label", F.coalesce(value, F.lit(MISSING)))
                codes = self.dictionaries[c].select(F.col("value").alias("_label"), F.col("code").alias("_code"))
                df = balanced_join(keyed, codes, ["_label"], "left").withColumn(c, F.col("_code")).drop("_label", "_code")
            elif method == "label":
                values = F.array(*[F.lit(v) for v in self.values[c]])
                position = F.array_position(values, F.coalesce(value, F.lit(MISSING)))
                df = df.withColumn(c, F.when(position > 0, position - 1))
            elif method == "target" and c in self.dictionaries:
                means = self.dictionaries[c].select(F.col("value").alias("_label"), F.col("mean").alias("_mean"))
                joined = balanced_join(df.withColumn("_label", F.coalesce(value, F.lit(MISSING))), means, ["_label"], "left")
                df = joined.withColumn(c, F.coalesce("_mean", F.lit(self.default_target))).drop("_label", "_mean")
        return df


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their position in sort order, from 0; missing values are one value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    distinct = df.select(value.alias("value")).groupBy("value").agg(F.lit(1).alias("one"))
    return running_totals(distinct, "value", ["one"]).select("value", F.col("one_before").cast("bigint").alias("code"))


def target_means(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Mean target per value, drawn towards the overall mean by ``smoothing`` imaginary rows."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    groups = df.groupBy(value.alias("value")).agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(target).alias("n"))
    overall = df.agg(F.avg(F.col(target).cast("double")).alias("m"))
    return groups.crossJoin(F.broadcast(overall)).select(
        "value", ((F.col("s") + smoothing * F.col("m")) / (F.col("n") + smoothing)).alias("mean")
    )


def fit_encode(
    df: DataFrame, strategy: str = "auto", *, columns: Sequence[str] | None = None, skip: Sequence[str] = (),
    target: str | None = None, smoothing: float = 10.0, fill: str | None = None, dummy_missing: bool = True, max_one_hot: int | None = None,
) -> EncodeModel:
    """``auto`` one-hot encodes columns of 3 to 10 values and numbers the sorted values of the others.

    Also ``onehot`` (values not seen in the fit get no column), ``label``, ``target`` and ``none``. With ``max_one_hot``
    columns of more values are numbered instead of getting a column for each value.
    """
    model = EncodeModel(fill=fill, dummy_missing=dummy_missing)
    names = [c for c in _targets(df, columns, skip) if c in string_columns(df)]
    if strategy == "none" or not names:
        return model
    if strategy not in ("auto", "onehot", "label", "target"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "target":
        if target is None:
            raise ValueError("target encoding needs the target column")
        for c in names:
            model.methods[c] = "target"
            model.dictionaries[c] = target_means(df, c, target, smoothing)
        model.default_target = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
        return model

    data = df if fill is None else df.fillna(fill, subset=names)
    counts = value_counts(data, names)
    sizes = {row["column"]: row["n"] for row in counts.groupBy("column").agg(F.count("*").alias("n")).collect()}
    sizes = {c: sizes.get(c, 0) for c in names}
    for c in names:
        one_hot = (strategy == "onehot" and (max_one_hot is None or sizes[c] <= max_one_hot)) or (
            strategy == "auto" and ONE_HOT_MIN <= sizes[c] <= ONE_HOT_MAX
        )
        model.methods[c] = "one_hot" if one_hot else "label"
    small = [c for c in names if model.methods[c] == "one_hot" or sizes[c] <= INLINE_CODES]
    if small:
        # Counted above: at most INLINE_CODES values per label column, and one column per one-hot value.
        rows = counts.filter(F.col("column").isin(small)).select("column", "value").collect()
        for c in small:
            model.values[c] = sorted((r["value"] for r in rows if r["column"] == c), key=lambda v: v.encode())
        labels = [c for c in small if model.methods[c] == "label"]
        if labels:
            nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(labels)]).first()
            for i, c in enumerate(labels):
                if nulls[f"n{i}"]:
                    model.values[c] = sorted(set(model.values[c]) | {MISSING}, key=lambda v: v.encode())
    for c in names:
        if c not in small:
            model.dictionaries[c] = label_codes(df, c)
    return model


@dataclass
class ScaleModel:
    method: str
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    binary: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        changes = {
            c: (F.col(c).cast("double") - F.lit(float(center))) / F.lit(float(self.scales[c]))
            for c, center in self.centers.items() if c in df.columns
        }
        return df.withColumns(changes) if changes else df


def fit_scale(
    df: DataFrame, method: str = "robust", *, columns: Sequence[str] | None = None, skip: Sequence[str] = (), exact: bool = True
) -> ScaleModel:
    """Centre and scale per number column: ``robust``, ``standard``, ``minmax`` or ``none``.

    Columns that hold exactly 0 and 1 stay as they are. A scale of 0 becomes 1.
    """
    model = ScaleModel(method)
    if method == "none":
        return model
    if method not in ("robust", "standard", "minmax"):
        raise ValueError(f"unknown method: {method}")
    numbers = [c for c in _targets(df, columns, skip) if c in numeric_columns(df)]
    if not numbers:
        return model
    aggregates = []
    for i, c in enumerate(numbers):
        value = clean(df, c).cast("double")
        aggregates += [
            F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.avg(value).alias(f"m{i}"),
            F.stddev_pop(value).alias(f"s{i}"), F.count(value).alias(f"n{i}"), F.count_if(~value.isin(0.0, 1.0)).alias(f"x{i}"),
        ]
    row = df.agg(*aggregates).first()
    model.binary = [c for i, c in enumerate(numbers) if (row[f"lo{i}"], row[f"hi{i}"], row[f"x{i}"]) == (0.0, 1.0, 0)]
    scaled = [(i, c) for i, c in enumerate(numbers) if c not in model.binary and row[f"lo{i}"] is not None]
    if method == "robust":
        counts = {c: row[f"n{i}"] for i, c in scaled}
        quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for _, c in scaled}, counts=counts, exact=exact)
        for c, (q1, q2, q3) in quartiles.items():
            model.centers[c], model.scales[c] = q2, (q3 - q1) or 1.0
    for i, c in scaled:
        if method == "standard":
            model.centers[c], model.scales[c] = row[f"m{i}"], row[f"s{i}"] or 1.0
        elif method == "minmax":
            model.centers[c], model.scales[c] = row[f"lo{i}"], (row[f"hi{i}"] - row[f"lo{i}"]) or 1.0
    return model


# Exclusive upper bounds of the unsigned and inclusive bounds of the signed widths.
_UNSIGNED = ((255, T.ShortType()), (65535, T.IntegerType()), (4294967295, T.LongType()))
_SIGNED = ((-128, 127, T.ByteType()), (-32768, 32767, T.ShortType()), (-2147483648, 2147483647, T.IntegerType()))


@dataclass
class NarrowModel:
    types: dict[str, str] = field(default_factory=dict)
    empty: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        changes = {c: F.col(c).cast(t) for c, t in self.types.items() if c in df.columns}
        return (df.withColumns(changes) if changes else df).drop(*self.empty)


def fit_narrow(df: DataFrame, *, skip: Sequence[str] = (), drop_empty: bool = False) -> NarrowModel:
    """Smaller types that hold every value. Unsigned widths take the next signed type.

    A double becomes a float only if no value changes and none is missing. With ``drop_empty`` the same
    aggregation also finds the columns without any value, and the transform leaves them out.
    """
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType) and f.name not in skip]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in skip]
    model = NarrowModel()
    if not longs and not doubles and not drop_empty:
        return model
    checked = df.columns if drop_empty else []
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(checked)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(longs)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(longs)],
        *[F.count_if((F.col(c).cast("float").cast("double") == F.col(c)) & ~F.isnan(c)).alias(f"same{i}") for i, c in enumerate(doubles)],
    ).first()
    model.empty = [c for i, c in enumerate(checked) if not row[f"v{i}"]]
    for i, c in enumerate(longs):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is None:
            continue
        if low >= 0:
            fit = next((t for bound, t in _UNSIGNED if high < bound), None)
        else:
            fit = next((t for a, b, t in _SIGNED if a <= low and high <= b), None)
        if fit is not None and not isinstance(fit, T.LongType):
            model.types[c] = fit.simpleString()
    for i, c in enumerate(doubles):
        if row["n"] and row[f"same{i}"] == row["n"]:
            model.types[c] = "float"
    return model


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all."""
    row = df.agg(*[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if not row[f"v{i}"]])


def unique_columns(df: DataFrame) -> DataFrame:
    """The first column of each name."""
    seen: set[str] = set()
    fresh = [n not in seen and not seen.add(n) for n in df.columns]
    if all(fresh):
        return df
    marked = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return marked.select(*[F.col(f"c{i}").alias(n) for i, (n, keep) in enumerate(zip(df.columns, fresh)) if keep])


PLAIN_COLUMNS = 24  # up to so many, an aggregate for every pair compiles well


def select_features(df: DataFrame, features: Sequence[str], target: str, k: int | None = None, max_pair: float = 0.95) -> list[str]:
    """The ``k`` features most correlated with the target, leaving out near copies of a better one."""
    number = {c: clean(df, c).cast("double") for c in [*features, target]}
    if len(features) > PLAIN_COLUMNS:
        wide = df.select(*[v.alias(c) for c, v in number.items()])
        found = {frozenset((r["column_a"], r["column_b"])): r["correlation"] for r in gram_correlations(wide, [*features, target]).collect()}
        strength = {c: abs(found[frozenset((c, target))] or 0.0) for c in features}
        close = {pair for pair, r in found.items() if target not in pair and abs(r or 0.0) > max_pair}
    else:
        pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
        row = df.agg(
            *[F.corr(number[c], number[target]).alias(f"t{i}") for i, c in enumerate(features)],
            *[F.corr(number[a], number[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
        ).first()
        strength = {c: abs(row[f"t{i}"] or 0.0) for i, c in enumerate(features)}
        close = {frozenset(p) for i, p in enumerate(pairs) if abs(row[f"p{i}"] or 0.0) > max_pair}
    chosen: list[str] = []
    for c in sorted(features, key=lambda c: (-strength[c], c)):
        if not any(frozenset((c, other)) in close for other in chosen):
            chosen.append(c)
    return chosen[:k]


_MODELS = {m.__name__: m for m in (ImputeModel, CapModel, ScaleModel, NarrowModel, EncodeModel)}
_DATES = {"date": date, "datetime": datetime}


def to_json(value: object) -> str:
    """JSON of fitted parameters; dates and times keep their type."""
    return json.dumps(value, default=lambda v: {f"_{type(v).__name__}": v.isoformat()})


def from_json(text: str) -> object:
    def restore(found: dict) -> object:
        (name, value), *more = found.items() if found else [("", None)]
        kind = _DATES.get(name[1:]) if name.startswith("_") and not more else None
        return kind.fromisoformat(value) if kind else found

    return json.loads(text, object_hook=restore)


def save_model(model, spark: SparkSession, path: str) -> None:
    """Parameters as one JSON row below ``path``; each dictionary as a Parquet table beside it."""
    dictionaries = getattr(model, "dictionaries", {})
    plain = {k: v for k, v in vars(model).items() if k != "dictionaries"}
    body = to_json({"kind": type(model).__name__, "params": plain, "dictionaries": sorted(dictionaries)})
    for name, table in dictionaries.items():
        table.write.mode("overwrite").parquet(f"{path}/dictionary_{name}")
    spark.createDataFrame([(body,)], "params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str):
    body = from_json(spark.read.parquet(f"{path}/params").first()["params"])
    model = _MODELS[body["kind"]](**body["params"])
    for name in body["dictionaries"]:
        model.dictionaries[name] = spark.read.parquet(f"{path}/dictionary_{name}")
    return model
