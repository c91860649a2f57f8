"""Data-quality rules over whole tables.

A rule contributes checks; a check is a few aggregate expressions and a row condition. All checks of a
run share one aggregation over the table, and one more pass finds up to five examples per failed check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.quantiles import clean, exact_quantiles
from plumbline.operators.skew import balanced_join

CRITICAL, HIGH, MEDIUM, LOW = "critical", "high", "medium", "low"

# Weights of the quality score, the e-mail form and the rule thresholds.
SEVERITY_WEIGHTS = {CRITICAL: 10, HIGH: 5, MEDIUM: 2, LOW: 1}
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
COMPLETENESS_THRESHOLD = 0.95
ANOMALY_THRESHOLD = 3.0
ANOMALY_MIN_VALUES = 10
MAX_HIGH_ISSUES = 5
EXAMPLES = 5

ISSUE_SCHEMA = (
    "column string, issue_type string, severity string, message string, "
    "failed_count bigint, total_count bigint, failure_rate double, examples array<string>"
)

_SPARK_TYPES = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "categorical": (T.StringType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "boolean": (T.BooleanType,),
}


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@dataclass
class Check:
    column: str
    issue_type: str
    severity: str
    failed: Column  # aggregate
    total: Column | None = None  # aggregate; None means all rows
    violation: Column | None = None  # row condition behind the examples
    example: Column | None = None  # value shown for a violating row; the order key when missing
    message: Callable[[Column, Column], Column] | None = None
    fails: Callable[[Column, Column], Column] | None = None
    extra: dict[str, Column] = field(default_factory=dict)
    distinct: str | None = None  # failed are the rows beyond the distinct values of this column and beyond ``failed``


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of distinct non-missing values of each column, as ``d0``, ``d1`` and so on.

    Every column is read and reduced by itself. Several distinct counts in one aggregation would copy each row as often
    as there are columns before the shuffle.
    """
    parts = [
        df.select(clean(df, c).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("one"))
        .agg(F.count("*").alias("d")).select(F.lit(i).alias("i"), "d")
        for i, c in enumerate(columns)
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(*[F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"d{i}") for i in range(len(columns))])


def with_distinct_counts(totals: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The one row of ``totals`` with the distinct counts beside it."""
    return totals.crossJoin(F.broadcast(distinct_counts(df, columns))) if columns else totals


class Moments:
    """Count, mean and deviation of number columns, aggregated once for all rules of a run."""

    def __init__(self, df: DataFrame):
        self.df, self.known = df, {}

    def of(self, columns: Sequence[str]) -> dict[str, tuple]:
        new = [c for c in columns if c not in self.known]
        if new:
            row = self.df.agg(
                *[F.count(clean(self.df, c)).alias(f"n{i}") for i, c in enumerate(new)],
                *[F.avg(clean(self.df, c)).alias(f"m{i}") for i, c in enumerate(new)],
                *[F.stddev_samp(clean(self.df, c)).alias(f"s{i}") for i, c in enumerate(new)],
            ).first()
            self.known.update({c: (row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(new)})
        return {c: self.known[c] for c in columns}


class Rule:
    """Base of all rules. ``prepare`` may run fit aggregations; ``checks`` only builds expressions."""

    severity = MEDIUM

    def prepare(self, df: DataFrame, moments: Moments) -> None:
        return None

    def checks(self, df: DataFrame) -> list[Check]:
        raise NotImplementedError


class Completeness(Rule):
    def __init__(self, threshold: float = COMPLETENESS_THRESHOLD, severity: str = HIGH, columns: Sequence[str] | None = None):
        self.threshold, self.severity, self.columns = threshold, severity, columns

    def checks(self, df: DataFrame) -> list[Check]:
        def rate(failed: Column, total: Column) -> Column:
            return F.when(total > 0, (total - failed) / total).otherwise(F.lit(0.0))

        out = []
        for c in self.columns or df.columns:
            if c not in df.columns:
                continue
            text = f"{c}: %.2f%% of the rows are filled, {100 * self.threshold:.2f}%% are asked for"
            out.append(
                Check(
                    c, "completeness", self.severity,
                    failed=F.count("*") - F.count(clean(df, c)),
                    violation=clean(df, c).isNull(),
                    message=lambda f, t, text=text: F.format_string(text, rate(f, t) * 100),
                    fails=lambda f, t: rate(f, t) < self.threshold,
                )
            )
        return out


class Uniqueness(Rule):
    """Failed are the rows that repeat an earlier value; missing values equal each other."""

    def __init__(self, columns: Sequence[str] | None = None, severity: str = MEDIUM):
        self.columns, self.severity = columns, severity

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c in self.columns or df.columns:
            if c in df.columns:
                value = clean(df, c)
                has_null = F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))
                out.append(
                    Check(
                        c, "uniqueness", self.severity, failed=has_null, distinct=c,
                        message=lambda f, t, c=c: F.format_string(f"{c}: %d rows repeat an earlier value", f),
                    )
                )
        return out


class DataTypes(Rule):
    def __init__(self, expected: dict[str, str], severity: str = MEDIUM):
        self.expected, self.severity = expected, severity

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c, logical in self.expected.items():
            if c not in df.columns:
                continue
            actual = df.schema[c].dataType
            if not isinstance(actual, _SPARK_TYPES.get(logical, ())):
                text = f"{c}: stored as {actual.simpleString()}, declared as {logical}"
                out.append(
                    Check(c, "data_type", self.severity, failed=F.max(F.lit(1)), total=F.max(F.lit(1)),
                          message=lambda f, t, text=text: F.lit(text), fails=lambda f, t: F.lit(True))
                )
        return out


class Range(Rule):
    def __init__(self, ranges: dict[str, tuple[float | None, float | None]], severity: str = MEDIUM):
        self.ranges, self.severity = ranges, severity

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c, (low, high) in self.ranges.items():
            if c not in df.columns or not is_numeric(df.schema[c].dataType):
                continue
            value = clean(df, c)
            below = value < F.lit(low) if low is not None else F.lit(False)
            above = value > F.lit(high) if high is not None else F.lit(False)
            out.append(
                Check(
                    c, "range", self.severity,
                    failed=F.count_if(below) + F.count_if(above),
                    violation=below | above,
                    example=F.col(c),
                    message=lambda f, t, c=c, low=low, high=high: F.format_string(
                        f"{c}: %d values lie outside {low} to {high}", f
                    ),
                )
            )
        return out


class Pattern(Rule):
    """The pattern must match from the start of the value; its end is free unless the pattern says so."""

    def __init__(self, patterns: dict[str, str], severity: str = LOW):
        self.patterns, self.severity = patterns, severity

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c, pattern in self.patterns.items():
            if c not in df.columns:
                continue
            value = F.col(c).cast("string")
            bad = ~value.rlike(f"^(?:{pattern})")
            out.append(
                Check(
                    c, "pattern", self.severity,
                    failed=F.count_if(bad), total=F.count(value), violation=bad, example=value,
                    message=lambda f, t, c=c: F.format_string(f"{c}: %d values do not fit the pattern", f),
                )
            )
        return out


class Domain(Rule):
    """Values outside an allowed set. NULL passes."""

    def __init__(self, allowed: dict[str, Iterable], severity: str = MEDIUM):
        self.allowed, self.severity = {c: list(v) for c, v in allowed.items()}, severity

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c, values in self.allowed.items():
            if c in df.columns:
                bad = ~F.col(c).isin(values)
                out.append(
                    Check(
                        c, "domain", self.severity, failed=F.count_if(bad), violation=bad, example=F.col(c),
                        message=lambda f, t, c=c: F.format_string(f"{c}: %d values are not among those allowed", f),
                    )
                )
        return out


class Anomaly(Rule):
    """Values far from the rest, by quartiles (``iqr``) or by sample deviations (``zscore``)."""

    def __init__(
        self, method: str = "iqr", threshold: float = ANOMALY_THRESHOLD, severity: str = LOW,
        columns: Sequence[str] | None = None, exact: bool = True,
    ):
        if method not in ("iqr", "zscore"):
            raise ValueError(f"unknown method: {method}")
        self.method, self.threshold, self.severity, self.columns, self.exact = method, threshold, severity, columns, exact
        self.fitted: dict[str, tuple] = {}

    def prepare(self, df: DataFrame, moments: Moments) -> None:
        columns = [c for c in (self.columns or numeric_columns(df)) if c in numeric_columns(df)]
        if not columns:
            return
        stats = moments.of(columns)
        if self.method == "iqr":
            counts = {c: n for c, (n, _, _) in stats.items()}
            quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns}, counts=counts, exact=self.exact)
            for c, (q1, q3) in quartiles.items():
                if q1 is not None:
                    reach = self.threshold * (q3 - q1)
                    self.fitted[c] = (q1 - reach, q3 + reach)
        else:
            self.fitted = {c: (mean, std) for c, (_, mean, std) in stats.items() if std}

    def condition(self, df: DataFrame, c: str) -> Column:
        value = clean(df, c).cast("double")
        a, b = self.fitted[c]
        if self.method == "iqr":
            return (value < F.lit(a)) | (value > F.lit(b))
        return F.abs((value - F.lit(a)) / F.lit(b)) > self.threshold

    def checks(self, df: DataFrame) -> list[Check]:
        out = []
        for c in self.fitted:
            bad = self.condition(df, c)
            out.append(
                Check(
                    c, "statistical_anomaly", self.severity,
                    failed=F.count_if(bad), total=F.count(clean(df, c)), violation=bad, example=F.col(c),
                    message=lambda f, t, c=c: F.format_string(
                        f"{c}: %d values lie far from the rest ({self.method})", f
                    ),
                    fails=lambda f, t: (f > 0) & (t >= ANOMALY_MIN_VALUES),
                )
            )
        return out


class Custom(Rule):
    """A user rule: a function from the table to checks."""

    def __init__(self, build: Callable[[DataFrame], list[Check]]):
        self.build = build

    def checks(self, df: DataFrame) -> list[Check]:
        return self.build(df)


def default_rules() -> list[Rule]:
    return [Completeness(), Anomaly("iqr"), Anomaly("zscore"), Pattern({"email": EMAIL_PATTERN})]


def _examples(df: DataFrame, checks: list[Check], key: str) -> DataFrame | None:
    shown = [(i, c) for i, c in enumerate(checks) if c.violation is not None]
    if not shown:
        return None
    order = F.col(key)
    hits = F.filter(
        F.array(*[
            F.when(c.violation, F.struct(F.lit(i).alias("check"), (order if c.example is None else c.example).cast("string").alias("example"), order.alias("at")))
            for i, c in shown
        ]),
        lambda hit: hit.isNotNull(),
    )
    violating = reduce(Column.__or__, [F.coalesce(c.violation, F.lit(False)) for _, c in shown])
    rows = df.filter(violating).select(F.explode(hits).alias("hit")).select("hit.*")
    # A rank limit keeps at most EXAMPLES rows per check in every task before the shuffle.
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("check").orderBy("at", "example"))).filter(F.col("n") <= EXAMPLES)
    return ranked.groupBy("check").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "example"))), lambda e: e["example"]).alias("examples")
    )


def run_rules(df: DataFrame, rules: Sequence[Rule] | None = None, *, key: str | None = None) -> DataFrame:
    """Issues found by the rules, one row each. ``key`` orders the examples; without it there are none."""
    rules = default_rules() if rules is None else list(rules)
    moments = Moments(df)
    for rule in rules:
        rule.prepare(df, moments)
    checks = [check for rule in rules for check in rule.checks(df)]
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], ISSUE_SCHEMA)

    totals = df.agg(
        F.count("*").alias("n"),
        *[c.failed.cast("bigint").alias(f"f{i}") for i, c in enumerate(checks)],
        *[c.total.cast("bigint").alias(f"t{i}") for i, c in enumerate(checks) if c.total is not None],
    )
    counted = list(dict.fromkeys(c.distinct for c in checks if c.distinct))
    totals = with_distinct_counts(totals, df, counted)
    rows = []
    for i, c in enumerate(checks):
        failed = F.coalesce(F.col(f"f{i}"), F.lit(0))
        if c.distinct:
            failed = F.col("n") - F.col(f"d{counted.index(c.distinct)}") - failed
        total = F.coalesce(F.col(f"t{i}"), F.lit(0)) if c.total is not None else F.col("n")
        fails = c.fails(failed, total) if c.fails else failed > 0
        rows.append(
            F.struct(
                F.lit(i).alias("check"),
                fails.alias("fails"),
                F.lit(c.column).alias("column"),
                F.lit(c.issue_type).alias("issue_type"),
                F.lit(c.severity).alias("severity"),
                (c.message(failed, total) if c.message else F.lit(c.issue_type)).alias("message"),
                failed.alias("failed_count"),
                total.alias("total_count"),
                F.when(total > 0, failed / total).otherwise(F.lit(0.0)).alias("failure_rate"),
            )
        )
    issues = totals.select(F.inline(F.array(*rows))).filter("fails").drop("fails")
    parts = [_examples(df, checks, key)] if key else []
    parts += [_repeated(df, i, c.distinct) for i, c in enumerate(checks) if key and c.distinct]
    parts = [part for part in parts if part is not None]
    examples = reduce(DataFrame.unionByName, parts) if parts else None
    if examples is None:
        return issues.withColumn("examples", F.array().cast("array<string>")).drop("check")
    return (
        issues.join(F.broadcast(examples), "check", "left")  # one row per check
        .withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
        .drop("check")
    )


def _repeated(df: DataFrame, check: int, column: str) -> DataFrame:
    """The smallest values that a column has more than once, as examples of its check."""
    values = duplicate_examples(df.select(clean(df, column).alias(column)).filter(F.col(f"`{column}`").isNotNull()), column)
    listed = F.transform(F.sort_array(F.collect_list(F.col(column))), lambda v: v.cast("string"))
    return values.agg(listed.alias("examples")).select(F.lit(check).alias("check"), "examples")


def duplicate_examples(df: DataFrame, column: str, limit: int = EXAMPLES) -> DataFrame:
    """The smallest values that occur more than once, with their row counts."""
    return df.groupBy(column).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").orderBy(column).limit(limit)


def quality_score(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: 100 less the weighted share of failed rows, not below 0. ``rows`` is the checked table."""
    weight = F.lit(0)
    for severity, value in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == severity, value).otherwise(weight)
    n = rows.agg(F.count("*").alias("n_rows"))
    totals = issues.agg(F.sum(weight * F.col("failed_count")).alias("weighted"), F.count("*").alias("total_issues"))
    score = F.when((F.col("n_rows") == 0) | (F.col("total_issues") == 0), F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), 100 - 100 * F.col("weighted") / F.nullif(F.col("n_rows"), F.lit(0)))
    )
    return totals.crossJoin(F.broadcast(n)).select("total_issues", "n_rows", F.round(score, 2).alias("quality_score"))


def verdict(issues: DataFrame) -> DataFrame:
    """One row: whether the table passed, and the issues per severity."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in SEVERITY_WEIGHTS]
    totals = issues.agg(F.count("*").alias("total_issues"), *counts)
    return totals.withColumn("passed", (F.col("critical_issues") == 0) & (F.col("high_issues") <= MAX_HIGH_ISSUES))


def column_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Per column: issues, completeness, share of distinct values and type."""
    totals = df.agg(
        F.count("*").alias("n"),
        *[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)],
    )
    totals = with_distinct_counts(totals, df, df.columns)
    n = F.nullif(F.col("n"), F.lit(0))
    stats = totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(f.name).alias("column"),
            F.coalesce(F.col(f"v{i}") / n, F.lit(0.0)).alias("completeness"),
            F.coalesce(F.col(f"d{i}") / n, F.lit(0.0)).alias("uniqueness"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
        )
        for i, f in enumerate(df.schema.fields)
    ])))
    per_column = issues.groupBy("column").agg(F.count("*").alias("issues_count"))
    return stats.join(per_column, "column", "left").withColumn("issues_count", F.coalesce("issues_count", F.lit(0)))


def severity_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"), F.sum("failed_count").alias("failed_rows"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    return balanced_join(df, repeated, keys, "left_semi")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys without a parent row, and their row counts. Rows are counted per key before the join."""
    counted = df.groupBy(F.col(key).alias(parent_key)).agg(F.count("*").alias("n_rows"))
    missing = counted.join(parent.select(parent_key).distinct(), parent_key, "left_anti")
    return missing.withColumnRenamed(parent_key, key)


def dataset_checks(df: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """Named yes/no checks from aggregate conditions, all in one aggregation."""
    row = df.agg(*[F.coalesce(cond, F.lit(True)).alias(f"c{i}") for i, (cond, _) in enumerate(checks.values())])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("passed"), F.lit(text).alias("description"))
        for i, (name, (_, text)) in enumerate(checks.items())
    ])))


def not_null_check(df: DataFrame, columns: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """One result row over several columns, which fail with more than ``1 - threshold`` missing values."""
    present = [c for c in columns if c in df.columns]
    totals = df.agg(F.count("*").alias("n"), *[F.count_if(clean(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(present)])
    over = [F.col(f"m{i}") / F.nullif(F.col("n"), F.lit(0)) > 1 - threshold for i in range(len(present))]
    failed = sum((F.when(o, F.col(f"m{i}")).otherwise(0) for i, o in enumerate(over)), F.lit(0))
    names = F.array_compact(F.array(*[F.when(o, F.lit(c)) for o, c in zip(over, present)]))
    return totals.select(
        F.lit("not_null_check").alias("check_name"),
        (F.size(names) == 0).alias("passed"),
        F.lit(HIGH).alias("severity"),
        failed.cast("bigint").alias("failed_count"),
        (F.col("n") * len(columns)).alias("total_count"),
        F.array_join(names, ",").alias("failed_columns"),
    )


def check_report(results: DataFrame) -> DataFrame:
    """Totals over check results with ``passed`` and ``severity``."""
    failed = ~F.col("passed")
    totals = results.agg(
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"failed_{s}") for s in SEVERITY_WEIGHTS],
    )
    rate = F.coalesce(F.col("passed_checks") / F.nullif(F.col("total_checks"), F.lit(0)), F.lit(0.0))
    return totals.withColumn("success_rate", rate)


def final_qa(df: DataFrame) -> DataFrame:
    """Findings on a finished table: empty, without columns, all-missing columns, wide string columns."""
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame([("no_columns", None)], "finding string, column string")
    strings = string_columns(df)
    totals = df.agg(
        F.count("*").alias("n"),
        *[F.count(clean(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)],
    )
    totals = with_distinct_counts(totals, df, strings)
    none = F.lit(None).cast("string")

    def finding(name: str, column: Column, when: Column) -> Column:
        return F.struct(F.lit(name).alias("finding"), column.alias("column"), when.alias("found"))

    rows = [finding("empty_dataset", none, F.col("n") == 0)]
    rows += [finding("all_missing", F.lit(c), F.col(f"v{i}") == 0) for i, c in enumerate(df.columns)]
    rows += [finding("high_cardinality", F.lit(c), F.col(f"d{i}") > F.col("n") * 0.5) for i, c in enumerate(strings)]
    return totals.select(F.inline(F.array(*rows))).filter("found").drop("found")


# Substrings that mark a suspicious access-log line.
SUSPICIOUS_PATTERNS = (r"\.\./", "<script>", "UNION SELECT", "/admin", "/wp-admin")


def scan_log_lines(lines: DataFrame, line: str, keep: Sequence[str] = (), patterns: Sequence[str] = SUSPICIOUS_PATTERNS) -> DataFrame:
    """One row per line and pattern it contains, ignoring case, with the line's first word as source."""
    lower = F.lower(F.col(line))
    found = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(lower, F.lower(p)))
    return lines.select(
        *keep, F.split(F.trim(F.col(line)), r"\s+")[0].alias("source"), F.explode(found).alias("pattern")
    ).withColumn("severity", F.lit(HIGH))


def drift(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, *, exact: bool = True) -> DataFrame:
    """Population stability of a column over the reference's quantile bins, one row per bin."""
    cuts = exact_quantiles(reference, {column: [i / bins for i in range(1, bins)]}, exact=exact)[column]

    def shares(df: DataFrame, name: str) -> DataFrame:
        value = clean(df, column).cast("double")
        index = F.lit(0)
        for cut in cuts:
            index = index + (value > F.lit(cut)).cast("int")
        counts = df.filter(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
        return counts.select("bin", (F.col("n") / F.sum("n").over(W.partitionBy())).alias(name))  # ``bins`` rows

    both = shares(reference, "reference_share").join(shares(current, "current_share"), "bin", "full_outer")
    floor = F.lit(1e-6)
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), floor) for c in ("reference_share", "current_share"))
    return both.select(
        "bin",
        F.coalesce("reference_share", F.lit(0.0)).alias("reference_share"),
        F.coalesce("current_share", F.lit(0.0)).alias("current_share"),
        ((b - a) * F.log(b / a)).alias("psi"),
    )
