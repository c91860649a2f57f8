"""Column expressions shared by batch and streaming jobs. All are built-in functions, no UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# The plan hierarchy and the score of every other plan.
PLAN_SCORES = {"free": 0, "trial": 1, "basic": 2, "premium": 3, "enterprise": 4, "unknown": 1}
PLAN_SCORE_DEFAULT = 1

# The customer segment thresholds.
VIP_SPEND = 1000
LOYAL_ORDERS = 5

# The points .1 Low, .3 Medium, .7 High and .9 Critical are given; the cuts between them are ours.
RISK_CUTS = ((0.25, "Low"), (0.5, "Medium"), (0.8, "High"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down (not a calendar date difference)."""
    micros = F.unix_micros(_col(later).cast("timestamp")) - F.unix_micros(_col(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(DAY_MICROS))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as a double; a non-zero number over zero gives 0, zero over zero gives NULL."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when((den == 0) & (num != 0), F.lit(0.0)).otherwise(F.try_divide(num, den))


def pct_change(current: Column, previous: Column) -> Column:
    """Relative change; a missing or 0/0 change is 0 and a change from zero keeps its infinity."""
    current, previous = current.cast("double"), previous.cast("double")
    return (
        F.when(previous.isNull() | current.isNull(), F.lit(0.0))
        .when((previous == 0) & (current == 0), F.lit(0.0))
        .when((previous == 0) & (current > 0), F.lit(float("inf")))
        .when(previous == 0, F.lit(float("-inf")))
        .otherwise(F.try_divide(current, previous) - 1)
    )


def recency_score(days: Column | str, scale: float = 30.0) -> Column:
    return F.exp(-_col(days).cast("double") / F.lit(scale))


def calendar_parts(date: Column | str) -> dict[str, Column]:
    """Day of week counts from Monday = 0; Saturday and Sunday are the weekend."""
    date = _col(date)
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(date),
        "day_of_year": F.dayofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def datetime_parts(name: str) -> dict[str, Column]:
    """Columns ``<name>_year`` … ``<name>_hour`` of a timestamp."""
    ts = F.col(name)
    return {
        f"{name}_year": F.year(ts),
        f"{name}_month": F.month(ts),
        f"{name}_day": F.dayofmonth(ts),
        f"{name}_dayofweek": F.weekday(ts),
        f"{name}_hour": F.hour(ts),
    }


def lookup(column: Column | str, mapping: Mapping[str, object], default: object) -> Column:
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[_col(column)], F.lit(default))


def plan_value_score(plan: Column | str) -> Column:
    return lookup(plan, PLAN_SCORES, PLAN_SCORE_DEFAULT)


def customer_segment(total_orders: Column | str, total_spent: Column | str) -> Column:
    orders, spent = _col(total_orders), _col(total_spent)
    return (
        F.when(orders == 0, "new")
        .when(spent >= VIP_SPEND, "vip")
        .when(orders >= LOYAL_ORDERS, "loyal")
        .otherwise("regular")
    )


def risk_category(probability: Column | str) -> Column:
    p = _col(probability)
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for cut, label in RISK_CUTS:
        chain = chain.when(p < cut, label)
    return chain.otherwise("Critical")


def parse_timestamp(text: Column | str) -> Column:
    """An ISO timestamp or a plain ``yyyy-MM-dd`` date; anything else is NULL."""
    text = F.trim(_col(text))
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def normalise_names(names: Iterable[str]) -> list[str]:
    """Trim, turn punctuation and runs of blanks into ``_``, lower-case. Duplicates are kept here."""
    return [re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "_", name.strip())).lower() for name in names]
