"""One declaration per blueprint. Schemas, row rules and column lists are all derived from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import elapsed_days

LOGICAL_TYPES = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "categorical": T.StringType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}

NO_DEFAULT = object()


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    nullable: bool = False
    minimum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    allowed: tuple[str, ...] | None = None
    default: object = NO_DEFAULT
    listed: bool = True  # False: only row validation knows the field
    lower: bool = False
    description: str = ""

    @property
    def spark_type(self) -> T.DataType:
        return LOGICAL_TYPES[self.type]


@dataclass(frozen=True)
class RowRule:
    """A condition over several fields. ``broken`` gets the ``as_of`` column and the settings."""

    field: str
    broken: Callable[[Column, dict], Column]
    message: str
    needs: tuple[str, ...]


@dataclass(frozen=True)
class Blueprint:
    name: str
    fields: tuple[Field, ...]
    rules: tuple[RowRule, ...] = ()
    warnings: tuple[RowRule, ...] = ()
    settings: dict = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def optional(self) -> list[str]:
        return [f.name for f in self.fields if not f.required and f.listed]

    def struct_type(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(f.name, f.spark_type, not f.required, {"description": f.description})
                for f in self.fields
                if f.listed
            ]
        )

    def json_schema(self) -> dict:
        """The JSON Schema form of the listed fields. Other columns are allowed."""
        names = {"integer": "integer", "float": "number", "boolean": "boolean"}
        properties = {}
        for f in self.fields:
            if not f.listed:
                continue
            kind = names.get(f.type, "string")
            spec: dict = {"type": [kind, "null"] if f.nullable and not f.required else kind}
            for key, value in (
                ("minimum", f.minimum), ("minLength", f.min_length), ("maxLength", f.max_length),
                ("enum", list(f.allowed) if f.allowed else None),
                ("format", {"datetime": "date-time", "date": "date"}.get(f.type)),
            ):
                if value is not None:
                    spec[key] = value
            properties[f.name] = spec
        return {"type": "object", "properties": properties, "required": self.required, "additionalProperties": True}


# Plan names of the churn table.
PLANS = ("basic", "premium", "enterprise", "trial", "free", "unknown")

CUSTOMER_CHURN = Blueprint(
    name="customer_churn",
    fields=(
        Field("customer_id", "string", required=True, min_length=1, max_length=100, description="Unique customer identifier"),
        Field("last_activity_date", "datetime", required=True, description="Most recent interaction"),
        Field("account_created_date", "datetime", required=True, description="Account creation"),
        Field("total_value", "float", required=True, minimum=0, description="Lifetime value"),
        Field("support_tickets", "integer", minimum=0, default=0),
        Field("feature_usage_count", "integer", minimum=0, default=0),
        Field("plan_type", "categorical", allowed=PLANS, default="unknown", lower=True),
        Field("login_frequency", "float", nullable=True, minimum=0, default=None, listed=False),
        Field("payment_failures", "integer", minimum=0, default=0, listed=False),
        Field("referral_count", "integer", minimum=0, default=0, listed=False),
    ),
    rules=(
        RowRule(
            "account_created_date",
            lambda as_of, s: F.col("account_created_date") > F.col("last_activity_date"),
            "created later than the last activity",
            ("account_created_date", "last_activity_date"),
        ),
        RowRule(
            "account_created_date",
            lambda as_of, s: elapsed_days(as_of, "account_created_date") > s["max_age_days"],
            "account is older than the limit",
            ("account_created_date",),
        ),
        RowRule(
            "account_created_date",
            lambda as_of, s: elapsed_days(as_of, "account_created_date") < 0,
            "created after the reference time",
            ("account_created_date",),
        ),
        RowRule(
            "last_activity_date",
            lambda as_of, s: elapsed_days(as_of, "last_activity_date") < 0,
            "active after the reference time",
            ("last_activity_date",),
        ),
    ),
    warnings=(
        RowRule("total_value", lambda as_of, s: F.col("total_value") > 1_000_000, "value is above one million", ("total_value",)),
        RowRule(
            "feature_usage_count",
            lambda as_of, s: (F.col("feature_usage_count") > 0) & (F.col("login_frequency") == 0),
            "features are used but nobody logs in",
            ("feature_usage_count", "login_frequency"),
        ),
    ),
    settings={"max_age_days": 20 * 365},
)

REVENUE_PROJECTION = Blueprint(
    name="revenue_projection",
    fields=(
        Field("date", "date", required=True, description="Day of the record"),
        Field("revenue", "float", required=True, minimum=0, description="Revenue of the day"),
        Field("customer_count", "integer", nullable=True, minimum=0, default=None),
        Field("marketing_spend", "float", minimum=0, default=0.0, listed=False),
        Field("product_launches", "integer", minimum=0, default=0, listed=False),
        Field("seasonal_factor", "float", minimum=0, default=1.0, listed=False),
    ),
    rules=(
        RowRule(
            "date",
            lambda as_of, s: F.col("date").cast("date") > F.date_add(as_of.cast("date"), 1),
            "day lies after the reference day",
            ("date",),
        ),
    ),
    warnings=(
        RowRule("revenue", lambda as_of, s: F.col("revenue") > 10_000_000, "revenue is above ten million", ("revenue",)),
    ),
)

PRICE_OPTIMIZATION = Blueprint(
    name="price_optimization",
    fields=(
        Field("product_id", "string", required=True, min_length=1, max_length=100, description="Product identifier"),
        Field("price", "float", required=True, minimum=0.01, description="Unit price"),
        Field("quantity_sold", "integer", required=True, minimum=0, description="Units sold"),
        Field("date", "date", required=True, description="Sale date"),
        Field("cost_per_unit", "float", nullable=True, minimum=0, default=None, listed=False),
        Field("competitor_price", "float", nullable=True, minimum=0, default=None, listed=False),
        Field("promotion_active", "boolean", default=False, listed=False),
    ),
    rules=(
        RowRule(
            "cost_per_unit",
            lambda as_of, s: (F.col("cost_per_unit") != 0) & (F.col("cost_per_unit") > F.col("price")),
            "a unit costs more than its price",
            ("cost_per_unit", "price"),
        ),
    ),
    warnings=(
        RowRule("price", lambda as_of, s: F.col("price") > 100_000, "price is above one hundred thousand", ("price",)),
    ),
)

BLUEPRINTS: dict[str, Blueprint] = {b.name: b for b in (CUSTOMER_CHURN, REVENUE_PROJECTION, PRICE_OPTIMIZATION)}
ALIASES = {"revenue_forecast": "revenue_projection"}


def get_blueprint(name: str | Blueprint) -> Blueprint:
    if isinstance(name, Blueprint):
        return name
    name = ALIASES.get(name, name)
    if name not in BLUEPRINTS:
        raise KeyError(f"unknown blueprint: {name}")
    return BLUEPRINTS[name]


def register_blueprint(blueprint: Blueprint) -> None:
    BLUEPRINTS[blueprint.name] = blueprint
