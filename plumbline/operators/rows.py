"""Row-level validation: blueprint rules and flat JSON Schemas as column expressions.

Everything here is a projection over each row, so it runs the same on a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.blueprints import Blueprint, Field, NO_DEFAULT, get_blueprint
from plumbline.functions.scalars import parse_timestamp
from plumbline.operators.quality import HIGH, is_numeric

NOT_NULL = "Field may not be null."
MISSING = "Missing data for required field."


def _error(bad: Column, name: str, text: str) -> Column:
    return F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(text).alias("message")))


def _gather(errors: list[Column]) -> Column:
    kind = "array<struct<field:string,message:string>>"
    if not errors:
        return F.array().cast(kind)
    return F.filter(F.array(*errors), lambda e: e.isNotNull()).cast(kind)


def normalise_text(df: DataFrame, blueprint: str | Blueprint) -> DataFrame:
    """Trim identifiers, trim and lower-case categories, parse dates that arrive as text."""
    changes = {}
    for f in get_blueprint(blueprint).fields:
        if f.name not in df.columns or not isinstance(df.schema[f.name].dataType, T.StringType):
            continue
        if f.type in ("datetime", "date"):
            parsed = parse_timestamp(f.name)
            changes[f.name] = parsed if f.type == "datetime" else parsed.cast("date")
        elif f.type in ("string", "categorical"):
            text = F.trim(F.col(f.name))
            changes[f.name] = F.lower(text) if f.lower else text
    return df.withColumns(changes) if changes else df


def fill_defaults(df: DataFrame, blueprint: str | Blueprint, *, only_present: bool = False) -> DataFrame:
    """Give optional fields their default where they are missing; add absent optional columns."""
    changes = {}
    for f in get_blueprint(blueprint).fields:
        if f.required or f.default is NO_DEFAULT:
            continue
        if f.name in df.columns:
            if f.default is not None:
                changes[f.name] = F.coalesce(F.col(f.name), F.lit(f.default))
        elif not only_present:
            changes[f.name] = F.lit(f.default).cast(f.spark_type)
    return df.withColumns(changes) if changes else df


def _field_errors(df: DataFrame, f: Field, allowed: tuple[str, ...] | None) -> list[Column]:
    if f.name not in df.columns:
        return [_error(F.lit(True), f.name, MISSING)] if f.required else []
    value = F.col(f.name)
    errors = []
    if not f.nullable:
        errors.append(_error(value.isNull(), f.name, NOT_NULL))
    if f.minimum is not None:
        errors.append(_error(value < f.minimum, f.name, f"Must be greater than or equal to {f.minimum:g}."))
    if f.max_length is not None:
        length = F.char_length(value.cast("string"))
        low = f.min_length or 0
        errors.append(_error((length < low) | (length > f.max_length), f.name, f"Length must be between {low} and {f.max_length}."))
    if allowed:
        errors.append(_error(~value.isin(list(allowed)), f.name, f"Must be one of: {', '.join(allowed)}."))
    return errors


def validate_rows(
    df: DataFrame,
    blueprint: str | Blueprint,
    as_of: Column,
    *,
    max_age_days: int | None = None,
    allowed: dict[str, tuple[str, ...]] | None = None,
    normalise: bool = True,
    reject_unknown: bool = False,
) -> DataFrame:
    """Add ``errors`` and ``warnings``, arrays of (field, message).

    Field errors come first; only a row without them is checked against the rules over several fields,
    and the first broken rule is reported. ``max_age_days`` and ``allowed`` replace a blueprint's limits.
    """
    blueprint = get_blueprint(blueprint)
    settings = dict(blueprint.settings)
    if max_age_days is not None:
        settings["max_age_days"] = max_age_days
    if normalise:
        df = normalise_text(df, blueprint)
    fields = [e for f in blueprint.fields for e in _field_errors(df, f, (allowed or {}).get(f.name, f.allowed))]
    if reject_unknown:
        known = {f.name for f in blueprint.fields}
        fields += [_error(F.lit(True), c, "Unknown field.") for c in df.columns if c not in known]

    def active(rules):
        return [r for r in rules if all(n in df.columns for n in r.needs)]

    rules = _gather([_error(r.broken(as_of, settings), r.field, r.message) for r in active(blueprint.rules)])
    warnings = _gather([_error(r.broken(as_of, settings), r.field, r.message) for r in active(blueprint.warnings)])
    checked = df.withColumns({"_fields": _gather(fields), "_rules": rules, "_warnings": warnings})
    clean_row = F.size("_fields") == 0
    errors = F.when(clean_row, F.slice("_rules", 1, 1)).otherwise(F.col("_fields"))
    kept = F.when(clean_row & (F.size("_rules") == 0), F.col("_warnings")).otherwise(_gather([]))
    return checked.withColumns({"errors": errors, "warnings": kept}).drop("_fields", "_rules", "_warnings")


def error_summary(checked: DataFrame) -> DataFrame:
    """Per field: the error messages, how many were raised and the rows checked. All rows count."""
    raised = checked.select(F.explode("errors").alias("e")).groupBy("e.field", "e.message").agg(F.count("*").alias("n"))
    per_field = raised.groupBy("field").agg(
        F.sum("n").alias("failed_count"),
        F.array_join(F.sort_array(F.collect_list("message")), "; ").alias("messages"),  # few distinct messages
    )
    total = checked.agg(F.count("*").alias("total_count"))
    return per_field.crossJoin(F.broadcast(total)).withColumn("severity", F.lit(HIGH))


def validity(checked: DataFrame) -> DataFrame:
    """One row: valid, invalid and warned rows and the error rate in percent."""
    bad = F.size("errors") > 0
    totals = checked.agg(
        F.count("*").alias("total_records"),
        F.count_if(~bad).alias("valid_records"),
        F.count_if(bad).alias("invalid_records"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("warning_count"),
    )
    rate = F.coalesce(100 * F.col("invalid_records") / F.nullif(F.col("total_records"), F.lit(0)), F.lit(0.0))
    return totals.withColumn("error_rate_percentage", rate)


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All valid rows and all invalid rows."""
    return checked.filter(F.size("errors") == 0), checked.filter(F.size("errors") > 0)


def sample_rows(checked: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """Up to ``limit`` valid and ``limit`` invalid rows in key order, the report's samples."""
    valid, invalid = split_rows(checked)
    return (
        valid.orderBy(key).limit(limit).withColumn("is_valid", F.lit(True))
        .unionByName(invalid.orderBy(key).limit(limit).withColumn("is_valid", F.lit(False)))
    )


def correct_rows(df: DataFrame, blueprint: str | Blueprint) -> DataFrame:
    """Normalised text and defaults for missing optional fields, with the names of changed columns."""
    blueprint = get_blueprint(blueprint)
    before = {c: f"_before_{c}" for c in df.columns}
    kept = df.withColumns({b: F.col(c) for c, b in before.items()})
    fixed = fill_defaults(normalise_text(kept, blueprint), blueprint, only_present=True)
    changed = F.filter(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(b).cast(fixed.schema[c].dataType)), F.lit(c)) for c, b in before.items()]),
        lambda c: c.isNotNull(),
    )
    return fixed.withColumn("corrected_fields", changed).drop(*before.values())


def record_quality(df: DataFrame, blueprint: str | Blueprint, as_of: Column, key: str) -> DataFrame:
    """Per record: status, score and the missing, invalid and corrected fields.

    The score is the percentage of listed fields that are neither missing nor invalid after correction.
    """
    blueprint = get_blueprint(blueprint)
    listed = [f.name for f in blueprint.fields if f.listed and f.name in df.columns]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in listed]), lambda c: c.isNotNull())
    checked = validate_rows(correct_rows(df.withColumn("missing_fields", missing), blueprint), blueprint, as_of, normalise=False)
    invalid = F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["field"])))
    status = F.when(F.size("errors") > 0, "invalid").when(F.size("warnings") > 0, "warning").otherwise("valid")
    return checked.select(
        F.col(key),
        status.alias("validation_status"),
        F.round(100 * (1 - F.size(invalid) / F.lit(len(listed))), 2).alias("data_quality_score"),
        "missing_fields",
        invalid.alias("invalid_fields"),
        "corrected_fields",
        F.transform("warnings", lambda w: w["message"]).alias("warnings"),
    )


def _type_error(df: DataFrame, name: str, types: list[str]) -> Column | None:
    """A condition for values of the wrong type, or None where the column's type rules errors out."""
    actual = df.schema[name].dataType
    value = F.col(name)
    accepted = False
    for kind in types:
        if kind == "string" and isinstance(actual, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            accepted = True
        elif kind == "number" and is_numeric(actual):
            accepted = True
        elif kind == "integer" and isinstance(actual, T.IntegralType):
            accepted = True
        elif kind == "integer" and is_numeric(actual):
            return value.isNotNull() & (value != F.floor(value))
        elif kind == "boolean" and isinstance(actual, T.BooleanType):
            accepted = True
    return None if accepted else value.isNotNull()


def json_schema_errors(df: DataFrame, schema: dict) -> Column:
    """Errors of a flat JSON Schema as one array column. NULL counts as an absent property."""
    errors: list[Column] = []
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        bad = F.col(name).isNull() if name in df.columns else F.lit(True)
        errors.append(_error(bad, name, "is a required property"))
    for name, spec in properties.items():
        if name not in df.columns:
            continue
        value, data_type = F.col(name), df.schema[name].dataType
        if "type" in spec:
            types = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
            bad = _type_error(df, name, types)
            if bad is not None:
                errors.append(_error(bad, name, f"is not of type {', '.join(types)}"))
        if is_numeric(data_type):
            for keyword, test in (
                ("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x),
                ("exclusiveMinimum", lambda v, x: v <= x), ("exclusiveMaximum", lambda v, x: v >= x),
            ):
                if keyword in spec:
                    errors.append(_error(test(value, spec[keyword]), name, f"breaks {keyword} {spec[keyword]:g}"))
        if isinstance(data_type, T.StringType):
            if "minLength" in spec:
                errors.append(_error(F.char_length(value) < spec["minLength"], name, f"breaks minLength {spec['minLength']}"))
            if "maxLength" in spec:
                errors.append(_error(F.char_length(value) > spec["maxLength"], name, f"breaks maxLength {spec['maxLength']}"))
            if "pattern" in spec:
                errors.append(_error(~value.rlike(spec["pattern"]), name, "does not match the pattern"))
        if "enum" in spec:
            options = [F.lit(v) for v in spec["enum"] if v is not None]
            same = [v for v in spec["enum"] if isinstance(v, str) == isinstance(data_type, T.StringType)]
            errors.append(_error(~value.isin(same) if same else value.isNotNull() & F.lit(bool(options)), name, "is not one of the allowed values"))
    if schema.get("additionalProperties") is False:
        errors += [_error(F.lit(True), c, "additional property") for c in df.columns if c not in properties]
    return _gather(errors)


def validate_json_schema(df: DataFrame, schema: dict) -> DataFrame:
    return df.withColumn("errors", json_schema_errors(df, schema)).withColumn("warnings", _gather([]))
