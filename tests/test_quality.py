"""Rules, row validation and JSON Schemas on the small frames of the usual cases."""

import pytest
from pyspark.sql import functions as F

from plumbline.blueprints import BLUEPRINTS, CUSTOMER_CHURN, Blueprint, Field, get_blueprint, register_blueprint
from plumbline.operators import quality as Q
from plumbline.operators import rows as R
from plumbline.operators.profile import compatibility, schema_compatibility
from plumbline.sources.tables import as_of_column


def issues(df, rules, key=None):
    return {(r["column"], r.issue_type): r for r in Q.run_rules(df, rules, key=key).collect()}


def test_outlier(spark):
    parts = spark.range(40).select((F.col("id") % 7).alias("size"), F.when(F.col("id") < 2, -500).otherwise(F.col("id") % 5).alias("stock"))
    found = issues(parts, [Q.Anomaly("iqr", 1.5)])
    assert set(found) == {("stock", "statistical_anomaly")}
    assert found["stock", "statistical_anomaly"].failed_count == 2


def test_few_values_are_no_anomaly(spark):
    assert issues(spark.createDataFrame([(i,) for i in [1] * 8 + [99]], "v long"), [Q.Anomaly("iqr")]) == {}


def test_uniqueness_counts_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "v long")
    assert issues(df, [Q.Uniqueness()])["v", "uniqueness"].failed_count == 2


def test_range_and_examples(spark):
    df = spark.createDataFrame([(10, 0.04, 3), (11, 0.11, 52), (12, -0.2, 50), (13, 0.0, None)], "line long, discount double, quantity long")
    found = issues(df, [Q.Range({"discount": (0, 0.1), "quantity": (1, 50)})], key="line")
    assert found["discount", "range"].failed_count == 2 and found["discount", "range"].examples == ["0.11", "-0.2"]
    assert found["quantity", "range"].examples == ["52"]


def test_examples_are_at_most_five_in_key_order(spark):
    df = spark.range(1000).select("id", F.lit("bad").alias("email"))
    row = issues(df, [Q.Pattern({"email": Q.EMAIL_PATTERN})], key="id")["email", "pattern"]
    assert row.failed_count == 1000 and row.examples == ["bad"] * 5


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("abc1",), ("xabc",), (None,)], "v string")
    row = issues(df, [Q.Pattern({"v": "abc"})])["v", "pattern"]
    assert (row.failed_count, row.total_count) == (1, 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    found = issues(empty, [*Q.default_rules(), Q.Uniqueness()])
    assert {k for k, _ in found} == {"a", "b"} and all(t == "completeness" for _, t in found)
    assert Q.quality_score(Q.run_rules(empty), empty).first().quality_score == 100.0
    assert {r.finding for r in Q.final_qa(empty).collect()} == {"empty_dataset", "all_missing"}


def test_score_and_verdict(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 10, None).otherwise(1).alias("v"))
    found = Q.run_rules(df, [Q.Completeness()])
    assert Q.quality_score(found, df).first().quality_score == 50.0  # 5 * 10 / 100 off 100
    assert Q.verdict(found).first().passed
    assert Q.quality_score(Q.run_rules(df, [Q.Uniqueness(["id"])]), df).first().quality_score == 100.0


def test_custom_and_type_rules(spark):
    df = spark.createDataFrame([(1, "a")], "a long, b string")
    found = issues(df, [Q.DataTypes({"a": "string", "b": "string"}), Q.Custom(lambda d: [Q.Check("b", "mine", Q.CRITICAL, failed=F.count_if(F.col("b") == "a"))])])
    assert set(found) == {("a", "data_type"), ("b", "mine")}


# Orders of the star schema, as a flat JSON Schema.
SCHEMA = {
    "type": "object",
    "properties": {
        "clerk": {"type": "string", "pattern": "^Clerk#[0-9]+$"}, "priority": {"type": "integer", "minimum": 1, "maximum": 5},
        "price": {"type": "number", "minimum": 0}, "status": {"type": "string", "enum": ["F", "O", "P"]},
    },
    "required": ["clerk", "price", "status"], "additionalProperties": False,
}
ORDER = "clerk string, priority long, price double, status string"


def schema_errors(df):
    return {(e.field, e.message.split(" ")[0]) for r in R.validate_json_schema(df, SCHEMA).collect() for e in r.errors}


def test_json_schema(spark):
    assert schema_errors(spark.createDataFrame([("Clerk#7", 5, 0.0, "P"), ("Clerk#19", 1, 3.5, "F")], ORDER)) == set()
    wrong = spark.createDataFrame([("clerk 7", 0, -0.01, "X")], ORDER)
    assert {f for f, _ in schema_errors(wrong)} == {"clerk", "priority", "price", "status"}
    assert ("price", "is") in schema_errors(wrong.withColumn("price", F.col("status")))
    assert ("status", "is") in schema_errors(wrong.drop("status"))
    assert ("comment", "additional") in schema_errors(wrong.withColumn("comment", F.lit("x")))
    half = spark.createDataFrame([("Clerk#7", 2.5, 1.0, "O")], ORDER.replace("priority long", "priority double"))
    assert schema_errors(half) == {("priority", "is")}


def test_field_errors_hide_rule_errors_and_unknown_fields(spark):
    df = spark.sql("SELECT 'a' AS customer_id, timestamp'2001-01-01' AS last_activity_date, timestamp'2001-02-01' AS account_created_date, -1D AS total_value, 1 AS zip")
    errors = [e.field for e in R.validate_rows(df, "customer_churn", as_of_column()).first().errors]
    assert errors == ["total_value"]
    good = df.withColumn("total_value", F.lit(2.0))
    assert [e.field for e in R.validate_rows(good, "customer_churn", as_of_column()).first().errors] == ["account_created_date"]
    assert [e.field for e in R.validate_rows(good, "customer_churn", as_of_column(), reject_unknown=True).first().errors] == ["zip"]
    missing = good.drop("customer_id")
    assert R.validate_rows(missing, "customer_churn", as_of_column()).first().errors[0].message == R.MISSING


def test_blueprints(monkeypatch):
    assert get_blueprint("revenue_forecast").name == "revenue_projection"
    assert CUSTOMER_CHURN.json_schema()["required"] == CUSTOMER_CHURN.required
    assert [f.name for f in CUSTOMER_CHURN.struct_type()] == CUSTOMER_CHURN.required + CUSTOMER_CHURN.optional
    monkeypatch.setattr("plumbline.blueprints.BLUEPRINTS", dict(BLUEPRINTS))
    register_blueprint(Blueprint("own", (Field("a", "integer", required=True),)))
    assert schema_compatibility(["a"], "own")["score"] == 1.0
    with pytest.raises(KeyError):
        get_blueprint("none")


def test_compatibility_counts_poor_columns(spark):
    df = spark.range(10).select(*[F.when(F.col("id") < 7, F.col("id")).alias(c) for c in CUSTOMER_CHURN.required])
    row = compatibility(df, ["customer_churn"]).first()
    assert not row.compatible and row.score == 0.4


def test_drift_of_equal_tables_is_zero(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert abs(Q.drift(df, df, "v").agg(F.sum("psi")).first()[0]) < 1e-12


def test_distinct_counts_do_not_expand_rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("t"), F.lit(None).cast("string").alias("e"))
    assert tuple(Q.distinct_counts(df, df.columns).first()) == (300, 7, 1, 0)
    for frame in (Q.run_rules(df, [Q.Uniqueness()]), Q.column_summary(df, Q.run_rules(df, [Q.Completeness()])), Q.final_qa(df)):
        assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()


def test_uniqueness_examples(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([5, 5, 1, 2, 2, 2, None, None])], "k long, v long")
    found = issues(df, [Q.Uniqueness(["v", "k"])], key="k")
    assert found["v", "uniqueness"].examples == ["2", "5"] and found["v", "uniqueness"].failed_count == 4
    assert ("k", "uniqueness") not in found


def test_many_columns(spark):
    df = spark.range(20).select("id", *[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    assert Q.column_summary(df, Q.run_rules(df, [Q.Completeness()])).count() == 61
