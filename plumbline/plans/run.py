"""One blueprint run: validate, check the fit, preprocess and review, with a table of stage metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.blueprints import Blueprint, get_blueprint
from plumbline.operators.profile import compatibility
from plumbline.operators.quality import Rule, final_qa, quality_score, run_rules, verdict
from plumbline.operators.rows import error_summary, validate_rows
from plumbline.plans.preprocess import PreprocessConfig, preprocess

METRIC_SCHEMA = "stage string, status string, seconds double, detail string"


class BlueprintError(Exception):
    pass


@dataclass
class RunResult:
    table: DataFrame | None = None
    issues: DataFrame | None = None
    row_errors: DataFrame | None = None
    findings: DataFrame | None = None
    stages: list[tuple[str, str, float, str]] = field(default_factory=list)


def run_blueprint(
    df: DataFrame, blueprint: str | Blueprint, as_of: Column, config: PreprocessConfig | None = None, *,
    rules: list[Rule] | None = None, key: str | None = None, min_quality_score: float | None = None, store: bool = True,
) -> RunResult:
    """Stops on a critical issue, on a poor fit and, if asked for, on a low quality score."""
    blueprint = get_blueprint(blueprint)
    result = RunResult()

    def stage(name, work):
        start = time.monotonic()
        try:
            detail = work()
        except Exception as error:
            result.stages.append((name, "failed", time.monotonic() - start, str(error)))
            raise
        result.stages.append((name, "completed", time.monotonic() - start, detail))

    def validate() -> str:
        result.issues = run_rules(df, rules, key=key)
        result.row_errors = error_summary(validate_rows(df, blueprint, as_of))
        # The row errors count as one high issue per field, like every other rule.
        rows = result.row_errors.select(
            F.col("field").alias("column"), F.lit("schema_validation").alias("issue_type"), "severity",
            F.concat(F.lit("rows break the schema: "), F.col("messages")).alias("message"),
            F.col("failed_count").cast("bigint").alias("failed_count"), "total_count",
            (F.col("failed_count") / F.col("total_count")).alias("failure_rate"),
            F.array("messages").alias("examples"),
        )
        found = result.issues.unionByName(rows)
        # One row per failed check or field: small whatever the size of the table.
        result.issues = df.sparkSession.createDataFrame(found.collect(), found.schema)
        row = verdict(result.issues).crossJoin(quality_score(result.issues, df).select("quality_score")).first()
        if row["critical_issues"]:
            raise BlueprintError(f"{row['critical_issues']} critical issues")
        if min_quality_score is not None and row["quality_score"] < min_quality_score:
            raise BlueprintError(f"quality score {row['quality_score']} is below {min_quality_score}")
        return f"passed={row['passed']} issues={row['total_issues']} score={row['quality_score']}"

    def fit() -> str:
        row = compatibility(df, [blueprint]).first()
        if not row["compatible"]:
            raise BlueprintError(f"not compatible with {blueprint.name}: missing {row['required_missing']}; poor {row['quality_issues']}")
        return f"score={row['score']}"

    def clean() -> str:
        result.table, fitted = preprocess(df, blueprint.name, as_of, config, store=store)
        return f"columns={len(result.table.columns)} steps={len(fitted.report)}"

    def review() -> str:
        result.findings = final_qa(result.table)
        return f"findings={result.findings.count()}"

    for name, work in (("validation", validate), ("compatibility", fit), ("preprocessing", clean), ("final_qa", review)):
        stage(name, work)
    return result


def stage_table(df: DataFrame, result: RunResult) -> DataFrame:
    return df.sparkSession.createDataFrame(result.stages, METRIC_SCHEMA)
