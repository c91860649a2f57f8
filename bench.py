"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators.models import score, train_classifier  # noqa: E402
from plumbline.operators.quality import default_rules, final_qa, numeric_columns, run_rules  # noqa: E402
from plumbline.plans.preprocess import PreprocessConfig, preprocess  # noqa: E402
from plumbline.queries import QUERIES  # noqa: E402
from plumbline.session import build_session, materialise, scratch_path  # noqa: E402
from plumbline.sources.files import read_csv  # noqa: E402
from plumbline.sources.tables import as_of_column, table  # noqa: E402

HEADLINE = [
    "churn_features", "revenue_features", "price_features", "quality_report", "quality_column_summary", "quality_drift",
    "rows_churn", "rows_error_summary", "profile_columns", "profile_correlations", "compatibility_scores",
    "impute_auto", "cap_iqr", "encode_label", "encode_one_hot", "scale_robust", "preprocess_churn", "rank_percentile",
    "rank_tier4", "session_durations", "customer_metrics", "latency_summary", "error_summary", "classification_metrics",
    "price_response", "revenue_forecast", "scan_csv", "content_hash", "stream_daily_users", "stream_order_totals",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    noop(table(spark, sf_dir, "orders").groupBy("o_orderstatus").count())  # start the executors

    seconds = {name: timed(lambda q=QUERIES[name]: noop(q(spark, sf_dir))) for name in HEADLINE}

    # Rates over a CSV file of all line items, in MB of that file per second.
    path = scratch_path(spark, "bench")
    lines = table(spark, sf_dir, "lineitem")
    lines.write.option("header", True).csv(path)
    size = sum(
        os.path.getsize(os.path.join(folder, f)) for folder, _, names in os.walk(path) for f in names if f.endswith(".csv")
    ) / 1e6
    read = read_csv(spark, path, schema=lines.schema, delimiter=",", encoding="UTF-8")
    stored = materialise(read, "lines")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]

    def clean_lines():
        config = PreprocessConfig()
        from plumbline.blueprints import Blueprint, register_blueprint

        register_blueprint(Blueprint("line_items", ()))
        noop(preprocess(stored, "line_items", as_of_column(), config, keys=keys)[0])

    rates = {
        "ingestion_mb_per_sec": size / timed(lambda: noop(read)),
        "ingestion_inferred_mb_per_sec": size / timed(lambda: noop(read_csv(spark, path))),
        "validation_mb_per_sec": size / timed(lambda: noop(run_rules(stored, default_rules(), key="l_orderkey"))),
        "preprocessing_mb_per_sec": size / timed(clean_lines),
        "final_qa_mb_per_sec": size / timed(lambda: noop(final_qa(stored))),
    }

    # Seconds to train on 10,000 rows and to score 1,000, with eight number columns.
    numbers = [c for c in numeric_columns(stored) if c not in keys]
    sample = materialise(stored.orderBy("l_orderkey", "l_linenumber").limit(10_000).select(*numbers, (F.col("l_returnflag") == "R").cast("double").alias("y")), "sample")
    models = []
    rates["train_10000_sec"] = timed(lambda: models.append(train_classifier(sample, numbers, "y", "random_forest")))
    rates["score_1000_sec"] = timed(lambda: noop(score(models[0], sample.limit(1_000))))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "rates": {k: round(v, 1) for k, v in rates.items()}, "csv_mb": round(size, 1), "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
