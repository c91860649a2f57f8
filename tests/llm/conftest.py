"""Frames for the text operators' tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import EDGES, SMALL  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents of odd texts, with columns named like results."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", True, 0.5) for i, t in enumerate(EDGES)]
    rows += [rows[3], (None, "no id", None, None, 0, 1, "x", True, 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, lang_pred string, kept boolean, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
