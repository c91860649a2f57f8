"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: the blanks that separate words in every operator of this folder.
BLANKS = r"[\x20\x09-\x0D]+"


def narrow(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Only the columns an operator reads, so that further columns of the input can't clash with its results."""
    return df.select(*columns)


def per_batch(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, object]]
) -> DataFrame:
    """Apply ``work`` to each Arrow batch. It gets the batch and returns the result's columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch), schema=arrow)

    arrow = arrow_schema(df, schema)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, wanted: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which ``wanted`` says so, with all their columns. Each row is judged where it is read: nothing is joined.

    Batches have the columns by number (``c0``, ``c1``, ...), so names may hold any sign.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(wanted(batch), pa.bool_()))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def texts(batch: pa.RecordBatch, column: str | int) -> Iterator[str]:
    """The texts of a batch one by one, null as the empty text."""
    values = batch.column(column)
    for i in range(len(values)):
        yield values[i].as_py() or ""


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
