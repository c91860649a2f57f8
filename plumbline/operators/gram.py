"""Correlations of many columns from one block-wise Gram matrix.

One aggregate for every pair of columns does not compile for a thousand columns. Here a task multiplies blocks of its rows
instead: with X the values (zero where missing, shifted near their means) and M the marks of presence, ``M'M``, ``X'M``,
``(X*X)'M`` and ``X'X`` hold for every pair of columns the count and the sums over rows where both are present. Each task
hands on one row for each column, and these are added up by column, so no task holds more than a few rows of the matrix at
the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quality import clean

ROWS = 4_096  # rows that are multiplied at once


def gram_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a``, ``column_b``, ``correlation`` (Pearson, over rows where both are present) and ``n_rows`` of every pair.

    A pair without two rows, or with a column that does not vary over them, has no correlation.
    """
    columns, k = list(columns), len(columns)
    values = df.select(F.array(*[clean(df, c).cast("double") for c in columns]).alias("v"))
    # Any shift is right; one near the means keeps digits.
    some = [row["v"] for row in values.limit(200).collect()]
    shift = np.zeros(k)
    for i in range(k):
        present = [v[i] for v in some if v[i] is not None and np.isfinite(v[i])]
        shift[i] = np.mean(present) if present else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.column(0).slice(at, ROWS)
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k) - shift
                m = (~np.isnan(x)).astype(np.float64)
                x = np.where(m > 0, x, 0.0)
                sums += np.stack((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([sums[:, i].tobytes() for i in range(k)], pa.binary())], ["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros((4, k))
        for batch in batches:
            number = batch.column(0)[0].as_py() if batch.num_rows else number
            for value in batch.column(1):
                total += np.frombuffer(value.as_buffer()).reshape(4, k)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "sums"])

    rows = values.mapInArrow(run, "i int, sums binary").groupBy("i").applyInArrow(add, "i int, sums binary")

    # Column j's sums over the rows shared with i stand in row j, so the rows meet in pairs (i, j).
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, s, q, p = np.frombuffer(value.as_buffer()).reshape(4, k)
                j = np.arange(k)
                first = j > i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (np.minimum(i, j)[j != i].astype(np.int32), np.maximum(i, j)[j != i].astype(np.int32), first[j != i], n[j != i], s[j != i], q[j != i], p[j != i])],
                    ["a", "b", "first", "n", "s", "q", "p"],
                )

    halves = rows.mapInArrow(spread, "a int, b int, first boolean, n double, s double, q double, p double")

    def one(column: str, first: bool):
        return F.max(F.when(F.col("first") if first else ~F.col("first"), F.col(column)))

    pairs = halves.groupBy("a", "b").agg(
        F.max("n").alias("n"), F.max("p").alias("p"), one("s", True).alias("sx"), one("s", False).alias("sy"), one("q", True).alias("qx"), one("q", False).alias("qy")
    )
    vx, vy = (F.col("n") * F.col(q) - F.col(s) * F.col(s) for q, s in (("qx", "sx"), ("qy", "sy")))
    small = 1e-12  # what is left of a constant by rounding
    varies = (F.col("n") > 1) & (vx > small * F.col("n") * F.col("qx")) & (vy > small * F.col("n") * F.col("qy"))
    r = (F.col("n") * F.col("p") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(
        F.element_at(names, F.col("a") + 1).alias("column_a"), F.element_at(names, F.col("b") + 1).alias("column_b"),
        F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("correlation"), F.col("n").cast("long").alias("n_rows"),
    )
