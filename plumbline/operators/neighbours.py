"""Filling missing numbers from the nearest rows, exactly and without comparing every pair.

The distance of two rows is Euclidean over the columns that both have, times the share of columns that is (so that rows with
more in common are not farther for it). Rows that lend values are put into cells of about ``CELL`` rows: those that have the same
columns are cut at medians of a sample, again and again, the widest column first. A cell keeps the least and greatest value of
each column. Whatever columns a row has, its distance to a cell's box is a lower bound of its distance to the cell's rows. A row
that needs values first visits the cell of the smallest bound that has enough rows; its k-th distance there limits the cells
that it visits then.

Rows alike ask once, and of rows alike only the first lend, since no others can be among the nearest. Cells that became too
large are cut into cells of the same box, and rows that visit a cell travel in blocks of ``BLOCK``, so no task depends on how
many rows are near each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quality import clean
from plumbline.session import materialise

PIVOTS = 16  # rows in the sample for each cell, on average
CELL = 1_024
CELLS = 4_096  # about as many cells at most, beyond those of rare sets of columns
BLOCK = 1_024
SALTS = 64
AT_ONCE = 1_000_000  # bounds computed at once
VISIT = "cell int, ask string, v array<double>, targets int, reach double"
NEAR = "ask string, target int, distance double, donor string, value double"


def _matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Squared distances of rows ``x`` to rows ``y``, of which all have the same columns; infinite without common ones."""
    total, common = np.zeros((len(x), len(y))), np.zeros((len(x), 1))
    for c in range(width):
        if len(y) and not np.isnan(y[0, c]):
            has = ~np.isnan(x[:, c])
            total[has] += (x[has, c, None] - y[None, :, c]) ** 2
            common[has] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total * width / common, np.inf)


class _Cuts:
    """For each set of columns a tree of cuts. ``node`` has the column, the value and the two next nodes; a leaf has column -1 and its cell."""

    def __init__(self) -> None:
        self.column: list[int] = []
        self.value: list[float] = []
        self.next: list[tuple[int, int]] = []
        self.roots: dict[int, int] = {}
        self.cells = 0

    def grow(self, sample: np.ndarray, rows: float, size: int) -> int:
        """The number of the top node for about ``rows`` rows, of which ``sample`` are some."""
        at = len(self.column)
        self.column.append(-1)
        self.value.append(0.0)
        self.next.append((self.cells, self.cells))
        if rows > size and len(sample) > 1:
            wide = np.nan_to_num(sample.max(axis=0) - sample.min(axis=0))
            column = int(wide.argmax())
            values = np.unique(sample[:, column])
            if len(values) > 1:
                middle = np.median(sample[:, column])
                cut = values[max(1, np.searchsorted(values, middle))]
                low = sample[:, column] < cut
                share = low.mean()
                self.column[at], self.value[at] = column, float(cut)
                left = self.grow(sample[low], rows * share, size)
                self.next[at] = left, self.grow(sample[~low], rows * (1 - share), size)
                return at
        self.cells += 1
        return at

    def cells_of(self, v: np.ndarray, masks: np.ndarray) -> np.ndarray:
        column, value, following = np.array(self.column), np.array(self.value), np.array(self.next).reshape(-1, 2)
        node = np.array([self.roots[m] for m in masks.tolist()], np.int64)
        inner = np.flatnonzero(column[node] >= 0)
        while len(inner):
            here = node[inner]
            node[inner] = following[here, (v[inner, column[here]] >= value[here]).astype(int)]
            inner = inner[column[node[inner]] >= 0]
        return following[node, 0]


def _lists(batch: pa.RecordBatch, column: int, i: int) -> pa.Array:
    return batch.column(column)[i].values


def nearest_fill(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """``df`` with the missing values of number ``columns`` filled by the mean of the ``k`` nearest rows that have them.

    Equal distances go by key, as text. A row without a near one (no column in common with any) gets the column's mean, and a
    column without values stays missing. ``key`` must tell rows apart; a NaN counts as missing.
    """
    columns, width = list(columns), len(columns)
    if not width:
        return df
    keyed = F.col(key).cast("string")
    numbers = [clean(df, c).cast("double") for c in columns]
    mask = sum((F.when(n.isNotNull(), F.lit(1 << c)).otherwise(0) for c, n in enumerate(numbers)), F.lit(0)).cast("int")
    # Missing is NaN from here on. Rows that have the same values have the same text.
    v = F.array(*[F.coalesce(n, F.lit(float("nan"))) for n in numbers])
    rows = df.select(keyed.alias("key"), v.alias("v"), mask.alias("mask")).withColumn("ask", F.array_join(F.col("v").cast("array<string>"), ","))
    rows = materialise(rows, "numbers")
    has_value = [F.when(F.col("mask").bitwiseAND(F.lit(1 << c)) > 0, F.col("v")[c]) for c in range(width)]
    means = rows.agg(*[F.avg(x).alias(f"m{c}") for c, x in enumerate(has_value)]).first()
    few = k + 1  # one may be the row itself

    first = Window.partitionBy("ask", "salt").orderBy("key"), Window.partitionBy("ask").orderBy("key")
    alike = rows.where("mask > 0").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    for window in first:
        alike = alike.withColumn("r", F.row_number().over(window)).where(F.col("r") <= few)
    lend = materialise(alike.select("key", "v", "mask"), "lend")
    # One row for each set of columns that occurs.
    occur = {r["mask"]: r["count"] for r in lend.groupBy("mask").count().collect()}
    size = max(CELL, -(-sum(occur.values()) // CELLS))
    drawn = F.pmod(F.xxhash64("key", "v"), F.lit(1_000_000)) < min(1.0, PIVOTS / size) * 1e6
    sample = lend.where(drawn & F.col("mask").isin([m for m, n in occur.items() if n > size])).select("mask", "v").toArrow().combine_chunks()
    sampled = sample["mask"].to_numpy()
    points = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(sample) else np.zeros((0, width))
    cuts = _Cuts()
    for m, n in sorted(occur.items()):
        cuts.roots[m] = cuts.grow(points[sampled == m], n, size)

    def place(batches):
        for batch in batches:
            cell = cuts.cells_of(_matrix(batch, 1, width), batch.column(2).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["key", "v", "mask", "cell"])

    placed = materialise(lend.mapInArrow(place, "key string, v array<double>, mask int, cell int"), "placed")
    sizes = placed.groupBy("cell", "mask").agg(
        F.count("*").alias("n"), *[F.min(F.col("v")[c]).alias(f"x{c}") for c in range(width)], *[F.max(F.col("v")[c]).alias(f"y{c}") for c in range(width)]
    )
    boxes = sizes.collect()
    low, high = (np.array([[b[f"{s}{c}"] for c in range(width)] for b in boxes], np.float64).reshape(-1, width) for s in "xy")
    counts, number = np.array([b["n"] for b in boxes]), np.array([b["cell"] for b in boxes], np.int32)
    has = ~np.isnan(low)

    parts = df.sparkSession.createDataFrame([(b["cell"], -(-b["n"] // (2 * size))) for b in boxes], "cell int, parts long")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")
    cells = placed.join(F.broadcast(parts), "cell").groupBy("cell", part).agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("d"))
    cells = materialise(cells.select("cell", F.col("d.key").alias("donors"), F.flatten("d.v").alias("lent")), "cells")

    def bounds(v: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distance of each row to each cell's rows."""
        total, common = np.zeros((len(v), len(boxes))), np.zeros((len(v), len(boxes)))
        for c in range(width):
            both = ~np.isnan(v[:, c])[:, None] & has[None, :, c]
            gap = np.maximum(0, np.maximum(low[None, :, c] - v[:, c, None], v[:, c, None] - high[None, :, c]))
            total += np.where(both, gap**2, 0.0)
            common += both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(common > 0, total * width / common, np.inf) * (1 - 1e-12)

    def visits(limited: bool):
        """Rows (cell, ask, v, targets, reach) to visit: the best cell with enough rows, or all cells within the limits."""

        def run(batches):
            step = max(1, AT_ONCE // max(1, len(boxes)))
            for whole in batches:
                for start in range(0, whole.num_rows if boxes else 0, step):
                    batch = whole.slice(start, step)
                    v = _matrix(batch, 1, width)
                    limits = _matrix(batch, 2, width) if limited else np.full((len(v), width), np.inf)
                    least = bounds(v)
                    targets, reach = np.zeros(least.shape, np.int64), np.full(least.shape, -np.inf)
                    for t in range(width):
                        fit = has[None, :, t] & np.isnan(v[:, t])[:, None] & np.isfinite(least)
                        if limited:
                            fit &= least <= limits[:, t, None]
                        else:
                            enough = np.where(fit & (counts >= few)[None], least, np.inf)
                            best = enough.argmin(axis=1)
                            fit = (np.arange(len(boxes))[None] == best[:, None]) & np.isfinite(enough)
                        targets += fit.astype(np.int64) << t
                        reach = np.where(fit, np.maximum(reach, limits[:, t, None]), reach)
                    i, at = np.nonzero(targets)
                    if len(i):
                        offsets = pa.array(np.arange(len(i) + 1, dtype=np.int32) * width)
                        own = pa.ListArray.from_arrays(offsets, pa.array(v[i].ravel()))
                        asks = batch.column(0).take(pa.array(i)).cast(pa.string())
                        arrays = [pa.array(number[at]), asks, own, pa.array(targets[i, at].astype(np.int32)), pa.array(reach[i, at])]
                        yield pa.RecordBatch.from_arrays(arrays, ["cell", "ask", "v", "targets", "reach"])

        return run

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                donors, y = _lists(batch, 0, i), _lists(batch, 1, i).to_numpy(zero_copy_only=False).reshape(-1, width)
                asks, x = _lists(batch, 2, i).to_pylist(), _lists(batch, 3, i).to_numpy(zero_copy_only=False).reshape(-1, width)
                targets, reach = _lists(batch, 4, i).to_numpy(), _lists(batch, 5, i).to_numpy()
                d = _distances(x, y, width)
                last = np.partition(d, few - 1, axis=1)[:, few - 1] if len(y) > few else np.full(len(x), np.inf)
                last = np.minimum(last, reach)
                out = ([], [], [], [], [])
                for a in range(len(asks)):
                    close = np.flatnonzero(d[a] <= last[a])
                    close = close[np.argsort(d[a, close], kind="stable")[:few]]
                    close = close[np.isfinite(d[a, close])]
                    for t in range(width) if len(close) else ():
                        if targets[a] >> t & 1:
                            for values, more in zip(out, ([asks[a]] * len(close), [t] * len(close), d[a, close], close, y[close, t])):
                                values.extend(more)
                if out[0]:
                    arrays = [pa.array(out[0]), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64()), donors.take(pa.array(out[3], pa.int64())).cast(pa.string()), pa.array(out[4], pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["ask", "target", "distance", "donor", "value"])

    def found(asking: DataFrame) -> DataFrame:
        asking = materialise(asking, "asking")
        blocks = asking.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # at most one row for each cell
        block = F.pmod(F.xxhash64("ask"), F.col("blocks")).alias("block")
        asked = asking.join(F.broadcast(blocks), "cell").groupBy("cell", block).agg(F.collect_list(F.struct("ask", "v", "targets", "reach")).alias("a"))
        asked = asked.select("cell", F.col("a.ask").alias("asks"), F.flatten("a.v").alias("own"), F.col("a.targets").alias("targets"), F.col("a.reach").alias("reach"))
        best = asked.join(cells, "cell").select("donors", "lent", "asks", "own", "targets", "reach").mapInArrow(compare, NEAR)
        order = Window.partitionBy("ask", "target").orderBy("distance", "donor")
        return materialise(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= few).drop("r"), "near")

    needy = rows.where((F.col("mask") < (1 << width) - 1) & (F.col("mask") > 0)).where("key IS NOT NULL")
    asking = materialise(needy.select("ask", "v").dropDuplicates(["ask"]), "asks")
    near = found(asking.mapInArrow(visits(False), VISIT))
    reached = [F.when(F.count_if(F.col("target") == c) == few, F.max(F.when(F.col("target") == c, F.col("distance")))) for c in range(width)]
    limits = near.groupBy("ask").agg(F.array(*[F.coalesce(x, F.lit(float("inf"))) for x in reached]).alias("limits"))
    unlimited = F.array(*[F.lit(float("inf"))] * width)
    limited = asking.join(limits, "ask", "left").select("ask", "v", F.coalesce("limits", unlimited).alias("limits"))
    near = found(limited.mapInArrow(visits(True), VISIT))

    # A row's own values, if its key repeats, are no neighbours.
    own = needy.select("key", "ask").join(near, "ask").where("donor IS NULL OR donor <> key")
    order = Window.partitionBy("key", "target").orderBy("distance", "donor")
    nearest = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    values = nearest.groupBy("key").pivot("target", list(range(width))).agg(F.avg("value"))
    values = values.select(F.col("key").alias("__key"), *[F.col(str(c)).alias(f"__{c}") for c in range(width)])
    joined = df.withColumn("__key", keyed).join(values, "__key", "left")
    filled = {c: F.coalesce(clean(df, c).cast("double"), F.col(f"__{i}"), F.lit(means[i])) for i, c in enumerate(columns)}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
