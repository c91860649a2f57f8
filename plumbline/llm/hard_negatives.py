"""Hard-negative mining by segment summaries.

A vector is cut into segments, and of each segment only the mean and the deviation are kept. With m components in a segment,
means p, q and deviations s, t, the segment's part of an inner product lies within ``m p q - m s t`` and ``m p q + m s t``
(Cauchy-Schwarz on what is left after the means). Summed over the segments this bounds the score of a pair. ``LEVELS`` are
the numbers of segments: each level halves segments further, is computed only for the pairs the level before let pass, and
exact scores only for the pairs that passed all. As summaries are short vectors, a level is two small matrix products.

Anchors are a stated query set. They are taken in blocks of at most ``ANCHOR_BYTES``, one broadcast and one scan of all rows
for a block; a task keeps the best few rows of each anchor, whose last score raises the bound to pass, and the tasks' rows
are ranked by Spark. Two scans: the best same-label rows (positives), then for each of these the best different-label rows
whose score lies within two percentages of the positive's score.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. A shorter vector is
filled up with zeros. Every row is a row of its own, also one that repeats an id, but no row of the anchor's own id is a
positive or negative; anchors that repeat in id, label and vector count once. Ties go to the smaller id. Scores beyond a long
are set to its ends. An anchor without positives, and a positive without negatives, has no row; an empty table gives an
empty table. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema, narrow
from plumbline.session import materialise

LEVELS = (1, 4, 16)
ANCHOR_BYTES = 32_000_000
TILE = 2_048  # rows that are compared at once
TILE_ANCHORS = 1_024
EXACT = 2.0**53  # sums of products below it are exact in floating point
LARGEST = 2**63 - 1


class Vectors:
    """Vectors of whole numbers and the summaries of their segments."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.labels, self.matrix = ids, labels, matrix
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.sqrt((matrix**2).sum(axis=1))
            self.levels = [self.summary(min(n, matrix.shape[1])) for n in LEVELS]

    def summary(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations, each times the root of the segment's length."""
        edges = np.linspace(0, self.matrix.shape[1], segments + 1).astype(int)
        parts = [self.matrix[:, x:y] for x, y in zip(edges[:-1], edges[1:])]
        root = np.sqrt(np.diff(edges))
        return np.stack([p.mean(axis=1) for p in parts], axis=1) * root, np.stack([p.std(axis=1) for p in parts], axis=1) * root

    def only(self, rows: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.matrix, out.norms = self.ids[rows], self.labels[rows], self.matrix[rows], self.norms[rows]
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def matrix_of(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dims))
    inside = np.arange(dims)[None, :] < lengths[:, None]
    out[inside] = values
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def scored(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs ``i``, ``j``."""
    if not len(i):
        return np.empty(0, np.int64)
    if a.norms.max() * b.norms.max() < EXACT:
        return np.einsum("ij,ij->i", a.matrix[i], b.matrix[j]).astype(np.int64)
    whole = [[[int(v) for v in row] for row in m] for m in (a.matrix, b.matrix)]
    return np.array([max(-LARGEST - 1, min(LARGEST, sum(x * y for x, y in zip(whole[0][p], whole[1][q])))) for p, q in zip(i, j)], np.int64)


def between(a: Vectors, b: Vectors, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs in ``mask``, those with a score from ``low`` to ``high`` of the anchor: numbers in ``a`` and ``b``, score."""
    if not a.norms.max(initial=0) * b.norms.max(initial=0) < EXACT:
        i, j = np.nonzero(mask)
    else:
        rows, columns, i = np.arange(len(a.ids)), np.arange(len(b.ids)), None
        for (m, d), (n, e) in zip(a.levels, b.levels):
            if i is None:  # many pairs are left: whole matrices
                middle, reach = m[rows] @ n[columns].T, d[rows] @ e[columns].T
                reach += 0.5 + 1e-9 * a.norms[rows, None] * b.norms[None, columns]  # for rounding
                mask &= (middle + reach >= low[rows, None]) & (middle - reach <= high[rows, None])
                x, y = mask.any(axis=1), mask.any(axis=0)
                rows, columns, mask = rows[x], columns[y], mask[np.ix_(x, y)]
                if mask.sum() * 8 < mask.size:
                    i, j = np.nonzero(mask)
                    i, j = rows[i], columns[j]
            else:
                middle, reach = np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", d[i], e[j]) + 0.5 + 1e-9 * a.norms[i] * b.norms[j]
                keep = (middle + reach >= low[i]) & (middle - reach <= high[i])
                i, j = i[keep], j[keep]
        if i is None:
            scores = a.matrix[rows] @ b.matrix[columns].T
            p, q = np.nonzero(mask & (scores >= low[rows, None]) & (scores <= high[rows, None]))
            return rows[p], columns[q], scores[p, q].astype(np.int64)
    scores = scored(a, b, i, j)
    keep = (scores >= low[i]) & (scores <= high[i])
    return i[keep], j[keep], scores[keep]


class Best:
    """The best ``k`` rows of each key: by score, then by smaller id."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.last = k, np.full(keys, -np.inf)
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.concatenate((self.key, key)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score, key))  # ~ turns the order round without overflow
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.key, self.score, self.id = key[keep], score[order][keep], ids[order][keep]
        full = place[keep] == self.k - 1
        self.last[self.key[full]] = self.score[full]


def tiles(batches: Iterator[pa.RecordBatch], dims: int, scale: float, size: int) -> Iterator[Vectors]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            rows = Vectors(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix_of(batch.column(2), dims, scale))
            yield rows.only(np.argsort(rows.labels, kind="stable"))


def best_same(rows: DataFrame, anchors, k: int, dims: int, scale: float) -> DataFrame:
    """``anchor`` (its number in the block), ``slot`` 0, ``id`` and ``score``: the best of each task."""
    schema = "anchor long, slot long, id long, score long"
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = anchors.value
        best = Best(len(block.ids), k)
        groups = {int(v): np.flatnonzero(block.labels == v) for v in np.unique(block.labels)}
        for tile in tiles(batches, dims, scale, TILE):
            for label in np.unique(tile.labels):
                own = groups.get(int(label), np.empty(0, np.int64))
                others = tile.only(np.flatnonzero(tile.labels == label)) if len(own) else None
                for at in range(0, len(own), TILE_ANCHORS):
                    some = own[at : at + TILE_ANCHORS]
                    a = block.only(some)
                    i, j, scores = between(a, others, a.ids[:, None] != others.ids[None, :], best.last[some], np.full(len(some), np.inf))
                    best.add(some[i], scores, others.ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (best.key, np.zeros_like(best.key), best.id, best.score)], schema=arrow)

    return rows.mapInArrow(run, schema)


def best_other(rows: DataFrame, anchors, windows, k: int, dims: int, scale: float) -> DataFrame:
    """``anchor``, ``slot`` (number of the positive), ``id`` and ``score``: the best of each task within each window."""
    schema = "anchor long, slot long, id long, score long"
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (low, high) = anchors.value, windows.value
        slots = low.shape[1]
        best = Best(low.size, k)
        for tile in tiles(batches, dims, scale, TILE):
            least = np.maximum(low, best.last.reshape(low.shape))
            least = np.where(high >= low, least, np.inf).min(axis=1)
            most = np.where(high >= low, high, -np.inf).max(axis=1)
            wanted = np.flatnonzero(least <= most)
            for at in range(0, len(wanted), TILE_ANCHORS):
                some = wanted[at : at + TILE_ANCHORS]
                a = block.only(some)
                mask = (a.labels[:, None] != tile.labels[None, :]) & (a.ids[:, None] != tile.ids[None, :])
                i, j, scores = between(a, tile, mask, least[some], most[some])
                i = some[i]
                for slot in range(slots):
                    fits = (scores >= low[i, slot]) & (scores <= high[i, slot]) & (scores >= best.last[i * slots + slot])
                    best.add(i[fits] * slots + slot, scores[fits], tile.ids[j[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (best.key // slots, best.key % slots, best.id, best.score)], schema=arrow)

    return rows.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", *,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 1.0,
) -> DataFrame:
    """For each anchor and each of its best same-label rows, the best different-label rows whose score is from ``low`` to
    ``high`` percent of the positive's. Components become ``floor(scale * x)``, and a score is their inner product."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = narrow(
        vectors, F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), is_anchor.alias("asks"),
    ).where("id is not null and label is not null and vector is not null").where(~odd)
    spark = vectors.sparkSession
    dims = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    asking = materialise(rows.where("asks").select("id", "label", "vector").distinct(), "anchors")
    rows = rows.select("id", "label", "vector")
    blocks = max(1, -(-asking.count() * 8 * dims // ANCHOR_BYTES))
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))
    out = None
    for k in range(blocks):
        held = asking.where(number == k).toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
        block = Vectors(held.column(0).to_numpy(), held.column(1).to_numpy(), matrix_of(held.column(2), dims, scale))
        anchors = spark.sparkContext.broadcast(block)
        same = materialise(ranked(best_same(rows, anchors, positives, dims, scale), positives), "positives")
        best = same.toArrow()
        windows = np.full((len(block.ids), positives), 1.0), np.zeros((len(block.ids), positives))
        for anchor, rank, score in zip(*(best.column(c).to_pylist() for c in ("anchor", "rank", "score"))):
            windows[0][anchor, rank - 1], windows[1][anchor, rank - 1] = -(-low * score // 100), high * score // 100
        named = spark.createDataFrame(pa.table({"anchor": np.arange(len(block.ids)), "anchor_id": block.ids}))
        asked = same.join(F.broadcast(named), "anchor").select(
            "anchor", (F.col("rank") - 1).cast("long").alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        other = ranked(best_other(rows, anchors, spark.sparkContext.broadcast(windows), negatives, dims, scale), negatives)
        found = materialise(
            other.join(asked, ["anchor", "slot"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ), "negatives",
        )
        out = found if out is None else out.unionByName(found)
    return out
