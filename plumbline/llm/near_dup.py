"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct word shingles. Its signature has ``SYMBOLS`` b-bit MinHash symbols, and two
documents of Jaccard similarity s differ in a symbol with probability of about 1 - s. Signatures are split into 13
chunks of five symbols or four. Two signatures that differ in at most ``MAX_DISTANCE`` = 25 symbols agree in some
chunk but for one symbol at most (else they would differ in 2 * 13 = 26), so keys that leave out one symbol of a
chunk each, 64 in all, bring every such pair together. At similarity 0.85 a pair of signatures lies beyond with a
probability of about 1e-6, at 0.8 of 4e-5. Pairs are confirmed on the full sets.

Groups are never paired out. Equal sets become one representative first. In every bucket each member is paired with
the smallest only, one confirmed link joins it to a component, and then documents of buckets that still hold several
components are compared across these, by an exact join on their rarest shingles. What is skipped could not be linked
or could not change a component, so none is lost.
Components come from label propagation with pointer jumping; every round is stored in the shared folder.

Defined results: a document without words or text has an empty set and is linked with nothing; one of fewer words
than a shingle has its whole word sequence as its only shingle; rows that repeat a ``doc_id`` are one document,
with a row each; a row without ``doc_id`` is linked with nothing and kept; an empty table gives an empty table. Only
the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema, narrow, per_batch, texts
from plumbline.session import materialise

SYMBOLS = 64
CHUNKS = [list(range(at, min(at + 5, SYMBOLS))) for at in range(0, SYMBOLS, 5)]
MAX_DISTANCE = 2 * len(CHUNKS) - 1
BLOCK = 20_000  # shingles that are hashed at once
BROADCAST_ROWS = 1_000_000  # a table of ids up to this size (24 MB) is broadcast, a larger one is shuffled

_seeds = np.random.default_rng(20_08)
XORS = _seeds.integers(0, 2**64, SYMBOLS, np.uint64)
FACTORS = _seeds.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = _seeds.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Case of A-Z and kind of blanks don't matter."""
    words = text.encode().lower().split()  # bytes: only A-Z and only the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    last = len(words) - n + 1
    total = np.full(last, n, np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + last])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 symbols of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        for i in range(SYMBOLS):
            least[i] = min(least[i], ((part ^ XORS[i]) * FACTORS[i]).min())
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def described(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``id``, ``n_shingles``, 128 bits of the set (``hi``, ``lo``) and ``signature``."""

    def work(batch: pa.RecordBatch) -> dict:
        counts, hi, lo, signatures = [], [], [], []
        for value in texts(batch, 1):
            found = shingles(value, size)
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            counts.append(len(found))
            hi.append((digest >> 64) - 2**63)
            lo.append((digest & (2**64 - 1)) - 2**63)
            signatures.append(signature(found).tobytes() if len(found) else None)
        return {"id": batch.column(0), "n_shingles": counts, "hi": hi, "lo": lo, "signature": signatures}

    schema = "id long, n_shingles long, hi long, lo long, signature binary"
    return per_batch(narrow(docs, F.col(key).cast("long").alias("id"), F.col(text)), schema, work)


def buckets(signed: DataFrame) -> DataFrame:
    """``bucket``, ``id`` and ``n_shingles``: 64 rows for each signature, one for each symbol left out of its chunk."""
    schema = "bucket long, id long, n_shingles long"
    arrow = arrow_schema(signed, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                symbols = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
                keys = np.empty((len(symbols), SYMBOLS), np.uint64)
                for chunk in CHUNKS:
                    for left_out in chunk:
                        key = np.full(len(symbols), left_out, np.uint64)
                        for j, place in enumerate(chunk):
                            key = mixed(key * ORDER[j] + (np.uint64(0x10000) if place == left_out else symbols[:, place]))
                        keys[:, left_out] = key
                ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
                sizes = np.repeat(batch.column(1).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids), pa.array(sizes)], schema=arrow)

    return signed.select("id", "n_shingles", "signature").mapInArrow(run, schema)


def sized(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar_size(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes are further apart can't reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of the pairs (``a``, ``b``), those within the distance of signatures."""
    own = signed.select("id", "signature")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(
        own.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"
    ).select("a", "b", "sa", "sb")

    def work(batch: pa.RecordBatch) -> dict:
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
        keep = pa.array((left != right).sum(axis=1) <= MAX_DISTANCE)
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return per_batch(both, "a long, b long", work)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Of the pairs (``a``, ``b``), those whose full sets are similar enough. Sets are made again for their documents only."""
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text))

    def work(batch: pa.RecordBatch) -> dict:
        return {"to": batch.column(0), "other": batch.column(1), "own": [shingles(t, size).tobytes() for t in texts(batch, 2)]}

    ask = sized(pairs.select(F.col("a").alias("id"), "b"))
    asked = per_batch(own.join(ask, "id").select("b", "id", text), "to long, other long, own binary", work)
    answer = sized(pairs.select(F.col("b").alias("id")).distinct())
    answers = per_batch(
        own.join(answer, "id").select("id", F.lit(None).cast("long"), text), "to long, other long, own binary", work
    ).select("to", F.col("own").alias("theirs"))

    def compare(batch: pa.RecordBatch) -> dict:
        keep = []
        for mine, theirs in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (mine, theirs))
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        keep = pa.array(keep)
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    joined = asked.join(answers, "to").select(F.col("other").alias("a"), F.col("to").alias("b"), "own", "theirs")
    return per_batch(joined, "a long, b long", compare)


def enough(common: Column, both: Column, percent: int) -> Column:
    """Whether sets of ``both`` elements together are similar enough with ``common`` elements in common."""
    return 100 * common >= percent * (both - common)


def between_components(members: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of members of different components that can be similar enough, none left out.

    ``members`` has ``id``, ``component`` and ``n_shingles``. The shingles of a document are put in order: first those
    that occur in its component only, which no document outside can share, then the others from rare to frequent.
    Two similar documents share a shingle so early in both orders that what follows can still make up the similarity.
    Only such early shingles are joined, so that a large group of near copies, of which many are too far from each
    other for a link, is not paired out.
    """
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text)).join(sized(members), "id").select("id", "component", "n_shingles", text)
    schema = "id long, component long, n long, shingle long"
    arrow = arrow_schema(own, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(texts(batch, 3)):
                found = shingles(value, size).view(np.int64)
                same = [pa.array(np.full(len(found), batch.column(k)[i].as_py())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found)], schema=arrow)

    held = own.mapInArrow(run, schema)
    outside = held.groupBy("shingle").agg(
        F.count("*").alias("holders"), F.min("component").alias("x"), F.max("component").alias("y")
    ).where("x <> y").select("shingle", "holders")
    one = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(one) + F.row_number().over(one.orderBy("holders", "shingle")) - 1
    early = held.join(outside, "shingle").withColumn("place", place).where(100 * (F.col("n") - F.col("place")) >= percent * F.col("n"))
    early = materialise(early.select("id", "component", "n", "shingle", "place"), "early")
    left, right = early.alias("l"), early.alias("r")
    most = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    condition = (
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.component") != F.col("r.component"))
        & similar_size(F.col("l.n"), F.col("r.n"), percent) & enough(most, F.col("l.n") + F.col("r.n"), percent)
    )
    return left.join(right, condition).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in the edges (``a``, ``b``)."""
    both = materialise(edges.union(edges.select("b", "a")).distinct().toDF("id", "other"), "edges")
    labels = materialise(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = materialise(lower.join(jump, "component", "left").select("id", "old", F.least("component", "further").alias("component")), "labels")
        if not labels.where("component <> old").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (it is that one).

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of ``size``-word shingles.
    """
    every = materialise(described(docs, key, text, size), "described")
    filled = every.where("n_shingles > 0 and id is not null")
    # Equal sets: one representative, the smallest id, stands for all.
    sets = filled.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    signed = materialise(
        filled.join(sets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n_shingles", "signature"), "signed"
    )

    rows = buckets(signed)
    leads = rows.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    shared = materialise(rows.join(leads.select("bucket", "lead"), "bucket"), "shared")

    # Each member with the smallest of its buckets that is near.
    sizes = signed.select(F.col("id").alias("lead"), F.col("n_shingles").alias("lead_size"))
    stars = shared.where("id <> lead").select("id", "n_shingles", "lead").distinct().join(sizes, "lead")
    stars = stars.where(similar_size(F.col("n_shingles"), F.col("lead_size"), percent)).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    first = materialise(near(stars, signed).groupBy("a").agg(F.min("b").alias("b")), "pairs")
    links = materialise(confirmed(first, docs, key, text, size, percent), "links")
    labels = components(links)

    # Pairs of one bucket that are not in one component yet: all of their documents that can be linked beyond it.
    known = shared.select("bucket", "id", "n_shingles").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = materialise(known, "known")
    apart = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    members = materialise(known.join(apart, "bucket", "left_semi").select("id", "component", "n_shingles").distinct(), "members")
    rest = between_components(members, docs, key, text, size, percent)
    rest = materialise(rest.join(first, ["a", "b"], "left_anti").join(first.toDF("b", "a"), ["a", "b"], "left_anti"), "pairs")
    more = materialise(confirmed(rest, docs, key, text, size, percent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))

    found = sets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    linked = filled.join(found, ["hi", "lo"]).select("id", "n_shingles", "component_id")
    alone = every.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
