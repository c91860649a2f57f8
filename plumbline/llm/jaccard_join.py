"""N-gram Jaccard join in the metric space of shingle sets.

A document is the set of its distinct word shingles; ``1 - |intersection| / |union|`` is a metric on sets. Two documents
are linked if their distance is at most ``r = 1 - percent / 100``. Pivots are points of the space, and documents join only
inside the Voronoi regions of pivots, each region holding also those that the triangle inequality can't keep out:

1. First pivots are the sets of one shingle. A document's nearest ones are its own shingles, all at one distance; ties are
   broken by one order of all shingles, from rare to frequent. Linked documents share at least
   ``need = ceil(percent * n / 100)`` of either one's ``n`` shingles, so their first common shingle is among the first
   ``n - need + 1`` of both: a document is copied to these regions and no others. Regions of one document go, regions of the
   same members are one.
2. A region of more than ``LOCAL`` members is divided by ``PIVOTS`` of its documents. A member's home is its nearest pivot h;
   it is copied to every pivot p with ``d(x, p) <= d(x, h) + 2 r``: if y is linked to x and has its home at p, then
   ``d(x, p) <= d(y, p) + r <= d(y, h) + r <= d(x, h) + 2 r``. The regions are divided again until they are small. Distances
   to pivots are exact, so links to pivots are found on the way, and a region whose members are all in one component is done.
   A region that pivots can't divide (all of its members at like distances) is cut into a grid of blocks, block by block.
3. Inside a region, parity bits of a set, about two for each element, give a lower bound of the symmetric difference
   (each element flips one bit). First, members that pass are tied to few hubs; links are confirmed on full sets and give
   components. Then all pairs that pass and still lie in different components are confirmed. A pair inside one component
   could not change it, so large groups of near copies are never paired out and no link between components is lost.
   Regions carry at most ``BITS`` bits of a set; pairs of larger sets meet the bound again with all of their bits.

The order of shingles comes from counts over all documents; any order gives the same result, a good one smaller regions.

Defined results: a null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle has
its word sequence as its only shingle; equal sets are linked; rows that repeat an id are one document with a row each; a row
without id is linked with nothing; an empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema, narrow, per_batch, texts
from plumbline.llm.near_dup import BROADCAST_ROWS, components, mixed, shingles, sized
from plumbline.operators.skew import balanced_join
from plumbline.session import materialise

LOCAL = 1_024  # members of a region that are joined in one task
PIVOTS = 16
LEAST_BITS, BITS = 512, 2_048  # parity bits that a region carries for a set
PIVOT_BYTES = 32_000_000  # sets of pivots that are broadcast; more are joined by shuffle
FREQUENT = 200_000  # shingles whose frequency decides their place; the others count as equally rare
COUNTED = 2_000_000  # shingles that a task counts at once
HELD_TWICE = 4  # counts below it are not passed on


def width(n: int, most: int) -> int:
    """Parity bits for a set of ``n``: a power of two, two for each element."""
    return min(max(LEAST_BITS, 1 << (2 * n - 1).bit_length()), most) if n else LEAST_BITS


def parity(elements: np.ndarray, bits: int) -> np.ndarray:
    """Words of ``bits`` bits, each bit the parity of the number of elements that fall on it."""
    places = (mixed(elements) >> np.uint64(7)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The parities of fewer bits, along the last axis."""
    while words.shape[-1] * 64 > bits:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def described(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Rows of documents (``id``, ``n``, ``hi``, ``lo``, ``bits``, ``wide``) and rows of counts (``shingle``, ``held``)."""
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text))
    schema = "id long, n long, hi long, lo long, bits binary, wide binary, shingle long, held long"
    arrow = arrow_schema(own, schema)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        keep = counts >= HELD_TWICE
        values, counts = values[keep].view(np.int64), counts[keep]
        none = [pa.nulls(len(values), f.type) for f in list(arrow)[:6]]
        return pa.RecordBatch.from_arrays([*none, pa.array(values), pa.array(counts)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                rows = []
                for value in texts(batch, 1):
                    found = shingles(value, size)
                    digest = xxhash.xxh3_128_intdigest(found.tobytes())
                    whole_bits = parity(found, width(len(found), 1 << 62))
                    bits = folded(whole_bits, BITS)
                    wide = whole_bits.tobytes() if len(whole_bits) > len(bits) else None
                    rows.append((len(found), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, bits.tobytes(), wide))
                    if len(found):
                        parts.append(found)
                        waiting += len(found)
                if not rows:
                    continue
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:6])]
                none = [pa.nulls(batch.num_rows, f.type) for f in list(arrow)[6:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *none], schema=arrow)
                if waiting > COUNTED:
                    yield counted(parts)
                    parts, waiting = [], 0
        if parts:
            yield counted(parts)

    return own.mapInArrow(run, schema)


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` of the most frequent shingles, sorted, and their counts."""
    summed = materialise(counts.groupBy("shingle").agg(F.sum("held").alias("held")), "counts")
    least, total = None, 0
    for row in summed.groupBy(F.floor(F.log2("held")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
        total += row["count"]
        if total > FREQUENT:
            break
        least = 2 ** row["power"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = summed.where(F.col("held") >= least).toArrow()
    keys, held = found.column("shingle").to_numpy().view(np.uint64), found.column("held").to_numpy()
    order = np.argsort(keys)
    return keys[order], held[order]


def window(n: int, percent: int) -> int:
    """How many of the first shingles of a set of ``n`` a linked set must meet."""
    return n + (-percent * n // 100) + 1


def first_regions(docs: DataFrame, key: str, text: str, size: int, percent: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``cell`` and ``id``: each document in the regions of its first shingles."""
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text))
    schema = "cell long, id long"
    arrow = arrow_schema(own, schema)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch, cells, ids = whole.slice(at, 1_000), [], []
                for i, value in zip(batch.column(0).to_pylist(), texts(batch, 1)):
                    found = shingles(value, size)
                    if len(found) and len(keys):
                        places = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                        found = found[np.lexsort((found, np.where(keys[places] == found, held[places], 0)))]
                    first = found[: window(len(found), percent)]
                    cells.append(first.view(np.int64))
                    ids.append(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(ids), pa.int64())], schema=arrow)

    return own.mapInArrow(run, schema)


def measured(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The pairs (``a``, ``b``) with ``distance``, from the full sets. Sets are made again for their documents only."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text)).join(sized(asked), "id")

    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "own": [shingles(t, size).tobytes() for t in texts(batch, 1)]}

    sets = materialise(per_batch(own.select("id", text), "id long, own binary", work), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b"
    )

    def compare(batch: pa.RecordBatch) -> dict:
        out = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            merged = np.concatenate((x, y))
            merged.sort(kind="stable")
            common = int((merged[1:] == merged[:-1]).sum())
            out.append((common, len(x) + len(y) - common))
        return {"a": batch.column(0), "b": batch.column(1), "common": [o[0] for o in out], "either": [o[1] for o in out]}

    return per_batch(both.select("a", "b", "x", "y"), "a long, b long, common long, either long", compare)


def to_pivots(asked: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The same for pairs (``id``, ``pivot``) of few pivots, whose sets go to the members rather than both through a shuffle."""
    own = narrow(docs, F.col(key).cast("long").alias("id"), F.col(text))
    pivots = own.join(sized(asked.select(F.col("pivot").alias("id")).distinct()), "id")
    sets = materialise(per_batch(pivots.select("id", text), "id long, own binary", lambda b: {"id": b.column(0), "own": [shingles(t, size).tobytes() for t in texts(b, 1)]}), "sets")
    if (sets.agg(F.sum(F.length("own"))).first()[0] or 0) > PIVOT_BYTES:
        return measured(asked.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), docs, key, text, size)
    table = sets.toArrow()
    held = docs.sparkSession.sparkContext.broadcast([(i, np.frombuffer(v, np.uint64)) for i, v in zip(*(c.to_pylist() for c in table.columns))])

    def work(batch: pa.RecordBatch) -> dict:
        places: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(held.value):
            places.setdefault(i, []).append(k)
        out = []
        for i, wanted, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, 2)):
            mine = shingles(value, size)
            for pivot in wanted:
                for k in places.get(pivot, ()):
                    theirs = held.value[k][1]
                    spots = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    common = int((mine[spots] == theirs).sum()) if len(mine) else 0
                    out.append((min(i, pivot), max(i, pivot), common, len(mine) + len(theirs) - common))
        return dict(zip(("a", "b", "common", "either"), map(list, zip(*out)) if out else ([], [], [], [])))

    lists = asked.groupBy("id").agg(F.collect_set("pivot").alias("wanted"))
    return per_batch(own.join(sized(lists), "id").select("id", "wanted", text), "a long, b long, common long, either long", work).distinct()


def linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * F.col("either")


def similar(flipped: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes whose parities differ in ``flipped`` bits can be linked."""
    apart = flipped.sum(axis=-1, dtype=np.int64)
    return ((100 + percent) * apart <= (100 - percent) * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))


def near(bits: dict[int, np.ndarray], sizes: np.ndarray, widths: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a region can be linked with each other, by their bits and sizes. ``bits``: by width, folded from
    all members of that width or more."""
    out = np.zeros((len(sizes), len(sizes)), bool)
    for w in np.unique(widths):
        # Sets of similar sizes have the same width or twice the one.
        mine, others = np.flatnonzero(widths == w), np.flatnonzero((widths == w) | (widths == 2 * w))
        x, y = bits[w][mine], bits[w][others]
        step = max(1, 2**20 // (len(others) * x.shape[1]))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            passes = similar(np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]), sizes[rows, None], sizes[None, others], percent)
            out[np.ix_(rows, others)] = passes
            out[np.ix_(others, rows)] |= passes.T
    return out


def laid_out(column: list[bytes], widths: np.ndarray) -> dict[int, np.ndarray]:
    """Words of all members for each width, filled in for the members of that width and of twice the one."""
    out = {}
    for w in np.unique(widths):
        out[w] = np.zeros((len(column), w // 64), np.uint64)
        for own in (w, 2 * w):
            places = np.flatnonzero(widths == own)
            if len(places):
                words = np.frombuffer(b"".join(column[k] for k in places), np.uint64).reshape(len(places), -1)
                out[w][places] = folded(words, w)
    return out


def passing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (``a``, ``b``), those that the bound with all bits lets pass."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    own = materialise(reps.join(sized(asked), "id").select("id", "n", F.coalesce("wide", "bits").alias("bits")), "asked")
    x, y = (own.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def work(batch: pa.RecordBatch) -> dict:
        keep = []
        for na, nb, p, q in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
            p, q = (np.frombuffer(v, np.uint64) for v in (p, q))
            bits = 64 * min(len(p), len(q))
            keep.append(bool(similar(np.bitwise_count(folded(p, bits) ^ folded(q, bits)), na, nb, percent)))
        keep = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return per_batch(both, "a long, b long", work).distinct()


def region_pairs(members: DataFrame, percent: int, *, hubs: bool) -> DataFrame:
    """Pairs (``a``, ``b``) inside regions that the bound lets pass: with ``hubs`` few that tie the members together, else
    all between different components of which one is at home. ``members``: cell, id, component, home, n, bits."""
    schema = "a long, b long"
    arrow = arrow_schema(members, schema)

    def inside(ids, comps, home, sizes, widths, bits) -> list[np.ndarray]:
        out, passes = [], near(bits, sizes, widths, percent)
        if hubs:
            np.fill_diagonal(passes, False)
            degree, open_ = passes.sum(axis=1), np.ones(len(ids), bool)
            for hub in np.argsort(-degree, kind="stable"):
                others = passes[hub] & open_
                if open_[hub] and others.any():
                    out.append(np.stack((np.full(others.sum(), ids[hub]), ids[others])))
                    open_ &= ~passes[hub]
                    open_[hub] = False
        else:
            i, j = np.nonzero(passes & (comps[:, None] != comps[None, :]) & (home[:, None] | home[None, :]))
            out.append(np.stack((ids[i], ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for tail, last in _closed(batches):
            table = pa.Table.from_batches([*rest, tail]).combine_chunks().to_batches()[0]
            cells = table.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
            if not last:
                rest = [table.slice(edges[-2])]  # the last region may go on
                edges = edges[:-1]
            ids, comps, sizes = (table.column(k).to_numpy() for k in (1, 2, 4))
            home = table.column(3).to_numpy(zero_copy_only=False)
            column = table.column(5).to_pylist()
            widths = np.fromiter((8 * len(v) for v in column), np.int64, len(column))
            starts, lengths = edges[:-1], np.diff(edges)
            out = [np.empty((2, 0), np.int64)]
            # Regions of two all at once, in parts of like widths.
            twos = starts[lengths == 2]
            twos = twos[(comps[twos] != comps[twos + 1]) & (home[twos] | home[twos + 1])]
            least = np.minimum(widths[twos], widths[twos + 1])
            for w in np.unique(least):
                x = twos[least == w]
                p, q = (np.stack([folded(np.frombuffer(column[k], np.uint64), w) for k in at]) for at in (x, x + 1))
                passes = similar(np.bitwise_count(p ^ q), sizes[x], sizes[x + 1], percent)
                out.append(np.stack((ids[x[passes]], ids[x[passes] + 1])))
            for x, y in zip(starts[lengths > 2], (starts + lengths)[lengths > 2]):
                bits = laid_out(column[x:y], widths[x:y])
                out += inside(ids[x:y], comps[x:y], home[x:y], sizes[x:y], widths[x:y], bits)
            a, b = np.concatenate(out, axis=1)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=arrow)

    dealt = members.select("cell", "id", "component", "home", "n", "bits").repartition("cell").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(run, schema).where("a < b").distinct()


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Each batch, and whether it is the last one."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, False
            before = batch
    if before is not None:
        yield before, True


def divided(large: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The regions of pivots inside each region (``cell``, ``id``, ``home``, ``parent``), and the links to pivots."""
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS))
    pivots = large.where("home").groupBy("cell", spread.alias("k")).agg(F.min(F.struct(F.xxhash64("id", F.lit(2)), "id"))["id"].alias("pivot"))
    asked = materialise(balanced_join(large, _listed(pivots), ["cell"], "inner").select("cell", "id", "home", F.explode("pivots").alias("pivot")), "asked")
    known = materialise(to_pivots(asked.where("id <> pivot"), docs, key, text, size), "measured")
    both = known.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("either")).alias("d"))
    both = both.union(both.select("pivot", "id", "d"))
    near_by = asked.join(both, ["id", "pivot"], "left").select("cell", "id", "home", "pivot", F.coalesce("d", F.lit(0.0)).alias("d"))
    grouped = near_by.groupBy("cell", "id", "home").agg(F.min(F.struct("d", "pivot")).alias("h"), F.collect_list(F.struct("d", "pivot")).alias("all"))
    reach = F.col("h.d") + 2 * (1 - percent / 100) + 1e-9
    copies = grouped.select("cell", "id", "home", "h", reach.alias("reach"), F.explode("all").alias("p")).where("p.d <= reach")
    regions = copies.select(
        F.xxhash64("cell", "p.pivot").alias("new"), "id", (F.col("home") & (F.col("h.pivot") == F.col("p.pivot"))).alias("home"), F.col("cell").alias("parent")
    ).withColumnRenamed("new", "cell")
    return materialise(regions, "regions"), known.where(linked(percent)).select("a", "b")


def _listed(pivots: DataFrame) -> DataFrame:
    return pivots.groupBy("cell").agg(F.collect_list("pivot").alias("pivots"))  # at most PIVOTS


def grid(stuck: DataFrame) -> DataFrame:
    """Regions cut into blocks, one region for each pair of blocks. ``stuck``: cell, id, home, members."""
    blocks = F.ceil(2 * F.col("members") / F.lit(LOCAL)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    paired = stuck.select("cell", "id", "home", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    return paired.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "id", "home")


def several(cells: DataFrame, labels: DataFrame | None, least: int = 2) -> DataFrame:
    """The regions of at least ``least`` members that lie in more than one component, with ``component``."""
    if labels is None:
        return cells.withColumn("component", F.col("id"))
    marked = materialise(cells.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "marked")
    counted = marked.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
    return balanced_join(marked, materialise(counted.where(f"x <> y and members >= {least}").select("cell", "members"), "mixed"), ["cell"], "inner")


def split(large: DataFrame, regions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the regions made from large ones: those to join now, and those to divide again.

    A large region is cut into a grid instead if its parts together have more than twice its members, and so is a part
    that is hardly smaller than the whole.
    """
    parts = materialise(several(regions, labels).select("cell", "parent", "id", "home", "members"), "parts")
    before = large.groupBy(F.col("cell").alias("parent")).agg(F.count("*").alias("before"))
    after = parts.groupBy("parent").agg(F.count("*").alias("after"))
    fate = materialise(before.join(after, "parent").select("parent", "before", (F.col("after") > 2 * F.col("before")).alias("tangled")), "fate")
    parts = balanced_join(parts, fate, ["parent"], "inner")
    tangled = balanced_join(large, fate.where("tangled").select(F.col("parent").alias("cell")), ["cell"], "left_semi")
    apart, wide = ~F.col("tangled"), F.col("members") > LOCAL
    stuck = F.col("members") > 0.8 * F.col("before")
    now = parts.where(apart & ~wide).select("cell", "id", "home").unionByName(grid(parts.where(apart & wide & stuck))).unionByName(grid(tangled))
    return materialise(now, "now"), materialise(parts.where(apart & wide & ~stuck).select("cell", "id", "home", "members"), "large")


def joined(reps: DataFrame, docs: DataFrame, known: tuple, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that connect all sets which are connected. ``reps``: id, n, bits, wide."""
    wide, reps = reps, reps.select("id", "n", "bits")
    ids = reps.select("id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        own = docs.join(F.broadcast(ids.withColumnRenamed("id", key)), key, "left_semi")
        rows = first_regions(own, key, text, size, percent, known)
    else:  # rather ids are shuffled than texts
        rows = first_regions(docs, key, text, size, percent, known).join(ids, "id", "left_semi")
    rows = materialise(rows, "first")
    hashed = F.xxhash64("id")
    who = [F.sum(F.pmod(hashed, F.lit(2**31 - 1))).alias("s"), F.sum(F.pmod(hashed, F.lit(2**31 - 99))).alias("t")]
    shared = rows.groupBy("cell").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("cell")
    rows = materialise(rows.join(shared, "cell"), "shared")
    same = rows.groupBy("cell").agg(F.count("*").alias("members"), F.min("id").alias("x"), F.max("id").alias("y"), *who)
    kept = materialise(same.groupBy("members", "x", "y", "s", "t").agg(F.min("cell").alias("cell")).select("cell", "members"), "cells")
    cells = materialise(rows.join(kept, "cell").withColumn("home", F.lit(True)), "cells")

    small, large = [cells.where(F.col("members") <= LOCAL).select("cell", "id", "home")], cells.where(F.col("members") > LOCAL)
    links: list[DataFrame] = []
    labels = None
    while not large.isEmpty():
        regions, found = divided(large, docs, key, text, size, percent)
        links.append(found)
        labels = components(_union(links))
        now, large = split(large, regions, labels)
        small.append(now)

    regions = materialise(_union(small), "regions")
    # Hubs are chosen whatever is linked already: that saves a join of all members with their components.
    asked = regions.join(reps, "id").withColumn("component", F.col("id"))
    hubs = materialise(passing(materialise(region_pairs(asked, percent, hubs=True), "pairs"), wide, percent), "passed")
    links.append(materialise(measured(hubs, docs, key, text, size).where(linked(percent)).select("a", "b"), "links"))
    # Regions of two are settled now.
    rest = several(regions, components(_union(links)), 3).select("cell", "id", "home", "component").join(reps, "id")
    pairs = materialise(region_pairs(rest, percent, hubs=False).join(hubs, ["a", "b"], "left_anti"), "pairs")
    pairs = materialise(passing(pairs, wide, percent), "passed")
    links.append(materialise(measured(pairs, docs, key, text, size).where(linked(percent)).select("a", "b"), "links"))
    return _union(links)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, for every row.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of ``size``-word shingles.
    """
    every = materialise(described(docs, key, text, size), "described")
    counts = every.where("shingle is not null").select("shingle", "held")
    every = every.where("shingle is null").select("id", "n", "hi", "lo", "bits", "wide")
    filled = every.where("n > 0 and id is not null")
    # Equal sets: the smallest id stands for all. Only sets held more than once need a join.
    sets = filled.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    sets = materialise(sets, "sets")
    twice = sets.where("copies > 1").select("hi", "lo", "rep")
    owned = balanced_join(filled.select("id", "n", "hi", "lo"), twice, ["hi", "lo"], "left").withColumn("rep", F.coalesce("rep", "id"))
    owned = materialise(owned.select("id", "n", "rep"), "owned")
    reps = sets.select(F.col("rep").alias("id"), "n", "bits", "wide")

    links = joined(reps, docs, frequent(counts), key, text, size, percent)
    # Rows that repeat an id are one document, whatever sets they hold.
    again = owned.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    labels = components(links.union(again)).withColumnRenamed("id", "rep")
    found = balanced_join(owned, labels, ["rep"], "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = every.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
