"""Prefix trie of conversations, in ternary search trees per range shard.

A node is a distinct sequence of first turns (role and text), its members are the conversations that start with it. Turns
become 128-bit digests, a node's key the exclusive or of its turns' digests, each mixed with its place, so that any task can
name a node. A conversation is cut into segments of ``SEGMENT`` turns; equal segments behind equal turns are counted first
and are one row. Segments are sorted by range, and a task reads its range in shards of at most ``SHARD`` turns:

1. A shard numbers its distinct turns in a dictionary and inserts its sequences, medians first, into a ternary search tree
   over these numbers, whose sibling trees are balanced by that. Parents are made before their children, so one pass backwards
   over the nodes adds up members, leaves and savings without recursion.
2. Nodes on the path of a shard's first and last sequence can go on in the next shard, and nodes above a segment's end in
   the next segment. These boundary nodes, few beside the others, come out with sums over their complete children only. They
   are merged by key, and their subtrees' sums follow by pointer jumping: after k rounds a node has the sums of 2**k levels.

No task holds a whole conversation or a whole node's members: places within a conversation come from a range sort with the
rows of earlier ranges added, and digests of members are taken from a sorted stream of id lists.

Defined results: rows without a conversation id take no part; a null role or text is empty; turns are ordered by ``turn``
(null first), equal ones by a digest of role and text; repeated rows are turns of their own; an empty table has no node.
Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema, narrow
from plumbline.llm.near_dup import mixed, sized
from plumbline.session import materialise

SEGMENT = 64  # turns
SHARD = 50_000  # turns in one tree
RANGE_ROWS = 500_000  # turns that are sorted in one task
IDS = 10_000  # ids in one piece of a member list
STRIDE = 1_024  # segments of one conversation that are added up at once
ENTRY = 20  # bytes of a turn in a segment: 16 of its digest, 4 of its number of code points


def ranges(rows: int) -> int:
    return max(1, -(-rows // RANGE_ROWS))


def numbered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``place`` (from 0), ``digest`` and ``chars`` of every turn."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)), 1, 16)
    rows = narrow(
        conversations.where(F.col(key).isNotNull()), F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        digest.alias("digest"), F.char_length(said).cast("int").alias("chars"),
    )
    rows = materialise(rows, "turns")
    order = ["conv", F.asc_nulls_first("turn"), "digest", "salt"]  # the salt spreads rows that are equal in all
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(ranges(rows.count()), *order).sortWithinPartitions(*order)
    schema = "conv long, part int, place long, digest binary, chars int"
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], convs[1:] != convs[:-1])))
            places = np.arange(len(convs)) - np.repeat(starts, np.diff(np.append(starts, len(convs))))
            if last == convs[0]:
                places[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = convs[-1], places[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(convs), part, np.int32)), pa.array(places), *batch.columns[2:4]], schema=arrow)

    placed = materialise(dealt.mapInArrow(run, schema), "placed")
    # At most one conversation goes on from one range to the next.
    wide = placed.groupBy("conv").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("conv")
    counts = placed.join(F.broadcast(wide), "conv", "left_semi").groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(counts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before")
    return placed.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations made of the first ``head`` turns (at most ``most``) of the conversation ``base`` and their own turns
    after the first ``head``: the turns with ``length``, and the ids of conversations that have no turn then. ``base`` and
    ``head`` are expressions over ``conv``."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", base.alias("base"), head.cast("int").alias("head"))
    convs = materialise(convs, "convs")
    heads = turns.where(F.col("place") < most).join(convs.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi")
    listed = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("first"))
    first = F.when(F.col("head") > 0, F.slice("first", F.lit(1), F.greatest("head", F.lit(1))))
    convs = convs.join(listed, "base", "left").select("conv", "head", F.coalesce(first, F.array().cast(listed.schema["first"].dataType)).alias("first"), "n")
    length = F.size("first") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    convs = materialise(convs.select("conv", "head", "first", length.cast("long").alias("length")), "rebuilt")
    copied = convs.select("conv", F.posexplode("first").alias("place", "t"), "length").select("conv", F.col("place").cast("long").alias("place"), "t.digest", "t.chars", "length")
    own = turns.join(convs.select("conv", "head", F.size("first").alias("copied"), "length"), "conv").where("place >= head")
    own = own.select("conv", (F.col("place") - F.col("head") + F.col("copied")).alias("place"), "digest", "chars", "length")
    return copied.unionByName(own), convs.where("length = 0").select("conv")


def place_hashes(entries: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each turn (rows of ``ENTRY`` bytes) at its place."""
    halves = np.ascontiguousarray(entries[:, :16]).view(np.uint64)
    at = mixed(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.stack((mixed(halves[:, 0] ^ at), mixed(halves[:, 1] + at)), axis=1)


def segments(turns: DataFrame, empty: DataFrame) -> DataFrame:
    """``conv``, ``length``, ``seg``, ``entries`` (bytes), their key ``x``, ``y``, and the key before them ``hi``, ``lo``."""
    seg = F.floor(F.col("place") / SEGMENT)
    rows = turns.groupBy("conv", seg.alias("seg")).agg(
        F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("t")
    ).select("conv", "length", "seg", F.col("t.digest").alias("digest"), F.col("t.chars").alias("chars"))
    none = empty.select("conv", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("seg"), F.array().cast("array<binary>").alias("digest"), F.array().cast("array<int>").alias("chars"))
    rows = rows.unionByName(none)
    schema = "conv long, length long, seg long, entries binary, x long, y long"
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column(3).value_lengths())
            digests = np.frombuffer(b"".join(batch.column(3).flatten().to_pylist()), np.uint8).reshape(-1, 16)
            chars = batch.column(4).flatten().to_numpy().astype(">u4").view(np.uint8).reshape(-1, 4)
            entries = np.concatenate((digests, chars), axis=1)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            places = np.arange(len(entries)) - np.repeat(starts, sizes) + np.repeat(batch.column(2).to_numpy() * SEGMENT, sizes)
            sums = np.concatenate((np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(place_hashes(entries, places), axis=0)))
            keys = (sums[ends] ^ sums[starts]).view(np.int64)
            whole = entries.tobytes()
            pieces = [whole[a * ENTRY : b * ENTRY] for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pieces, pa.binary()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], schema=arrow)

    cut = materialise(rows.mapInArrow(run, schema), "segments")
    short = cut.where(F.col("length") <= SEGMENT).withColumns({"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long")})
    long_ = cut.where(F.col("length") > SEGMENT).withColumn("stride", F.floor(F.col("seg") / STRIDE))
    if long_.isEmpty():
        return short
    earlier = Window.partitionBy("conv").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = long_.groupBy("conv", "stride").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
        "conv", "stride", F.bit_xor("x").over(earlier).alias("x0"), F.bit_xor("y").over(earlier).alias("y0")
    )
    inside = Window.partitionBy("conv", "stride").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")

    def before(column: str) -> Column:
        return F.coalesce(F.bit_xor(column).over(inside), zero).bitwiseXOR(F.coalesce(F.col(column + "0"), zero))

    long_ = long_.join(strides, ["conv", "stride"]).withColumns({"hi": before("x"), "lo": before("y")})
    return materialise(short.unionByName(long_.select(*short.columns)), "keyed")


class Tree:
    """A ternary search tree of one shard: arrays of nodes, parents before children."""

    def __init__(self) -> None:
        self.code, self.left, self.right, self.first, self.parent = [-1], [0], [0], [0], [-1]

    def child(self, node: int, code: int) -> int:
        """The child of ``node`` with the code, made if there is none."""
        links, at = self.first, node
        while links[at]:
            at = links[at]
            if code == self.code[at]:
                return at
            links = self.left if code < self.code[at] else self.right
        links[at] = new = len(self.code)
        for column, value in zip((self.code, self.left, self.right, self.first, self.parent), (code, 0, 0, 0, node)):
            column.append(value)
        return new


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    waiting = [(0, n)]
    while waiting:
        x, y = waiting.pop()
        if x < y:
            middle = (x + y) // 2
            yield middle
            waiting += [(middle + 1, y), (x, middle)]


NODE = "hi long, lo long, depth long, up_hi long, up_lo long, conv long, n long, chars long, children long, leaves long, saved long, up_conv long, boundary boolean"


def shard_nodes(rows: list[tuple], segment: int) -> dict[str, list]:
    """Nodes of a shard. ``rows``: seg, hi, lo, entries, last, n, conv, sorted."""
    lengths = np.array([len(r[3]) // ENTRY for r in rows])
    entries = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, ENTRY)
    starts = np.cumsum(lengths) - lengths
    places = np.arange(len(entries)) - np.repeat(starts, lengths) + np.repeat(np.array([r[0] for r in rows]) * segment, lengths)
    hashes = place_hashes(entries, places)
    chars = np.ascontiguousarray(entries[:, 16:]).view(">u4").ravel().tolist()
    numbers = {turn: k for k, turn in enumerate(sorted({bytes(e) for e in entries} | {(r[0], r[1], r[2]) for r in rows}, key=str))}
    codes = [numbers[bytes(e)] for e in entries]
    tree = Tree()
    paths = {}
    for k in medians(len(rows)):
        node = tree.child(0, numbers[rows[k][:3]])
        path = [node]
        for at in range(starts[k], starts[k] + lengths[k]):
            node = tree.child(node, codes[at])
            path.append(node)
        paths[k] = path
    size = len(tree.code)
    key, depth, length = [None] * size, [0] * size, [0] * size
    n, conv, boundary = [0] * size, [None] * size, [False] * size
    for k, path in paths.items():
        seg, hi, lo, _, last, count, least = rows[k]
        h = np.array([hi, lo], np.int64).view(np.uint64)
        for step, node in enumerate(path):
            if step:
                at = starts[k] + step - 1
                if key[node] is None:
                    above = key[path[step - 1]]
                    key[node] = above[0] ^ int(hashes[at, 0]), above[1] ^ int(hashes[at, 1])
                    depth[node], length[node] = seg * segment + step, chars[at]
            elif key[node] is None:
                key[node], depth[node], boundary[node] = (int(h[0]), int(h[1])), seg * segment, True
            if step or not seg:  # a later segment's top is the last node of the segment before
                n[node] += count
                conv[node] = least if conv[node] is None else min(conv[node], least)
            if not last or k in (0, len(rows) - 1):
                boundary[node] = True
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    out = {name.split()[0]: [] for name in NODE.split(", ")}
    for node in range(size - 1, 0, -1):
        up = tree.parent[node]
        if not boundary[node]:
            leaves[node] += not children[node]
            saved[node] += (n[node] - 1) * length[node]
            if up:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        above = key[up] if up else (None, None)
        values = (*key[node], depth[node], *above, conv[node], n[node], length[node], children[node], leaves[node], saved[node])
        for name, value in zip(out, (*values, conv[up] if up and not boundary[up] else None, boundary[node])):
            out[name].append(value)
    for name in ("hi", "lo", "up_hi", "up_lo"):
        out[name] = [None if v is None else v - (1 << 64) if v >> 63 else v for v in out[name]]
    return out


def trees(cut: DataFrame) -> DataFrame:
    """Nodes of all shards, boundary nodes in parts. ``cut``: seg, hi, lo, entries, last, n, conv."""
    turns = cut.agg(F.sum(F.greatest(F.lit(1), F.length("entries") / ENTRY))).first()[0] or 0
    order = ["seg", "hi", "lo", "entries", "last"]
    dealt = cut.repartitionByRange(max(1, int(turns) // SHARD + 1), *order).sortWithinPartitions(*order)
    arrow = arrow_schema(cut, NODE)
    segment = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                waiting += 1 + len(row[3]) // ENTRY
                if waiting >= SHARD:
                    yield pa.RecordBatch.from_pydict(shard_nodes(rows, segment), schema=arrow)
                    rows, waiting = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(shard_nodes(rows, segment), schema=arrow)

    return dealt.select(*order, "n", "conv").mapInArrow(run, NODE)


def merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes put together, with the sums of their whole subtrees."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    most = [F.max(c).alias(c) for c in ("depth", "up_hi", "up_lo", "chars")]
    nodes = materialise(parts.groupBy("hi", "lo").agg(*sums, *most, F.min("conv").alias("conv")), "boundary")
    more = nodes.where("up_hi is not null").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("more"))
    nodes = nodes.join(more, ["hi", "lo"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = materialise(nodes.withColumns({
        "leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars"),
    }), "boundary")
    sums_ = nodes.select("hi", "lo", "up_hi", "up_lo", "leaves", "saved")
    while not (below := sums_.where("up_hi is not null")).isEmpty():
        added = below.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jumps = sums_.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("up_hi").alias("to_hi"), F.col("up_lo").alias("to_lo"))
        sums_ = materialise(
            sums_.join(sized(added), ["hi", "lo"], "left").join(sized(jumps), ["up_hi", "up_lo"], "left").select(
                "hi", "lo", F.col("to_hi").alias("up_hi"), F.col("to_lo").alias("up_lo"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ), "sums",
        )
    return nodes.drop("leaves", "saved").join(sums_.select("hi", "lo", "leaves", "saved"), ["hi", "lo"])


def prefix_trie(turns: DataFrame, empty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (``hi``, ``lo``, ``depth``, ``conv``, ``up_conv``, ``n``, ``children``, ``leaves``, ``saved``), and for each
    conversation ``conv`` the node ``hi``, ``lo`` where it ends. ``turns``: conv, place, digest, chars, length."""
    pieces = segments(turns, empty)
    ends = pieces.groupBy("conv").agg(F.bit_xor("x").alias("hi"), F.bit_xor("y").alias("lo"))
    last = (F.col("seg") + 1) * SEGMENT >= F.col("length")
    cut = materialise(pieces.groupBy("seg", "hi", "lo", "entries", last.alias("last")).agg(F.count("*").alias("n"), F.min("conv").alias("conv")), "cut")
    parts = materialise(trees(cut), "nodes")
    joined = materialise(merged(parts.where("boundary")), "merged")
    names = sized(joined.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv").alias("named")))
    columns = ["hi", "lo", "depth", "up_hi", "up_lo", "conv", "n", "children", "leaves", "saved", "up_conv"]
    inner = parts.where("not boundary").select(*columns)
    every = inner.unionByName(joined.withColumn("up_conv", F.lit(None).cast("long")).select(*columns))
    known = every.where("up_conv is not null").select("hi", "lo", "depth", "conv", "up_conv", "n", "children", "leaves", "saved")
    asked = every.where("up_conv is null").join(names, ["up_hi", "up_lo"], "left")
    return known.unionByName(asked.withColumn("up_conv", F.col("named")).select(*known.columns)), ends


def member_digests(ends: DataFrame) -> DataFrame:
    """``hi``, ``lo`` and ``digest``: SHA-256 of the node's ids in ascending order, joined by commas."""
    ends = materialise(ends, "ends")
    order = ["hi", "lo", "conv"]
    schema = "hi long, lo long, conv long, ids string"
    arrow = arrow_schema(ends, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, conv = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
            cuts = sorted({*new.tolist(), *range(0, len(hi), IDS)}) + [len(hi)]
            ids = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(cuts[:-1], cuts[1:])]
            at = np.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at]), pa.array(conv[at]), pa.array(ids)], schema=arrow)

    lists = ends.select(*order).repartitionByRange(ranges(ends.count()), *order).sortWithinPartitions(*order).mapInArrow(listed, schema)
    result = "hi long, lo long, digest string"
    out = arrow_schema(ends, result)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(out.names, map(list, zip(*done)))), schema=out)

        for batch in batches:
            for hi, lo, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (hi, lo), hashlib.sha256()
                digest.update(ids.encode())
            if len(done) > IDS:
                yield batch_of()
                done = []
        if node is not None:
            done.append((*node, digest.hexdigest()))
        if done:
            yield batch_of()

    return lists.repartition("hi", "lo").sortWithinPartitions(*order).mapInArrow(hashed, result)


def with_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes by public names, with the digest of the members that end there."""
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(member_digests(ends), ["hi", "lo"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", none).alias("ends_sha256"),
    )
