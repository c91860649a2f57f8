"""Records of CSV files whose quoted fields hold line breaks, cut in parallel.

A line that is read alone does not tell whether it stands inside quotes. It does tell two things: whether a line that begins
a record ends inside quotes, and whether a line that begins inside quotes ends inside them. That is a map of two states, and
maps of consecutive lines compose. So each byte range of a file (as Spark splits it) gives one map, the maps of a file are
composed in the order of its ranges, and then every range knows in which state it begins and is cut at true record ends by a
task of its own. Only a record that crosses ranges is put together from its parts.

A quote opens a field only where the field begins (blanks before it are skipped), two quotes inside are one, and after the
closing quote all up to the delimiter belongs to the field, as Python's csv module has it. Other quotes are plain characters.
A file that ends inside quotes ends its last record there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

OUTSIDE, INSIDE = 0, 1
# Whether a line can open or close a quoted field across its end: an odd number of quotes, or one inside plain text.
_STRAY = '[^,;\t|"\r]"[^,;\t|"\r]'


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value`` (the line's bytes as they are), ``file``, ``start`` (of its byte range) and ``number`` (ascending in it)."""
    lines = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number")
    )


def may_go_on(line: Column) -> Column:
    """Lines that need a closer look; without any, every line is a record."""
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return F.contains(line, F.lit('"')) & ((quotes % 2 == 1) | line.rlike(_STRAY))


class Scanner:
    """The state at a line's end, for one delimiter."""

    def __init__(self, delimiter: str) -> None:
        d = re.escape(delimiter)
        self.opening = re.compile(r' *+"' if delimiter == "\t" else r'[ \t]*+"')
        self.closing = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
        self.rest = re.compile(rf"[^{d}]*+(?:{d}|\Z)")  # of the field

    def end(self, line: str, state: int) -> int:
        at, inside = 0, state == INSIDE
        while inside or at < len(line):
            if not inside:
                opened = self.opening.match(line, at)
                inside, at = bool(opened), opened.end() if opened else self.rest.match(line, at).end()
            if inside:
                closed = self.closing.match(line, at)
                if not closed:
                    return INSIDE
                inside, at = False, self.rest.match(line, closed.end()).end()
        return OUTSIDE


def _quoted(lines: pa.Array) -> Iterator[tuple[int, str]]:
    """The lines with a quote. Bytes stand for characters, so that any encoding that holds ASCII can be scanned."""
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        yield k, lines[k].as_py().decode("latin-1")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(file, start) and the lines (bytes), one stretch of a byte range after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes, lines = files.indices.to_numpy(), batch.column(0).cast(pa.binary())
        edges = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]), [True]))).tolist()
        for x, y in zip(edges[:-1], edges[1:]):
            yield (files.dictionary[int(codes[x])].as_py(), int(starts[x])), lines.slice(x, y - x)


def range_maps(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file``, ``start`` and the state at the range's end from either state at its beginning (``outside``, ``inside``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, found = Scanner(delimiter), {}
        for key, part in _ranges(batches):
            states = found.setdefault(key, [OUTSIDE, INSIDE])
            for _, line in _quoted(part):
                ends = {s: scanner.end(line, s) for s in set(states)}
                states[:] = [ends[s] for s in states]
        columns = list(zip(*((*key, *states) for key, states in found.items()))) or [()] * 4
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "outside", "inside"])

    return lines.select("value", "file", "start").mapInArrow(run, "file string, start long, outside int, inside int")


def range_states(maps: DataFrame) -> DataFrame:
    """``file``, ``start``, ``before`` and ``after``: the states at the ends of each range. A file is folded in a row of its
    own, which holds a few bytes for each range."""
    ordered = maps.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "outside", "inside"))).alias("maps"))
    begin = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(OUTSIDE).alias("before"), F.lit(OUTSIDE).alias("after")))

    def add(done: Column, m: Column) -> Column:
        before = F.element_at(done, -1)["after"]
        after = F.when(before == OUTSIDE, m["outside"]).otherwise(m["inside"])
        return F.concat(done, F.array(F.struct(m["start"].alias("start"), before.alias("before"), after.alias("after"))))

    return ordered.select("file", F.explode(F.aggregate("maps", begin, add)).alias("s")).select("file", "s.*").where("start >= 0")


WHOLE, HEAD, TAIL = 0, 1, 2
PIECE = "file string, start long, kind int, header boolean, value binary"


def pieces(lines: DataFrame, delimiter: str, entered: set[tuple[str, int]], *, whole: bool) -> DataFrame:
    """Whole records of the ranges, or only the parts of records at their ends. ``entered``: ranges that begin inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, key, state, waiting, out, named = Scanner(delimiter), None, OUTSIDE, [], [], False

        def put(kind: int, values: list[bytes]) -> None:
            nonlocal named
            values = [v[:-1] if v.endswith(b"\r") else v for v in values] if kind == WHOLE else values
            values = [v for v in values if v.strip()] if kind == WHOLE else values
            first = key[1] == 0 and not named and kind != HEAD and bool(values)
            named |= first
            if (kind == WHOLE) == whole:
                out.extend((*key, kind, first and n == 0, v) for n, v in enumerate(values))

        def close() -> None:
            if waiting:
                put(HEAD if waiting[0] is None else TAIL, [b"\n".join(w for w in waiting if w is not None)])
                waiting.clear()

        for found, part in _ranges(batches):
            if found != key:
                if key is not None:
                    close()
                key, named, state = found, False, INSIDE if found in entered else OUTSIDE
                if state == INSIDE:
                    waiting.append(None)  # marks the end of a record that an earlier range began
            values, at = part.to_pylist(), 0
            for k, line in _quoted(part):
                end = scanner.end(line, state)
                if state == OUTSIDE and end == INSIDE:
                    put(WHOLE, values[at:k])
                    at = k
                elif state == INSIDE and end == OUTSIDE:
                    waiting += values[at : k + 1]
                    if waiting[0] is None:
                        close()
                    else:
                        put(WHOLE, [b"\n".join(waiting)])
                        waiting.clear()
                    at = k + 1
                state = end
            if state == OUTSIDE:
                put(WHOLE, values[at:])
            else:
                waiting += values[at:]
            if len(out) > 5_000:
                yield _batch(out)
                out = []
        if key is not None:
            close()
        if out:
            yield _batch(out)

    return lines.select("value", "file", "start").mapInArrow(run, PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    names = ["file", "start", "kind", "header", "value"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def records(spark: SparkSession, paths: str | Sequence[str], delimiter: str) -> DataFrame:
    """``file``, ``value`` (bytes) and ``header`` (the file's first record) of every record that is not blank."""
    lines = numbered_lines(spark, paths)
    states = materialise(range_states(range_maps(lines, delimiter)), "ranges")
    # A row for each range that begins inside quotes.
    entered = {(r["file"], r["start"]) for r in states.where(F.col("before") == INSIDE).select("file", "start").collect()}
    whole = pieces(lines, delimiter, entered, whole=True).select("file", "value", "header")
    cut = states.where((F.col("before") == INSIDE) | (F.col("after") == INSIDE)).select("file", "start")
    if cut.isEmpty():
        return whole
    parts = pieces(lines.join(F.broadcast(cut), ["file", "start"], "left_semi"), delimiter, entered, whole=False)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = parts.withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
    joined = marked.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", F.col("value").cast("string").alias("v")))).alias("parts"), F.bool_or("header").alias("header")
    )
    value = F.regexp_replace(F.array_join(F.col("parts.v"), "\n"), "\r$", "").cast("binary")
    return whole.unionByName(joined.select("file", value.alias("value"), "header"))
