"""WARC archives with revisit records, and an index of all captures in global order.

Writing: equal payloads are found by digest; the row of the smallest id is a response, the others are revisits that
name it. Records are laid out as strings and written by Spark's text sink, whose line separator is the empty line
that ends every WARC record, so any file system that Spark writes to will do. Files are kept small by a number of
records that follows from the average size.

Reading: each file is parsed record by record by its Content-Length; digests are computed again from the bytes.

Index: each file's captures, sorted by URL key, time and id, are a run. Range boundaries come from a bounded sample
of the runs. Every run is cut at the boundaries, and all pieces of one range meet in a task, which merges them with
a loser tree. Ranges are about ``RANGE_ROWS`` captures whatever the keys are, since the id is part of the order and
divides even the captures of one URL. Counts of the ranges before give each capture its place in the whole.

Defined results: a null payload is an empty one; a null URL has no target URI and an empty key; a row without id is
a response of its own; rows that repeat id and payload are each a response if the id is the smallest; payloads below
``min_bytes`` are always responses; an empty table gives an empty table. Only id, URL, payload and time are read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema
from plumbline.llm.near_dup import sized
from plumbline.session import materialise, scratch_path

FILE_BYTES = 16_000_000  # aimed size of an archive file
RANGE_ROWS = 20_000  # aimed captures of a range of the index
SAMPLE_ROWS = 50_000  # captures that are sampled for range boundaries, about
PIECE_ROWS = 5_000  # captures of one run in a row that is sent to a range
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each five of them are four of 32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, key: str, url: str, payload: str, time: Column, min_bytes: int) -> DataFrame:
    """``id``, ``url``, ``payload``, ``time``, ``digest``, ``bytes`` and ``refers_to`` (null for responses)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    own = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"), time.alias("time"))
    own = own.withColumns({"digest": base32(F.sha1(F.col("payload").cast("binary"))), "bytes": F.octet_length("payload").cast("long")})
    first = own.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    ).where("first < last").select("digest", "first")
    joined = own.join(sized(first), "digest", "left")
    revisit = (F.col("bytes") >= min_bytes) & (F.col("id") > F.col("first"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record(template_time: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """A WARC record without its end. The HTTP block of a revisit has the headers only."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")), F.concat(F.lit("<urn:page:none:"), F.col("digest"), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.concat(F.lit("WARC-Date: "), F.date_format("time", template_time)),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(
    pages: DataFrame, path: str, time: Column, key: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, file_bytes: int = FILE_BYTES,
) -> None:
    """Write one record for each row of ``pages`` below ``path``."""
    average = pages.agg(F.avg(F.octet_length(payload))).first()[0] or 1.0
    found = captures(pages, key, url, payload, time, min_bytes)
    records = max(1, int(file_bytes / (average + 500)))
    found.select(record().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


@dataclass
class Capture:
    """What one record tells: of a revisit, digest and length are those of the payload it stands for."""

    offset: int
    length: int
    id: int | None
    url: str | None
    time: str
    digest: str
    bytes: int
    record_type: str
    refers_to: int | None


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parse(content: bytes) -> Iterator[Capture]:
    """The records of an archive one after the other."""
    at, separator = 0, END.encode()
    while at < len(content):
        head_end = content.index(separator, at)
        first, *lines = content[at:head_end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, size = head_end + 4, int(fields["Content-Length"])
        block = content[start : start + size]
        if len(block) != size or content[start + size : start + size + 4] != separator:
            raise ValueError(f"record at {at} is cut short")
        http, _, payload = block.partition(separator)
        declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != declared:
                raise ValueError(f"payload at {at} differs from its digest")
        yield Capture(
            at, start + size + 4 - at, _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Date"], digest,
            declared, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
        )
        at = start + size + 4


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the path and query: pages of one site sort together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


RUN_SCHEMA = (
    "file string, offset long, length long, id long, url_key string, time string, digest string, bytes long, record_type string, refers_to long"
)


def read_archives(files: DataFrame) -> DataFrame:
    """The captures of archive files (``path`` and ``content``, as the binary source gives them): a sorted run for each file."""
    arrow = arrow_schema(files, RUN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                found = [(c, url_key(c.url)) for c in parse(content.as_py())]
                found.sort(key=lambda x: (x[1], x[0].time, -1 if x[0].id is None else x[0].id, x[0].offset))
                rows = [
                    {"file": path.as_py(), "offset": c.offset, "length": c.length, "id": c.id, "url_key": k, "time": c.time, "digest": c.digest,
                     "bytes": c.bytes, "record_type": c.record_type, "refers_to": c.refers_to}
                    for c, k in found
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, RUN_SCHEMA)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so the next winner is found by one way up."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, run: int) -> None:
        """Take ``run`` up from its leaf. While the tree fills, the first to come to a node waits there."""
        winner, node = run, (run + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``position``, their place in the order of URL key, time, id, file and offset."""
    order = ["url_key", "time", "id", "file", "offset"]
    total = runs.count()
    ranges = max(1, -(-total // range_rows))
    part = min(1.0, SAMPLE_ROWS / max(1, total))
    spread = F.pmod(F.xxhash64("file", "offset"), F.lit(1_000_000)) < 1_000_000 * part
    sample = sorted(tuple(("" if v is None else v) if i != 2 else (-1 if v is None else v) for i, v in enumerate(r)) for r in runs.where(spread).select(*order).collect())
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    own = runs.schema
    shared = runs.sparkSession.sparkContext.broadcast(bounds)
    names = [f.name for f in own]
    piece_schema = f"range long, run string, part long, rows array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in own)}>>"
    arrow = arrow_schema(runs, piece_schema)

    def key_of(row: dict) -> tuple:
        return row["url_key"], row["time"], -1 if row["id"] is None else row["id"], row["file"], row["offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the runs; a run that comes in several batches is cut in several pieces, each sorted."""
        for number, batch in enumerate(batches):
            pieces: dict[tuple[str, int], list[dict]] = {}
            for row in batch.to_pylist():
                pieces.setdefault((row["file"], bisect_right(shared.value, key_of(row))), []).append(row)
            for (run, where), rows in pieces.items():
                rows.sort(key=key_of)
                for at in range(0, len(rows), PIECE_ROWS):
                    piece = {"range": where, "run": run, "part": number * 1_000_000 + at, "rows": rows[at : at + PIECE_ROWS]}
                    yield pa.RecordBatch.from_pylist([piece], schema=arrow)

    result_schema = f"range long, place long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in own)}"
    result_arrow = arrow_schema(runs, result_schema)

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        sorted_runs = []
        for run in pieces["rows"]:
            rows = run.as_py()
            sorted_runs.append(iter([(key_of(r), i, r) for i, r in enumerate(rows)]))
        rows = [r for _, _, r in LoserTree(sorted_runs)]
        columns = {n: [r[n] for r in rows] for n in names}
        where = key[0].as_py()
        return pa.Table.from_pydict({"range": [where] * len(rows), "place": list(range(len(rows))), **columns}, schema=result_arrow)

    merged = runs.mapInArrow(cut, piece_schema).groupBy("range").applyInArrow(merge, result_schema)
    merged = materialise(merged, "index")
    # One row for each range, and so a few for each million captures.
    before, running = [], 0
    for row in merged.groupBy("range").count().orderBy("range").collect():
        before.append((row["range"], running))
        running += row["count"]
    offsets = runs.sparkSession.createDataFrame(before, "range long, before long")
    return merged.join(F.broadcast(offsets), "range").withColumn("position", F.col("before") + F.col("place")).drop("range", "place", "before")


def archive(
    pages: DataFrame, time: Column, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, path: str | None = None
) -> DataFrame:
    """Write the archives of ``pages`` to ``path`` (else the shared folder), read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, time, key, url, payload, min_bytes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return merged_index(materialise(read_archives(files), "runs"))
