"""WARC archives: round trip of records, the loser tree and the order of the merged index."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, bytes string, time string"


def at():
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id") % 3, F.lit(0)))


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree(seed):
    r = random.Random(seed)
    runs = [sorted(r.choices(range(30), k=r.randrange(0, 12))) for _ in range(r.choice([0, 1, 2, 3, 7, 16]))]
    merged = list(warc.LoserTree([iter([(x, i) for x in run]) for i, run in enumerate(runs)]))
    assert merged == sorted((x, i) for i, run in enumerate(runs) for x in run)


def frame(spark):
    r = random.Random(4)
    bodies = ["", None, "<p>é</p>", "a\r\n\r\nWARC/1.1\r\nb", "x" * 70_000, "\0", "end\r\n\r\n", "<p>é</p> "]
    urls = ["http://b.example.com/x?y#z", "https://a.example.com/", None, "no scheme", "http://a.example.com/p\r\nq", "http://u@B.Example.com:80"]
    rows = [(i, r.choice(urls), r.choice(bodies), "x", "y") for i in r.sample(range(1000), 120)]
    rows += [rows[0], (None, urls[0], "<p>é</p>", None, None), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("least", [0, 5])
def test_records_come_back(spark, tmp_path, least):
    rows, pages = frame(spark)
    index = warc.archive(pages, at(), min_bytes=least, path=str(tmp_path / "a")).collect()
    assert len(index) == len(rows)
    first = {}
    for i, _, body, *_ in rows:
        if i is not None and len((body or "").encode()) >= least:
            first[body or ""] = min(i, first.get(body or "", i))
    want = []
    for i, _, body, *_ in rows:
        raw = (body or "").encode()
        refers = first.get(body or "") if i is not None and len(raw) >= least else None
        refers = None if refers == i else refers
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(((r.id, r.bytes, r.digest, r.record_type, r.refers_to) for r in index), key=order) == sorted(want, key=order)


def test_index_is_in_global_order_over_many_files_and_ranges(spark, tmp_path):
    rows, pages = frame(spark)
    path = str(tmp_path / "many")
    warc.write_archives(pages.repartition(3), path, at(), file_bytes=60_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    assert files.count() > 3
    for ranges in (7, 1_000):
        index = warc.merged_index(warc.read_archives(files), range_rows=ranges).orderBy("position").collect()
        assert [r.position for r in index] == list(range(len(rows)))
        keys = [(r.url_key, r.time, -1 if r.id is None else r.id, r.file, r.offset) for r in index]
        assert keys == sorted(keys)
    contents = {r.path: bytes(r.content) for r in files.collect()}
    assert all(contents[r.file][r.offset : r.offset + 8] == b"WARC/1.1" and contents[r.file][r.offset + r.length - 4 : r.offset + r.length] == b"\r\n\r\n" for r in index)


def test_damage_is_noticed(spark, tmp_path):
    _, pages = frame(spark)
    warc.write_archives(pages.coalesce(1), str(tmp_path / "d"), at())
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "d")).first().content)
    assert list(warc.parse(content))
    with pytest.raises(ValueError):
        list(warc.parse(content.replace(b"<p>", b"<q>")))
    with pytest.raises(ValueError):
        list(warc.parse(content[:-3]))


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA), at()).count() == 0


def test_ids_at_both_ends(spark, tmp_path):
    from plumbline.llm.queries import op6_warc

    ids = [2**63 - 1, -(2**63), 2**62, 0, None]
    spark.createDataFrame([(i, "http://a.b/", "<p>x") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"] for r in op6_warc(spark, str(tmp_path)).collect()} == set(ids)
