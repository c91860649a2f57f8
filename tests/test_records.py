"""CSV records with line breaks in quotes against Python's csv module, with byte ranges cut anywhere."""

import csv
import io
import random

import pytest

from plumbline.sources.files import manifest, read_csv
from plumbline.sources.records import INSIDE, OUTSIDE, Scanner

WORDS = ["plain", "two words", 'a "quoted" word', "line\nbreak", "\n", "a,b;c", '5" pipe', "x\n\n,\"y\"\nz", "Zoë", 'ends with "', '"', "deep\n" * 9]


def written(rows, delimiter=",", end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
    return out.getvalue()


def some_rows(seed, n):
    r = random.Random(seed)
    return [[str(i), r.choice(WORDS) + str(i), r.choice(WORDS) + "e"] for i in range(n)]


def in_order(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("bytes_", ["97", "1000", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_ranges(spark, tmp_path, bytes_, end):
    rows = some_rows(1, 300)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_bytes(written([["id", "one", "two"], *rows[100 * k : 100 * k + 100]], end=end).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        found = in_order(read_csv(spark, str(folder), schema="id string, one string, two string"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == [tuple(r) for r in rows]


def test_scanner_agrees_with_the_csv_module():
    r = random.Random(3)
    for delimiter in (",", "\t", ";"):
        scanner = Scanner(delimiter)
        for _ in range(3_000):
            text = "".join(r.choice(['"', '"', delimiter, "a", "b", "\n"]) for _ in range(r.randrange(0, 14)))
            state, records = OUTSIDE, 0
            for line in text.split("\n"):
                state = scanner.end(line, state)
                records += state == OUTSIDE
            records += state == INSIDE
            want = len(list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, skipinitialspace=True)))
            blank_end = text.endswith("\n") and state == OUTSIDE or not text
            assert records - blank_end == want, text


def test_files_of_one_folder_are_judged_by_themselves(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Zoë\n2,Jörg\n", encoding="utf-8")
    (tmp_path / "b c.csv").write_text("id;name\n3;Jürgen\n4;Anaïs\n", encoding="latin-1")
    (tmp_path / "d.csv").write_text("id;name\n5;20 €\n6;\"x;\ny\"\n", encoding="windows-1252")
    found = sorted((r["id"], r["name"]) for r in read_csv(spark, str(tmp_path)).collect())
    assert found == [(1, "Zoë"), (2, "Jörg"), (3, "Jürgen"), (4, "Anaïs"), (5, "20 €"), (6, "x;\ny")]
    judged = {m.path.rsplit("/", 1)[-1]: (m.delimiter, m.encoding, m.goes_on) for m in manifest(spark, str(tmp_path))}
    assert judged == {"a.csv": (",", "UTF-8", False), "b%20c.csv": (";", "ISO-8859-1", False), "d.csv": (";", "windows-1252", True)}


def test_odd_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    assert [(r["a"], r["b"].rstrip()) for r in read_csv(spark, str(tmp_path / "open.csv")).collect()] == [(1, "never closed\n2,x")]
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "stray.csv").write_text('a,b\n5" pipe,7\n6" pipe,8\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "stray.csv")).collect()) == [('5" pipe', 7), ('6" pipe', 8)]
