"""Benchmark decontamination: edit distances, the recall of the walks' keys, planted passages and clean documents."""

import random

import numpy as np
import pytest
from llm_cases import SMALL

from plumbline.llm import decontaminate as d


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
    best = min(row)
    return best, row.index(best)


@pytest.mark.parametrize("seed", range(30))
def test_distance_equals_dynamic_programming(seed):
    r = random.Random(seed)
    item, text = (bytes(r.choices(b"abc ", k=r.randrange(1, 40))) for _ in range(2))
    assert d.distance(item, text) == brute_distance(item, text)


def altered(text, edits, r):
    out = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[at] = r.choice("abcdefgh")
        elif kind == 1:
            out.insert(at, r.choice("abcdefgh"))
        else:
            del out[at]
    return "".join(out)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()
    return [tuple(r) for r in docs], [tuple(r) for r in items]


def test_planted_passages_and_clean_documents(spark, tables):
    docs, items = tables
    clean = [(i, t) for i, t in docs if not any(item in t for _, item in items)]
    r = random.Random(1)
    rows, planted = list(clean), {}
    for k, (item, text) in enumerate(items[:120]):
        share = (0.0, 0.0, 0.01, 0.02, 0.04)[k % 5]
        passage = altered(text, int(share * len(text)), r)
        host = clean[k % len(clean)][1]
        cut = max(host.find(" ", len(host) // 2), 0)
        rows.append((10_000 + k, f"{host[:cut]} {passage.upper() if k % 7 == 0 else passage} {host[cut:]}"))
        planted[10_000 + k] = item
    found = {}
    for row in d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        found.setdefault(row.doc_id, set()).add(row.item_id)
    assert not set(found) & {i for i, _ in clean}
    assert sum(item in found.get(i, ()) for i, item in planted.items()) >= 0.97 * len(planted)


def test_matches_equal_exact_search(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = {(i, r.item_id) for i, t in docs for r in items.collect() if d.normal(r.text) in d.normal(t)}
    rows = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    normal = {i: d.normal(t) for i, t in docs}
    texts = {r.item_id: d.normal(r.text) for r in items.collect()}
    assert {(r.doc_id, r.item_id) for r in rows if r.distance == 0} == want and want
    for r in rows:
        assert brute_distance(texts[r.item_id], normal[r.doc_id][r.start : r.end])[0] == r.distance <= d.MAX_SHARE * len(texts[r.item_id])


def test_prefilter_loses_no_window(tables):
    """The window at an altered item's place is among those that are looked at, for every number of edits allowed."""
    _, items = tables
    r = random.Random(2)
    block = d.Block({i: d.normal(t) for i, t in items}, {i: [i] for i, _ in items}).prepare()
    for i, text in items[:80]:
        item = d.normal(text)
        passage = d.normal(altered(text, int(d.MAX_SHARE * len(item)), r))
        if d.distance(item, passage)[0] <= d.MAX_SHARE * len(item):
            data = b"zz " * 60 + passage + b" yy" * 60
            found = dict(block.windows(data))
            assert 180 in found.get(d.size_class(len(item)), np.array([]))


def test_blocks_of_items_and_repeated_items(spark, tables, monkeypatch):
    docs, items = tables
    rows = [(1, "x " + items[0][1] + " y " + items[5][1]), (1, items[0][1]), (2, None), (3, ""), (4, "short")]
    bench = [*items[:10], (900, items[0][1]), (901, None), (902, "too short"), (None, items[1][1])]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    whole = sorted(tuple(r) for r in d.leaks(*frames).collect())
    assert [(r[0], r[1]) for r in whole] == [(1, 0), (1, 0), (1, 5), (1, 900), (1, 900)]
    monkeypatch.setattr(d, "BLOCK_BYTES", 500)
    assert sorted(tuple(r) for r in d.leaks(*frames).collect()) == whole
    monkeypatch.setattr(d, "BLOCK_ITEMS", 3)
    assert sorted(tuple(r) for r in d.leaks(*frames).collect()) == whole
    assert d.leaks(frames[0].limit(0), frames[1]).count() == 0 and d.leaks(frames[0], frames[1].limit(0)).count() == 0


def invented(r, size):
    """Words of random letters, to ``size`` characters."""
    text = ""
    while len(text) < size:
        text += "".join(r.choices("etaoinshrdlucmfw", k=r.randrange(2, 9))) + " "
    return text[:size].strip()


@pytest.mark.parametrize("size", [17, 19, 23, 24, 33, 34, 36, 39, 40, 50, 100, 500, 1000, 2000, 5000])
def test_no_item_within_the_allowed_edits_is_missed(size):
    """As many edits as are allowed, evenly spread or anywhere, whatever the item's length."""
    r = random.Random(size)
    items = {i: d.normal(invented(r, size)) for i in range(12)}
    block = d.Block(items, {i: [i] for i in items}).prepare()
    for i, item in items.items():
        allowed = d.edits(len(item))
        out = list(item.decode())
        for k in range(allowed):
            out[len(item) * k // allowed if i % 2 else r.randrange(len(out))] = "z"
        passage = "".join(out).encode()
        assert d.distance(item, passage)[0] <= allowed
        text = (invented(r, 700) + " " + passage.decode() + " " + invented(r, 700))
        assert {m[1] for m in block.matches([text])} == {i}


@pytest.mark.parametrize("size", [24, 33, 40, 60, 100, 300, 1000, 5000])
def test_recall_of_the_keys_alone(size):
    """Without the seeds, at as many edits of any kind as are allowed."""
    r = random.Random(size)
    items = {i: d.normal(invented(r, size)) for i in range(40 if size < 1000 else 12)}
    block = d.Block(items, {i: [i] for i in items}, seeded=False).prepare()
    assert not block.seeds
    found = tried = 0
    for i, item in items.items():
        text = f"{invented(r, 700)} {altered(item.decode(), d.edits(len(item)), r)} {invented(r, 700)}"
        if d.distance(item, d.normal(text))[0] <= d.edits(len(item)):
            tried += 1
            found += i in {m[1] for m in block.matches([text])}
    assert found >= 0.9 * tried > 0.8 * len(items)


def test_walks_bring_edit_distance_to_hamming_distance():
    """Equal strings walk alike whatever follows; few edits change few of the keys, other strings almost all."""
    r = random.Random(8)
    one, other = invented(r, 64).encode(), invented(r, 64).encode()
    keys = {name: set(d.walk_keys(d.padded(text), np.array([0]), 64)[0].tolist()) for name, text in {
        "one": one, "longer": one + b" and more", "altered": one[:40] + b"q" + one[41:], "other": other}.items()}
    assert len(keys["one"]) == d.WALKS * d.KEYS
    assert len(keys["one"] & keys["longer"]) >= 0.8 * len(keys["one"])
    assert len(keys["one"] & keys["altered"]) >= 5 and len(keys["one"] & keys["other"]) <= 1


def test_keys_inside_longer_data_are_those_of_the_part_alone():
    r = random.Random(9)
    text = invented(r, 500).encode()
    places = d.anchors(text)[:20]
    inside = d.walk_keys(d.padded(text), places, 20)
    for place, row in zip(places.tolist(), inside):
        assert (row == d.walk_keys(d.padded(text[place : place + 40]), np.array([0]), 20)[0]).all()


@pytest.mark.parametrize("size", range(14, 45))
def test_short_items_equal_brute_force(size):
    """Every stretch within the allowed edits is found, and nothing else, at lengths about the least that may have an edit."""
    r = random.Random(size)
    items = {i: d.normal(invented(r, size + 2))[:size].strip() for i in range(8)}
    block = d.Block(items, {i: [i] for i in items}).prepare()
    texts = [f"{invented(r, 60)} {altered(items[k % 8].decode(), k % 4, r)} {invented(r, 60)}" for k in range(60)]
    got = {(m[0], m[1]) for m in block.matches(texts)}
    want = set()
    for number, text in enumerate(texts):
        data = d.normal(text)
        for i, item in items.items():
            if d.edits(len(item)):
                hit = brute_distance(item, data)[0] <= d.edits(len(item))
            else:
                hit = b" " + item + b" " in b" " + data + b" "
            want |= {(number, i)} if hit else set()
    assert got == want and want


def test_stretches_that_follow_each_other_are_each_found():
    r = random.Random(3)
    item = d.normal(invented(r, 120))
    block = d.Block({0: item}, {0: [7]}).prepare()
    text = b" ".join([item, item, item[:60] + b"q" + item[60:], b"end"])
    n = len(item)
    assert [m[1:] for m in block.matches([text.decode()])] == [(7, 0, 0, n), (7, 0, n + 1, 2 * n + 1), (7, 1, 2 * n + 2, 3 * n + 3)]


def of_letters(r, size, first, last):
    return "".join(chr(r.randrange(ord(first), ord(last) + 1)) for _ in range(size))


@pytest.mark.parametrize("first, last", [("一", "龠"), ("ぁ", "ゖ"), ("ก", "ฮ")])
@pytest.mark.parametrize("size", [12, 45, 150])
def test_copies_inside_texts_without_blanks(first, last, size):
    r = random.Random(size)
    items = {i: d.normal(of_letters(r, size, first, last)) for i in range(10)}
    block = d.Block(items, {i: [i] for i in items}).prepare()
    for i, item in items.items():
        text = of_letters(r, 300, first, last) + item.decode() + of_letters(r, 300, first, last)
        start = len(d.normal(text[:300]))
        assert [m[1:] for m in block.matches([text])] == [(i, 0, start, start + len(item))]


@pytest.mark.parametrize("before, after", [("“", "”"), ("word", "word"), ("（", "）"), ("　", " "), ("—", "…")])
def test_copies_behind_other_punctuation_and_without_a_blank(before, after):
    r = random.Random(5)
    item = d.normal(invented(r, 120))
    block = d.Block({0: item}, {0: [0]}).prepare()
    assert [m[1:3] for m in block.matches([invented(r, 200) + before + item.decode() + after + invented(r, 200)])] == [(0, 0)]


def test_unicode_punctuation_and_blanks_are_one_space():
    assert d.normal("A“b”　。 c…- d​e กิ") == "a b c d e กิ".encode()


def test_short_items_match_exactly_between_word_borders(spark):
    items = [(1, "Who wrote it?"), (2, "yes"), (3, "été"), (4, "你好吗"), (5, "?!"), (6, "wrote it"), (7, "Yes!")]
    texts = ["Say: who wrote\nit, yes", "who wrote its", "eyes yesterday", "un été chaud", "étés", "我说你好吗他说", "", "who wrotte it", "x" * 50 + " yes"]
    frames = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.leaks(*frames).collect())
    assert got == [(0, 1), (0, 2), (0, 6), (0, 7), (3, 3), (5, 4), (8, 2), (8, 7)]
