"""The Jaccard join against brute force over all pairs, with large groups, divided regions and grids."""

import random

import numpy as np
import pytest
from llm_cases import SMALL
from test_near_dup import brute, edited

from plumbline.llm import jaccard_join as j


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def want(docs, size, percent):
    return {i: (n, c) for i, (n, c, _) in brute(docs, size, percent).items()}


def crowd(seed, scale=1):
    """Exact and near copies, a chain of edits, and pages of one template that are not linked."""
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(k)) for k in (60, 140)]
    texts = [base[0]] * 40 + [base[0].upper()] * 5 + [edited(base[1], r.randrange(0, 9), r) for _ in range(80 * scale)]
    texts += [edited(base[0], r.randrange(0, 5), r) for _ in range(40 * scale)] + ["one two", "ONE  two", "one", None, "", "  "]
    page = [f"t{i}" for i in range(90)]
    for _ in range(60 * scale):
        w = list(page)
        for k in (10, 30, 50, 70):
            w[k] = f"own{r.randrange(10**6)}"
        texts.append(" ".join(w))
    step = " ".join(f"c{i}" for i in range(80))
    for _ in range(12):
        texts.append(step)
        step = edited(step, 1, r)
    r.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_documents_equal_brute_force(spark, small_docs, size, percent):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert got(j.jaccard_classes(small_docs, size=size, percent=percent)) == want(rows, size, percent)


def test_groups_equal_brute_force(spark):
    docs = crowd(1)
    assert got(j.jaccard_classes(frame(spark, docs), size=4, percent=85)) == want(docs, 4, 85)


@pytest.mark.parametrize("local, seed", [(12, 2), (40, 3)])
def test_divided_regions_and_grids_equal_brute_force(spark, monkeypatch, local, seed):
    monkeypatch.setattr(j, "LOCAL", local)
    monkeypatch.setattr(j, "PIVOTS", 4)
    monkeypatch.setattr(j, "BROADCAST_ROWS", 0)
    docs = crowd(seed)
    assert got(j.jaccard_classes(frame(spark, docs), size=4, percent=85)) == want(docs, 4, 85)


def test_pages_of_one_template_are_not_paired_out(spark, monkeypatch):
    listed = []
    inner = j.measured

    def counting(pairs, *args):
        listed.append(pairs.count())
        return inner(pairs, *args)

    monkeypatch.setattr(j, "measured", counting)
    docs = crowd(4, scale=4)
    assert got(j.jaccard_classes(frame(spark, docs), size=4, percent=85)) == want(docs, 4, 85)
    assert sum(listed) < 4 * len(docs)


def test_first_shingles_meet():
    r = np.random.default_rng(5)
    for _ in range(300):
        n, percent = int(r.integers(1, 200)), int(r.integers(50, 100))
        need = -(-percent * n // 100)
        assert j.window(n, percent) == n - need + 1


def test_bits_never_exceed_the_symmetric_difference():
    r = np.random.default_rng(6)
    for _ in range(50):
        both = r.integers(0, 2**63, 3000).astype(np.uint64)
        x, y = both[: r.integers(1, 3000)], both[r.integers(0, 2999) :]
        for bits in (512, 2048):
            a, b = (j.parity(v, bits) for v in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
            assert (j.folded(j.parity(x, 8192), bits) == a).all()


def test_long_texts_equal_brute_force(spark):
    r = random.Random(9)
    base = [" ".join(f"w{r.randrange(9000)}" for _ in range(k)) for k in (300, 1100, 2300, 4100)]
    docs = [(i, edited(base[i % 4], r.randrange(0, 60), r)) for i in range(60)]
    assert got(j.jaccard_classes(frame(spark, docs), size=4, percent=85)) == want(docs, 4, 85)


def test_odd_rows(spark, edge_docs, no_docs):
    rows = j.jaccard_classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert [by[i] for i in (0, 1, 2)] == [[(0, 0)], [(0, 1)], [(0, 2)]]
    assert by[3] == [(1, 3)] * 2 and by[4] == [(1, 4)] and by[5] == [(1, 4)] and by[None] == [(1, None)]
    assert j.jaccard_classes(no_docs).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    docs = [(1, "a b c d e"), (5, "a b c d e"), (5, "k l m n o"), (9, "k l m n o"), (2, "k l m n o p q r")]
    found = {(r.doc_id, r.component_id) for r in j.jaccard_classes(frame(spark, docs), size=4, percent=85).collect()}
    assert found == {(1, 1), (5, 1), (9, 1), (2, 2)}


def test_query_covers_all_documents(spark):
    from plumbline.llm.queries import op12_jaccard_join

    assert op12_jaccard_join(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
