"""Near-duplicates against brute force over all pairs, with large groups of exact and near copies."""

import collections
import random

import numpy as np
import pytest
from llm_cases import LOWER, SMALL, words

from plumbline.llm import near_dup as n


def brute(docs, size, percent):
    """Shingle counts and the smallest id of each component, by all pairs that share a shingle."""
    sets, holders = {}, collections.defaultdict(set)
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for s in sets[i]:
            holders[s].add(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, own in sets.items():
        for j, common in collections.Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def edited(text, edits, r):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_documents_equal_brute_force(spark, small_docs, size, percent):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert got(n.near_duplicates(small_docs, size=size, percent=percent)) == brute(rows, size, percent)


def test_large_groups_of_exact_and_near_copies(spark):
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(k)) for k in (60, 140)]
    texts = [base[0]] * 80 + [base[0].upper()] * 5
    texts += [edited(base[1], r.randrange(0, 9), r) for _ in range(160)] + [edited(base[0], r.randrange(0, 5), r) for _ in range(60)]
    texts += ["one two", "ONE  two", "one", None, "", "  "]
    # A chain: each step is close to the last one, the ends are not.
    step = " ".join(f"c{i}" for i in range(80))
    for _ in range(12):
        texts.append(step)
        step = edited(step, 2, r)
    r.shuffle(texts)
    docs = [(7 * i + 3, t) for i, t in enumerate(texts)]
    result = got(n.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), size=3, percent=85))
    want = brute(docs, 3, 85)
    assert result == want
    assert max(collections.Counter(c for _, c, _ in want.values()).values()) > 80


def test_shuffled_way_gives_the_same(spark, small_docs, monkeypatch):
    whole = got(n.near_duplicates(small_docs))
    monkeypatch.setattr(n, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(n, "BLOCK", 10)
    assert got(n.near_duplicates(small_docs)) == whole


def test_every_pair_within_the_distance_shares_a_bucket(spark):
    r = np.random.default_rng(3)
    left = r.integers(0, 2**16, (200, n.SYMBOLS)).astype(np.uint16)
    right = left.copy()
    for row in right:
        row[r.choice(n.SYMBOLS, n.MAX_DISTANCE, replace=False)] ^= np.uint16(1)
    rows = [(i, 100, s.tobytes()) for i, s in enumerate([*left, *right])]
    frame = n.buckets(spark.createDataFrame(rows, "id long, n_shingles long, signature binary"))
    held = collections.defaultdict(set)
    for row in frame.collect():
        held[row.id].add(row.bucket)
    assert all(len(held[i]) == n.SYMBOLS and held[i] & held[i + 200] for i in range(200))


def test_odd_rows(spark, edge_docs, no_docs):
    rows = n.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[0] == by[1] == by[2] == [(0, by[0][0][1], True)] or [by[i][0] for i in (0, 1, 2)] == [(0, i, True) for i in (0, 1, 2)]
    assert by[3] == [(1, 3, True)] * 2 and by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] and by[None] == [(1, None, True)]
    assert n.near_duplicates(no_docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(1, 5)]
    found = {r.id: r.component for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 1 for i in [1, 5, *range(200, 260)])


def test_query_covers_all_documents(spark):
    from plumbline.llm.queries import op8_near_dup

    assert op8_near_dup(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
