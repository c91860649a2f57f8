"""The trie of conversations against a plain one, with small shards, long conversations and hot groups."""

import hashlib
import random
import zlib

import pytest
from llm_cases import SMALL

from plumbline.llm import conversation_trie as c
from plumbline.llm import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, conv int, n_convs long"


def brute(rows):
    turns = {}
    for i, t, role, text in rows:
        if i is not None:
            r, x = role or "", text or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
            turns.setdefault(i, []).append((t is not None, t, digest, r, x))
    own = {i: [v[3:] for v in sorted(ts, key=lambda v: (v[0], v[1] or 0, v[2]))] for i, ts in turns.items()}
    made = {}
    for i, ts in own.items():
        h = zlib.crc32(str(i).encode()) % 6
        base = i - (i % 100 if i >= 0 else -(-i % 100))
        made[i] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for i, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(i)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] += not kids[path]
        saved[path] += (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
        if path:
            kids[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(i) for i in sorted(members) if len(made[i]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    frame.repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r[k] for k in COLUMNS) for r in queries.op13_conversation_trie(spark, folder).collect()), key=str)


def crowd(seed, n=260):
    r = random.Random(seed)
    opening = [("system", "Be brief."), ("user", "hello"), ("assistant", "hi 🙂")]
    rows = []
    for i in range(-40, n):
        kind = r.randrange(5)
        if kind < 2:
            ts = opening[: r.randrange(1, 4)] + [("user", f"q{r.randrange(4)}"), ("assistant", f"a{r.randrange(3)}")] * r.randrange(0, 4)
        elif kind == 2:
            ts = [("user", "same"), ("assistant", "same")] * 4
        else:
            ts = [(r.choice(["user", "assistant", None]), r.choice(["x", "", None, "longer text"])) for _ in range(r.randrange(1, 9))]
        rows += [(i * r.choice([1, 1, 1, 3]), t, *v) for t, v in enumerate(ts)]
    rows += [(None, 0, "user", "no id"), (7, None, "user", "null turn"), (7, None, "user", "null turn"), (8, 1, "b", "tie"), (8, 1, "a", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, shard, ranged, ids", [(64, 50_000, 500_000, 10_000), (3, 20, 50, 4), (1, 7, 9, 1)])
def test_conversations(spark, monkeypatch, tmp_path, segment, shard, ranged, ids):
    for name, value in (("SEGMENT", segment), ("SHARD", shard), ("RANGE_ROWS", ranged), ("IDS", ids), ("STRIDE", 2)):
        monkeypatch.setattr(c, name, value)
    rows = crowd(segment)
    assert got(spark, rows, tmp_path) == brute(rows)


def test_long_conversations(spark, monkeypatch, tmp_path):
    """A conversation that holds most of all rows, a copy of it that parts late, and rows equal in everything."""
    for name, value in (("SHARD", 300), ("RANGE_ROWS", 400), ("STRIDE", 4)):
        monkeypatch.setattr(c, name, value)
    rows = [(i, t, "user", f"turn {t % 50}") for i in (200, 201, 202) for t in range(1_500 - 300 * (i == 202))]
    rows += [(201, 1_500, "user", "own end")] + [(203, 0, "user", "again")] * 700 + [(i, 0, "user", "hello") for i in range(300, 330)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    assert got(spark, [(None, 1, "user", "x")], tmp_path) == []
    rows = [(-7, 0, None, None), (5, 0, "a", "b"), (2**63 - 1, 3, "user", "x"), (-(2**63), 1, "user", "y")]
    assert got(spark, rows, tmp_path / "more") == brute(rows)


def test_sibling_trees_are_balanced():
    tree = c.Tree()
    for code in c.medians(1_023):
        tree.child(0, code)

    def depth(node):
        return 1 + max(depth(tree.left[node]), depth(tree.right[node])) if node else 0

    assert depth(tree.first[0]) == 10
