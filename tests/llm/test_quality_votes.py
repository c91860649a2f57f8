"""Figures of the quality rules against brute force, EM on made votes, and the verdicts against labels."""

import collections
import random
import re

from llm_cases import SMALL, words
from pyspark.sql import functions as F

from plumbline.llm import quality_votes as q


def figures(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def got(rows):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


def test_figures_equal_brute_force(spark, small_docs, edge_docs):
    r = random.Random(2)
    made = [(i, " ".join(r.choices("ab c | # \n\n x\ty".split(" "), k=r.randrange(60)))) for i in range(200)]
    for docs in (small_docs, edge_docs, spark.createDataFrame(made, "doc_id long, text string")):
        texts = [row.text for row in docs.select("text").collect()]
        assert got(q.figures(docs).collect()) == [figures(t) for t in texts]


def test_em_finds_accuracies():
    r = random.Random(3)
    right = [(0.97, 0.8), (0.9, 0.6), (0.95, 0.7), (0.85, 0.9), (0.92, 0.75)]
    counts = collections.Counter()
    for _ in range(20_000):
        good = r.random() < 0.75
        votes = []
        for a, b in right:
            correct = r.random() < (a if good else b)
            votes.append(0 if r.random() < 0.2 else 1 if correct == good else -1)
        counts[tuple(votes)] += 1
    fitted = q.fit(list(counts.items()), len(right))
    assert abs(fitted.prior - 0.75) < 0.03
    for i, (a, b) in enumerate(right):
        assert abs(fitted.right_on_good[i] - a) < 0.03 and abs(fitted.right_on_bad[i] - b) < 0.08


def test_verdicts_follow_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = q.quality(docs).select("doc_id", "base_failed", "kept").join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    table = {(r.good, r.kept): r["count"] for r in judged.where("not base_failed").groupBy("good", "kept").count().collect()}
    assert table.get((0, True), 0) == 0 and table.get((1, False), 0) == 0 and table[1, True] > 100


def test_base_rule_and_odd_texts(spark, edge_docs, no_docs):
    rows = q.quality(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.base_failed and not r.kept for r in rows)
    assert q.quality(no_docs).count() == 0
    repeated = spark.createDataFrame([(1, "same three words " * 30), (2, " ".join(f"w{i}" for i in range(60)) + ".")], "doc_id long, text string")
    assert {r.doc_id: r.base_failed for r in q.quality(repeated).collect()} == {1: True, 2: False}


def test_plan_has_no_python(spark):
    plan = q.figures(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
