"""Language identification: held-out accuracy, false positives and odd texts."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import language_id as lid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lid.with_language(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumns({"lang": F.when(lid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    assert sorted(map(tuple, lid.with_language(docs, docs).collect())) == sorted(map(tuple, lid.with_language(other, other).collect()))


def test_counts_are_corrected_for_false_positives():
    r = np.random.default_rng(1)
    known = r.integers(0, 2**40, 150_000, np.uint64)
    filters = lid.Filters.build(["a", "b"], known, np.ones(len(known), np.uint64), "a")
    assert (filters.lookup(known) & 1).all()
    unknown = r.integers(2**41, 2**42, 100_000, np.uint64)
    assert abs((filters.lookup(unknown) & 1).mean() - filters.wrong[0]) < 0.01 and filters.wrong[1] == 0


def test_blocks_do_not_change_counts(monkeypatch):
    values = [lid.plain(t) for t in ("the one and the other", "", "le un et le deux", "x" * 50)]
    grams = np.unique(np.concatenate([lid.ngrams(np.frombuffer(values[0], np.uint8), s) for s in lid.SIZES]))
    filters = lid.Filters.build(["a", "b"], grams, np.ones(len(grams), np.uint64), "a")
    whole = filters.counts(values)
    monkeypatch.setattr(lid, "BLOCK_BYTES", 3)
    assert np.allclose(whole, filters.counts(values)) and whole[0].argmax() == 0


def test_odd_texts(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = lid.fit(docs)
    extra = spark.createDataFrame([(90, "123 !!"), (91, "¿¡ 4"), (92, "日本語"), (93, "ß")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.predict(edge_docs.select("doc_id", "text").union(extra), filters).collect()}
    assert [got[i] for i in (0, 1, 2, 90, 91)] == [("und", 0.0)] * 5
    assert got[92][0] in filters.languages and got[93][0] in filters.languages
    assert lid.with_language(no_docs, docs).count() == 0
    assert {r.lang_pred for r in lid.with_language(docs, no_docs).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    """Each language has five characters of its own; all languages are learnt."""
    count, r = 150, random.Random(1)
    text = lambda lang: "".join(r.choices([chr(0x4E00 + 5 * lang + k) for k in range(5)], k=40))
    rows = [(lang * 10 + i, f"l{lang:03}", text(lang)) for lang in range(count) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = lid.fit(docs)
    assert len(filters.languages) == count and filters.sliced.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in lid.predict(docs, filters).collect()}
    assert all(got[i] == lang for i, lang, _ in rows)


def test_texts_that_are_repeated_often_are_learnt(spark):
    """Languages of one text each, many times: none is lost, and the sample stays bounded."""
    said = {"aa": "abba babab baba abab", "bb": "kolo moro toro soro", "cc": "xyz zyx yxz zxy", "dd": "ünü öpö ätä üpü", "ee": "qu qua que qui"}
    rows = [(i, t, lang) for lang, t in said.items() for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen, languages = lid.training_rows(docs, "lang", "text", 10)
    assert languages == sorted(said) and chosen.count() == len(said)
    filters = lid.fit(docs, sample=10)
    found = {(r["text"], r["lang_pred"]) for r in docs.join(lid.predict(docs.select("doc_id", "text").dropDuplicates(["text"]), filters), "doc_id").select("text", "lang_pred").collect()}
    assert {p for _, p in found} == set(said)


def test_every_text_is_learnt_from(spark):
    """4,000 texts of one language: all are training rows, and what few more than one in a hundred of them hold is learnt."""
    rows = [(4 * i, f"walo {i} mira" + (" zukzuk" if i % 80 == 0 else ""), "aa") for i in range(4_000)] + [(-1, "walo 1 mira", "aa"), (-3, "ete ite", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen, languages = lid.training_rows(docs, "lang", "text")
    assert languages == ["aa", "bb"] and chosen.count() == 4_001
    grams = {(r.lang, r.gram): r.n for r in lid.gram_documents(chosen).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()}
    gram = int(lid.ngrams(np.frombuffer(b"zuk", np.uint8), 3)[0])
    assert grams["aa", gram] == 50
    assert (lid.fit(docs).lookup(np.array([gram], np.uint64)) & 1).all()
