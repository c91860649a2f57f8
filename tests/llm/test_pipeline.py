"""The corpus pipeline: every stage against its operator's brute force, on documents with planted cases."""

import random

import pytest
from llm_cases import EDGES, SMALL
from test_near_dup import brute
from test_quality_votes import figures

import corpus_pipeline as p
from plumbline.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The table before the first and after each stage, and the planted ids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    first = docs.orderBy("doc_id").where("length(text) between 1500 and 3000").limit(3).collect()
    clean = " ".join(reversed(first[2].text.split(" ")))
    near = clean.split(" ")
    near[len(near) // 2] = "other"
    planted = [
        (9001, clean), (9002, clean), (9003, " ".join(near)), (9004, first[0].text + " " + item), (9005, "WORD!! " * 80), (9006, "1 2 3 " * 40),
        (9007, first[1].text), (9007, first[1].text),
    ] + [(9100 + i, t) for i, t in enumerate(EDGES)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", 0) for i, t in planted], docs.schema))
    tables = [rows]
    for _, stage in p.STAGES:
        tables.append(p.materialise(stage(spark, tables[-1], SMALL), "stage"))
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for table in stages[:-1]:
        assert table.columns == COLUMNS
    assert stages[-1].columns == [*COLUMNS, "token_ids"]
    for before, after in zip(stages, stages[1:]):
        assert set(map(tuple, after.select(COLUMNS).collect())) <= set(map(tuple, before.select(COLUMNS).collect()))


def test_quality_stage(stages):
    kept = set(ids(stages[1]))
    for row in stages[0].collect():
        n, _, _, _, repeated = figures(row.text)
        if n < 50 or 2 * repeated > n:
            assert row.doc_id not in kept
    assert 9005 not in kept and 9006 not in kept and {9001, 9002, 9003, 9004, 9007} <= kept


def test_language_stage_keeps_clean_documents(stages):
    assert ids(stages[2]) == ids(stages[1])


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(1)
    italian = (
        "il presidente della repubblica ha detto che non vuole parlare con gli altri ministri perché questa sera saranno tutti insieme nella città"
        " di roma e poi torneranno a casa loro senza dire niente a nessuno di quello che hanno deciso durante la lunga riunione"
    ).split()
    planted = [(900_000 + i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) for _ in range(150)), "en") for i in range(3)]
    planted += [(900_010 + i, " ".join(r.choices(italian, k=120)), None) for i in range(3)]
    planted += [(900_020, "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)), None), (900_021, "the " + " ".join("щзй" * 3 for _ in range(90)), None)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, lang, "planted", 0) for i, t, lang in planted], docs.schema))
    kept = set(ids(p.language(spark, rows, SMALL)))
    assert not kept & {i for i, _, _ in planted}
    letters = {d.doc_id for d in docs.collect() if any(map(str.isalpha, d.text or ""))}
    assert kept == letters


def test_near_duplicate_stage(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    want = brute(list(before.items()), 5, 80)
    assert ids(stages[3]) == sorted(i for i, (_, _, kept) in want.items() if kept)
    assert 9001 in ids(stages[3]) and not {9002, 9003} & set(ids(stages[3]))


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[3].collect() if any(i in r.text for i in items)}
    assert ids(stages[4]) == sorted(set(ids(stages[3])) - held) and 9004 not in ids(stages[4])


def test_tokens_decode_to_the_texts(stages):
    codec = bpe.codec(bpe.RANKS)
    rows = stages[5].collect()
    assert ids(stages[5]) == ids(stages[4]) and all(codec.decode(r.token_ids).decode() == r.text for r in rows)


def test_run_and_empty_table(spark, stages):
    assert [name for name, _ in p.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "token_ids"]
    assert p.run(spark, SMALL).count() > 50
    docs = stages[0].limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_each_row_is_judged_by_itself(spark):
    """A good row stays beside a bad one of the same id, and a bad row without id goes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    good = p.quality_rules(spark, docs, SMALL).where("length(text) > 1500").orderBy("doc_id").first().text
    r = random.Random(3)
    noise = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) for _ in range(150))
    for stage, bad in ((p.quality_rules, "WORD!! " * 80), (p.language, noise), (p.decontamination, good + " " + item)):
        rows = [(7001, good), (7001, bad), (None, good), (None, bad)]
        marked = docs.where("doc_id < 7000").unionByName(spark.createDataFrame([(i, t, None, "planted", 0) for i, t in rows], docs.schema))
        kept = [(x.doc_id, x.text) for x in stage(spark, marked, SMALL).where("source = 'planted'").collect()]
        assert sorted(kept, key=str) == sorted([(7001, good), (None, good)], key=str)


def test_columns_of_any_name_pass_the_filters(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "doc_id AS n_words", "lang AS row", "1.5D AS `a.b`", "array(source) AS kept")
    for stage in (p.quality_rules, p.language, p.decontamination):
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns and after.count() > 50
