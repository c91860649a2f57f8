"""The corpus pipeline: documents go through five stages, each a table that the next one reads.

Rejected and repeated documents go; what stays has the columns of ``documents``, and its token ids at the end.
Quality, language and decontamination judge each row by its own text, in the pass that filters; only near-duplicates go by id, so
rows without id stay there and rows that repeat an id are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, language_id, near_dup, quality_votes
from plumbline.llm.near_dup import sized
from plumbline.session import materialise
from plumbline.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``; those without id stay."""
    return docs.join(sized(ids.select("doc_id").where("doc_id is not null").distinct()), "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rule or are of low quality by the posterior of the votes."""
    return quality_votes.good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or are in no language of the corpus. Filters are learnt from ``docs``."""
    return language_id.familiar(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles (five words, similarity 0.8) the one of the smallest id stays, once."""
    judged = materialise(near_dup.near_duplicates(docs), "judged")
    kept = without(docs, judged.where(~F.col("kept")).select("doc_id"))
    # Rows that repeat an id are one document. Only they are shuffled.
    repeated = sized(judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return without(kept, repeated).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item, exact or with a few edits."""
    return decontaminate.unleaked(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids``, from which decoding gives the text's bytes again."""
    return bpe.with_token_ids(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", tokens),
]

# EM, learnt filters, components and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
