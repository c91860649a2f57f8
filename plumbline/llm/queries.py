"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, chat, conversation_trie, decontaminate, hard_negatives, html_examples, html_text, jaccard_join, language_id, near_dup, quality_votes, token_counts, url_examples, url_filter, warc,
)
from plumbline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Fixed values of the queries.
URL_RULES = [
    url_filter.UrlRule("net/", False), url_filter.UrlRule("example.net/en/", True),
    url_filter.UrlRule("example.com/de/", False), url_filter.UrlRule("org/fr/", True),
]
# Unwanted hosts of the given pages, for tests; nothing is learnt from them.
KNOWN_UNWANTED = r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\."
EXTRA_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_votes.quality(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select(*columns)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES, url_examples.labelled_urls(spark))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    return chat.digests(chat.read_back(chat.windows(rows)))


@query
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.with_language(documents, documents)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture times; a page's id, in seconds from a fixed day and within about 31 years, stands for one.
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    index = warc.archive(table(spark, sf_dir, "pages"), time)
    return index.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        "url_key", "time", "position",
    )



@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_examples.labelled_pages(spark))


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


SQL["op12_jaccard_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
first_of AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sets WHERE len(s) > 0),
reps AS (SELECT m.* FROM members m WHERE m.doc_id IN (SELECT rep FROM first_of)),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM reps a JOIN reps b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT DISTINCT rep AS x, rep AS y FROM first_of UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN first_of f ON f.doc_id = s.doc_id LEFT JOIN component c ON c.x = f.rep
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Labels of every seventh row are changed first, as the query's contract asks.
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")).alias("label"),
    )
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, scale=256.0)


SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    # The contract's rebuilding: every hundredth conversation lends its first turns.
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    rebuilt = conversation_trie.rebuilt(turns, F.col("conv") - F.col("conv") % 100, head, 6)
    return conversation_trie.with_digests(*conversation_trie.prefix_trie(*rebuilt))


_CRC_STEP = "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))"
SQL["op13_conversation_trie"] = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda acc, b: {_CRC_STEP})) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i < c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i >= c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, length(text) AS chars,
         sha256(length(role) || ':' || role || text) AS turn FROM rebuilt),
paths AS (
  SELECT conv_id, d, chars, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
node AS (
  SELECT p.path, p.d, min(p.conv_id) AS conv_id, count(*) AS n, any_value(p.chars) AS chars,
         string_agg(CASE WHEN l.len = p.d THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id) AS ends
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.path, p.d),
child AS (SELECT left(path, CAST(64 * (d - 1) AS BIGINT)) AS up, * FROM node WHERE d > 0),
kids AS (SELECT up, count(*) AS k FROM child GROUP BY up),
-- Every node with all of its ancestors and itself.
above AS (SELECT n.path, n.d, n.n, n.chars, a AS lvl, k.k FROM node n LEFT JOIN kids k ON k.up = n.path, unnest(range(0, n.d + 1)) t(a)),
sums AS (
  SELECT left(path, CAST(64 * lvl AS BIGINT)) AS path, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n - 1) * chars) AS BIGINT) AS saved
  FROM above GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN sums s USING (path) LEFT JOIN kids k ON k.up = n.path LEFT JOIN node p ON n.d > 0 AND p.path = left(n.path, CAST(64 * (n.d - 1) AS BIGINT))
"""
