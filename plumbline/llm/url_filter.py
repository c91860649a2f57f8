"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs (``url``, ``blocked``), of which a bounded sample is used. Features: length,
path depth, share of digits, entropy of the characters, number of parameters, labels, hyphens and generic unwanted
words of the host, and the share of blocked URLs among labelled ones with the same suffix.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; it is judged by
the trees like any other. Repeated rows each get a row. Without labelled URLs of both kinds nothing can be learnt
and every URL that no rule fits is allowed. An empty table gives an empty table. Only the id and the URL are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import narrow
from plumbline.session import materialise

SAMPLE_ROWS = 20_000  # labelled URLs that are used, about
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "unwanted", "suffix_blocked"]
# Fixed value: generic words of unwanted hosts. The longer ones count inside other words too.
UNWANTED = (
    "ad ads adult advert bet bets betting bonus casino clicks crack dating escort escorts gambling hack jackpot keygen loan loans lottery malware nude"
    " payday phishing pharmacy pill pills poker popunder porn replica roulette scam sex slots spam spyware torrent tracker viagra warez webcams xxx"
).split()
_WHOLE = "|".join(w for w in UNWANTED if len(w) < 5)
_INSIDE = "|".join(w for w in UNWANTED if len(w) >= 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host and a path, such as ``example.net/en/``; subdomains of the host are meant too."""

    pattern: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def first_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern of the longest rule that fits, and whether it allows; null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r.pattern))
    pattern = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.pattern)) for r in ordered], F.lit(None).cast("string"))
    allow = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.allow)) for r in ordered], F.lit(None).cast("boolean"))
    return pattern, allow


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)

    def term(c: Column) -> Column:
        p = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return p * F.log2(p)

    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(size > 0, -F.aggregate(distinct, F.lit(0.0), lambda a, c: a + term(c))).otherwise(0.0)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` and the lexical features."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    size = F.greatest(F.length(whole), F.lit(1))
    return urls.withColumns({"host": host, "path": path}).withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "length": F.length(whole).cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]+", "")).cast("double"),
        "digits": F.length(F.regexp_replace(whole, "[^0-9]+", "")) / size,
        "entropy": entropy(whole),
        "parameters": F.length(F.regexp_replace(F.regexp_extract(whole, r"\?([^#]*)", 1), "[^=]+", "")).cast("double"),
        "labels": F.length(F.regexp_replace("host", "[^.]+", "")).cast("double"),
        "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")).cast("double"),
        "unwanted": F.regexp_count("host", F.lit(f"(?<![a-z])({_WHOLE})(?![a-z])|{_INSIDE}")).cast("double"),
    })


@dataclass
class UrlModel:
    """Suffix shares (at most one row for each sampled URL) and the trees over them."""

    suffixes: DataFrame
    overall: float
    trees: object

    def score(self, featured: DataFrame) -> DataFrame:
        known = featured.join(F.broadcast(self.suffixes), "suffix", "left").fillna({"suffix_blocked": self.overall})
        return self.trees.transform(known).withColumn("blocked_score", vector_to_array("probability")[1])


def fit_urls(labelled: DataFrame, url: str = "url", blocked: str = "blocked", rows: int = SAMPLE_ROWS, seed: int = 11) -> UrlModel | None:
    """Trees from about ``rows`` labelled URLs, as many of either kind at most; None if one kind is missing.

    Rows are chosen by a hash of the URL, so that the sample spreads over the table and stays the same.
    """
    given = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("label")).where("url is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    # Rows of one URL stand or fall together; a repeated URL is weighed once.
    spread = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1_000_000))
    part = F.when(F.col("label") == 1, min(1.0, rows / 2 / sizes[1])).otherwise(min(1.0, rows / 2 / sizes[0]))
    sample = given.where(spread < 1_000_000 * part).groupBy("url").agg(F.max("label").alias("label"))
    sample = materialise(lexical(sample, "url"), "labelled_urls")
    overall = sample.agg(F.avg("label")).first()[0]
    if overall is None:
        return None
    # Shares are drawn towards the overall share, as if ten more URLs had it.
    suffixes = sample.groupBy("suffix").agg(((F.sum("label") + 10 * overall) / (F.count("*") + 10)).alias("suffix_blocked"))
    model = UrlModel(suffixes, overall, None)
    trees = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=seed, featuresCol="features", labelCol="label"),
    ])
    train = sample.join(F.broadcast(suffixes), "suffix")
    model.trees = trees.fit(train)
    return model


def filter_urls(
    pages: DataFrame, rules: list[UrlRule], labelled: DataFrame, key: str = "page_id", url: str = "url", block_from: float = 0.5
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (the longest that fits), ``verdict`` (allow or block), ``blocked_score``."""
    model = fit_urls(labelled)
    featured = lexical(narrow(pages, key, url), url)
    scored = model.score(featured) if model else featured.withColumn("blocked_score", F.lit(0.0))
    pattern, allow = first_rule(rules, F.col("host"), F.col("path"))
    allowed = F.coalesce(allow, F.col("blocked_score") < block_from)
    return scored.select(
        key, "host", "path", pattern.alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), "blocked_score"
    )
