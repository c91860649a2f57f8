"""Labelled URLs for the URL filter: ordinary and unwanted shapes, made by rule from a row's number.

Names are meaningless syllables, with a generic unwanted word in most unwanted hosts; the others are told by their
shape: hyphens, digits, length. Both kinds have the same paths and parameters. No table is read. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.url_filter import UNWANTED

_PIECES = "ba be bi lo la mi nor ta ter san del gra vi su pon ki rem ost ule ani qua dor es hu the tion er an in st re".split()
_COMPANY = "best top free win live online cheap hot club real super go my".split()


def _number(name: str, below: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(name)), F.lit(below)).cast("int")


def _one(name: str, values: list[str]) -> Column:
    return F.get(F.lit(values), _number(name, len(values)))


def _chance(name: str, percent: int) -> Column:
    return _number(name, 100) < percent


def _word(name: str) -> Column:
    parts = [_one(f"{name} {k}", _PIECES) for k in range(4)]
    return F.concat(*parts[:2], *[F.when(_number(f"{name} size", 3) >= k - 1, parts[k]).otherwise("") for k in (2, 3)])


def _some(name: str, percent: int, value: Column) -> Column:
    return F.when(_chance(name, percent), value).otherwise("")


def labelled_urls(spark: SparkSession, count: int = 8_000) -> DataFrame:
    """``url`` and ``blocked`` of ``count`` URLs, half of them unwanted."""
    digits = lambda name, most: _number(name, most).cast("string")
    bad, mark = _one("bad", UNWANTED), F.when(_chance("mark", 65), "-").otherwise("")
    named = F.when(_chance("order", 50), F.concat(bad, mark, _one("company", _COMPANY))).otherwise(F.concat(_one("company", _COMPANY), F.lit("-"), bad))
    named = F.when(_chance("made up", 25), F.concat(bad, F.lit("-"), _word("beside"))).otherwise(named)
    shaped = F.concat(_word("s1"), F.lit("-"), digits("s2", 100_000), F.lit("-"), _word("s3"), F.lit("-"), _word("s4"), digits("s5", 1_000))
    unwanted = F.when(_chance("named", 90), F.concat(named, _some("tail", 20, digits("tail n", 1_000)))).otherwise(shaped)
    ordinary = F.concat(_word("n1"), _some("n2", 15, F.concat(F.lit("-"), _word("n3"))), _some("n4", 4, digits("n5", 100)))
    blocked = F.col("id") % 2 == 1
    host = F.concat(
        _some("sub", 55, F.concat(_one("sub name", ["www", "www", "m", "blog", "shop", "news"]), F.lit("."))), F.when(blocked, unwanted).otherwise(ordinary),
        _some("under", 40, F.concat(F.lit("."), _word("domain"))),
        F.lit("."), F.when(blocked & _chance("tld", 25), _one("cheap", ["xyz", "top", "click", "info"])).otherwise(_one("suffix", ["com", "com", "net", "org", "de", "fr", "io", "info"])),
    )
    path = F.concat(
        F.lit("/"), _some("lang", 60, F.concat(_one("language", ["en", "de", "fr", "es", "news", "a"]), F.lit("/"))),
        # A page may write about what is unwanted.
        _some("about", 6, F.concat(_one("topic", UNWANTED), F.lit("/"))), _some("slug", 25, F.concat(_word("p1"), F.lit("-"), _word("p2"), F.lit("/"))),
        _some("page", 80, digits("page n", 10_000)), _one("end", ["", "/", ".html", "?utm_source=feed", "?page=2&ref=x", "#top"]),
    )
    return spark.range(count).select(F.concat(_one("scheme", ["http://", "https://"]), host, path).alias("url"), blocked.alias("blocked"))
