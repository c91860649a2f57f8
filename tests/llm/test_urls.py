"""URL rules against brute force, and the trees on labelled URLs."""

import re

from llm_cases import SMALL
from pyspark.sql import functions as F

from plumbline.llm import url_examples
from plumbline.llm import url_filter as u
from plumbline.llm.queries import KNOWN_UNWANTED, URL_RULES, op5_url_filter

ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x", "https://example.com/de/1?x=/fr/", "https://notexample.com/de/1", "https://example.com/de",
    "ftp://x.org/fr/#a", "http://net/", "http://net", "http://a.net?x/", "http://ÄB.org/fr/é", "http://example.net/EN/", "http://u@h:80/p", "a://b://c/d", "http://x.org//fr/",
]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(url):
    host, path = parts(url)
    fits = [r for r in URL_RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*r.pattern.split("/", 1))]
    return max(fits, key=lambda r: len(r.pattern), default=None)


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, url, "x") for i, url in enumerate([*ODD, ODD[5]])], "page_id long, url string, host string")
    pages = pages.union(spark.read.parquet(f"{SMALL}/pages.parquet").select(F.col("page_id") + 1000, "url", F.lit("y")))
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = u.filter_urls(pages, URL_RULES, pages.select("url", F.lit(True).alias("blocked"))).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule = rule_of(urls[r.page_id])
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == (rule.pattern if rule else None)
        assert r.verdict == ("allow" if rule is None or rule.allow else "block")  # nothing could be learnt


def test_unwanted_hosts_are_found(spark):
    rows = op5_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").collect()
    for r in rows:
        assert (r.verdict == "block") == bool(re.search(KNOWN_UNWANTED, r.host))
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_unwanted_hosts_outside_the_sample_are_found(spark):
    """Hosts of one name are left out of training and still blocked, by their look."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, _ = u.host_and_path(F.col("url"))
    labelled = pages.select("url", host.rlike(KNOWN_UNWANTED).alias("blocked"), host.contains("free-bets").alias("hidden"))
    model = u.fit_urls(labelled.where("not hidden").drop("hidden"))
    scored = model.score(u.lexical(labelled.where("hidden"), "url"))
    assert scored.where("blocked_score >= 0.5").count() >= 0.9 * scored.count() > 0


def test_sample_is_bounded(spark):
    labelled = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/")).alias("url"), (F.col("id") % 3 == 0).alias("blocked"))
    model = u.fit_urls(labelled, rows=300)
    assert 150 < model.trees.transform(u.lexical(labelled.withColumn("host", F.lit("")), "url").withColumn("suffix_blocked", F.lit(0.1))).count() <= 3000
    assert abs(model.overall - 0.5) < 0.1


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(pages, URL_RULES, pages.select("url", F.lit(True).alias("blocked"))).count() == 0


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd",)], "t string").select(u.entropy(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 1.0, 2.0]


def test_verdicts_do_not_depend_on_the_names_in_the_table(spark):
    """A table with none of the given unwanted hosts is judged all the same."""
    unwanted = [
        "http://poker-vip.example.com/en/12", "https://www.payday-loans24.info/", "http://xxx-tube.example.org/a?b=1", "https://m.viagra-shop.example.net/es/9.html",
        "http://best-lottery.top/de/1#top", "http://roulette-live77.xyz/", "https://nude-webcams.example.net/fr/5/",
    ]
    ordinary = [
        "http://lorand.example.com/en/12", "https://www.stadtwerk.info/", "http://blog.minor.example.org/a?b=1", "https://m.velo-shop.example.net/es/9.html",
        "http://essex.example.com/en/77", "https://paper.example.org/casino/12", "http://www.terrabit.example.net/fr/4163",
    ]
    pages = spark.createDataFrame(list(enumerate([*unwanted, *ordinary])), "page_id long, url string")
    rows = u.filter_urls(pages, URL_RULES[1:2], url_examples.labelled_urls(spark)).collect()
    assert {r.page_id: r.verdict for r in rows} == {i: "block" if i < len(unwanted) else "allow" for i in range(len(rows))}


def test_made_urls_the_fit_has_not_seen(spark):
    made = url_examples.labelled_urls(spark, 10_000)
    assert made.where("blocked").count() == 5_000
    kept = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = u.fit_urls(made.where(~kept))
    rest = model.score(u.lexical(made.where(kept), "url"))
    assert rest.where((F.col("blocked_score") >= 0.5) == F.col("blocked")).count() >= 0.96 * rest.count() > 1_000


def test_no_rules(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    pattern, allow = u.first_rule([], *u.host_and_path(F.col("url")))
    assert [tuple(r) for r in frame.select(pattern, allow).collect()] == [(None, None)] * 2
