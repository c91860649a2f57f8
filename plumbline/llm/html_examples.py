"""Labelled pages for the HTML model: layouts made by rule from a seed.

In each, ``data-main="yes"`` marks an element as main content and ``data-main="no"`` as something else; an element
without the mark is as its parent. Words are meaningless, so only structure can be learnt from them.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import per_batch

# Names that sites give to the parts of a page.
NAMES = {
    "nav": ("menu", "navbar", "nav-main", "navigation", "breadcrumbs", "pagination", "top-menu", "site-nav", "toc"),
    "header": ("header", "masthead", "topbar", "site-header", "branding", "page-header", "logo"),
    "ad": ("ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "banner", "promo", "promoted", "adsbygoogle"),
    "notice": ("cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "newsletter", "subscribe", "paywall"),
    "aside": ("sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending", "right-rail", "more-stories"),
    "comments": ("comments", "comment-list", "replies", "discussion", "disqus_thread", "user-comments", "responses", "reader-comments"),
    "social": ("share", "social", "share-bar", "follow-us", "social-links"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"),
    "main": ("content", "post", "entry-content", "article-body", "story", "main", "post-content", "main-text", "article", "page-content"),
}
_PIECES = "ba be bi lo la mi nor ta ter san del gra vi su pon ki rem ost ule ani qua dor és hü".split()
_SIGNS = ("", "", "", "", "!!", "%%%", " |", "###", " &amp;", "&nbsp;&mdash;")


class Layout:
    def __init__(self, number: int) -> None:
        self.r = random.Random(f"layout {number}")

    def words(self, low: int, high: int) -> str:
        noise = self.r.choice(_SIGNS) if self.r.random() < 0.1 else ""
        return " ".join("".join(self.r.choices(_PIECES, k=self.r.randint(1, 4))) + noise for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + "." for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high)))

    def box(self, kind: str, body: str, tags: tuple[str, ...], mark: str = ' data-main="no"') -> str:
        tag = self.r.choice(tags)
        plain = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "main": "main"}.get(kind)
        name = "" if tag in (plain, "article") and self.r.random() < 0.6 else f' {self.r.choice(("class", "id", "class"))}="{self.r.choice(NAMES[kind])}"'
        return f"<{tag}{name}{mark}>{body}</{tag}>"

    def nav(self) -> str:
        return self.box("nav", f"<ul>{self.links(3, 9)}</ul>", ("nav", "nav", "div"))

    def ad(self) -> str:
        body = self.r.choice((self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f'<a href="/x">{self.words(3, 9)}</a>'))
        return self.box("ad", body, ("div", "div", "section", "aside"))

    def notice(self) -> str:
        return self.box("notice", f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>", ("div", "section", "aside"))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 2)}</label><input name=q>" for _ in range(self.r.randint(1, 3)))
        return f'<form action="/s" data-main="no"><p>{self.words(2, 9)}</p>{fields}<button>{self.words(1, 1)}</button></form>'

    def aside(self) -> str:
        body = self.r.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 7)}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 4)}</p>"))
        return self.box("aside", body, ("aside", "aside", "div", "section"))

    def comments(self) -> str:
        one = lambda: self.r.choice(("<div class=comment><b>{}</b><p>{}</p></div>", "<li class='reply'><cite>{}</cite> {}</li>", "<article class=\"comment\"><h4>{}</h4><p>{}</p></article>")).format(self.words(1, 2), self.sentences(1, 5))
        return self.box("comments", f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))), ("section", "div", "ol"))

    def social(self) -> str:
        return self.box("social", f"<ul>{self.links(2, 4)}</ul>", ("div", "div", "section"))

    def footer(self) -> str:
        body = f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}" + self.r.choice(("", f"<ul>{self.links(2, 6)}</ul>", f"<p>{self.words(3, 9)}</p>"))
        return self.box("footer", body, ("footer", "footer", "div"))

    def header(self) -> str:
        return self.box("header", self.r.choice((f'<a href="/">{self.words(1, 3)}</a>', f"<h2>{self.words(1, 3)}</h2><p>{self.words(2, 8)}</p>")), ("header", "header", "div"))

    def paragraph(self) -> str:
        text = self.sentences(1, 8)
        return self.r.choice((
            f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href='/y'>{self.words(1, 4)}</a> {self.sentences(1, 2)}</p>",
            f"<p><em>{self.words(1, 4)}</em> {text}<br>{self.sentences(1, 2)}</p>", f"<blockquote><p>{text}</p></blockquote>",
            f"<ul><li>{self.words(2, 12)}</li><li>{self.words(2, 12)}</li></ul>", f"<h2>{self.words(1, 8)}</h2>", f"<p>{self.words(1, 3)}</p>",
            f"<div>{text}</div>", f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", f"<pre>{text}</pre>",
        ))

    def main(self) -> str:
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if self.r.random() < 0.9 else []
        for _ in range(self.r.randint(1, 12)):
            parts.append(self.paragraph())
            if self.r.random() < 0.08:
                parts.append(self.r.choice((self.ad, self.aside, self.social, self.form, self.notice))())
        body = "".join(parts)
        if self.r.random() < 0.15:
            return f'<div data-main="yes">{body}</div>'
        inner = self.box("main", body, ("article", "article", "main", "div", "div", "section"), ' data-main="yes"')
        return f"<div>{inner}</div>" if self.r.random() < 0.3 else inner

    def bare(self) -> str:
        """A page that is its text, with no element around it and little else."""
        extra = "".join(part() for part in (self.nav, self.ad, self.footer) if self.r.random() < 0.3)
        text = self.r.choice((self.sentences(1, 4), "".join(self.paragraph() for _ in range(self.r.randint(1, 5)))))
        return self.r.choice((f'<body data-main="yes">{text}{extra}', f'<html data-main="yes"><body>{extra}<h1>{self.words(1, 5)}</h1>{text}</body></html>'))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return self.bare()
        some = lambda part, chance: part() if r.random() < chance else ""
        before = [some(self.notice, 0.3), some(self.header, 0.4), some(self.nav, 0.8), some(self.ad, 0.5), some(self.aside, 0.2), some(self.form, 0.2)]
        after = [some(self.social, 0.2), some(self.comments, 0.4), some(self.aside, 0.4), some(self.ad, 0.3), some(self.form, 0.2), some(self.notice, 0.1)]
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join([*before, self.main(), *after])
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{middle}</div>'
        title, style = self.words(2, 8), r.choice(("", "<style>p{margin:0}</style>", "<script>var t='</p>';</script>"))
        return f'<!DOCTYPE html><html lang="en"><head><title>{title}</title>{style}</head><body data-main="no">{middle}{some(self.footer, 0.8)}</body></html>'


def labelled_pages(spark: SparkSession, count: int = 400) -> DataFrame:
    """``html`` of ``count`` labelled pages."""
    return map_numbers(spark.range(count, numPartitions=4), lambda number: Layout(number).page())


def map_numbers(numbers: DataFrame, make: Callable[[int], str]) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        return {"html": [make(n) for n in batch.column(0).to_pylist()]}

    return per_batch(numbers, "html string", work)
