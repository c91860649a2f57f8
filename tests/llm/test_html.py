"""HTML extraction: reading of broken markup, exact marginals, and labelled pages that the fit has not seen."""

import html
import itertools
import math
import re
import time

import numpy as np
import pytest
from llm_cases import SMALL

from plumbline.llm import html_examples
from plumbline.llm import html_text as h


@pytest.fixture(scope="module")
def model():
    return h.fit([html_examples.Layout(i).page() for i in range(300)])


def whole(source):
    return " ".join(" ".join("".join(v for _, v in block).split()) for block in h.read(source).blocks).split()


@pytest.mark.parametrize("source, words", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("a<b>c</i>d</b>e", "acde"), ("<ul><li>a<li>b</ul>c", "a b c"), ("x < y & z &amp &lt;b&gt; &eacute;&#233;", "x < y & z & <b> éé"),
    ("<script>if (a < b) '</p>'</script>t", "t"), ("<style>p{}", ""), ("<title>no</title>yes", "yes"), ("a<!-- b --><!-- c", "a"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<p title='a > b'>c", "c"), ("<p title='a>b", "b"), ("<div", ""), ("</div></p>a", "a"), ("a<br>b<br/>c", "a b c"), ("<select><option>a</select>b", "b"), ("a  b\n\tc", "a b c"),
])
def test_reading(source, words):
    assert whole(source) == words.split()


def test_marginals_equal_enumeration(model):
    page = h.read("<nav><a>x</a></nav><div><p>One two three.</p><div class=ad>Buy</div></div><footer>End</footer>")
    n = len(page.nodes)
    own = np.clip(h.features(page) @ model.weights, -12, 12)
    total, yes = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        score = states[0] * model.root + sum(own[i] for i in range(n) if states[i])
        score += sum(model.edges[h.names_a_role(page.nodes[i]), states[page.nodes[i].parent], states[i]] for i in range(1, n))
        total += math.exp(score)
        yes += math.exp(score) * np.array(states)
    assert np.allclose(model.marginals(page), yes / total)


def test_labelled_pages_that_the_fit_has_not_seen(model):
    exact = 0
    for i in range(5000, 5200):
        source = html_examples.Layout(i).page()
        page = h.read(source)
        main = h.labels(page)
        blocks = (" ".join("".join(v for o, v in block if main[o]).split()) for block in page.blocks)
        exact += " ".join(b for b in blocks if b) == model.text(source)
    assert exact >= 180


def test_pages_equal_their_articles(spark, model):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = h.extract(pages, html_examples.labelled_pages(spark, 200)).collect()
    assert len(rows) == pages.count()
    sources = {r.page_id: r.html for r in pages.collect()}
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", sources[row.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article))
        assert row.text == " ".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "u", "", "y"), (3, "u", "just text", None), (None, "u", "<p>" * 3000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    labelled = html_examples.labelled_pages(spark, 60)
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in h.extract(pages, labelled).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "", 0), (3, "just text", 9)]
    assert h.extract(pages.limit(0), labelled).count() == 0


@pytest.mark.parametrize("source, words", [
    ("<html><head><title>x</title><article>a b</article>", "a b"), ("<head><meta charset=u><p>a<p>b", "a b"), ("<head><title>x</title>a<b>b</b>", "ab"),
    ("<head><template><div>no</div></template><noscript>no</noscript><img src=x>a", "a"), ("<head> <style>p{}</style> </head>a", "a"), ("<head><script>1</script><body>a", "a"),
    ("<p>a <math><mi>x</mi></math> b", "a x b"), ("<p>a <noscript>b</noscript> <object>c</object> <audio>d</audio> <video>e</video> <canvas>f</canvas>", "a b c d e f"),
    ("<p>a<svg><text>no</text></svg><template>no</template> <button>no</button>b", "a b"),
])
def test_left_out_tags_and_fallbacks_lose_no_text(source, words):
    assert whole(source) == words.split()


@pytest.mark.parametrize("tag", ["div", "span", "button", "table", "ul", "template", "p"])
def test_any_depth_of_nesting_is_read_in_time(tag):
    depth = 40_000
    begin = time.monotonic()
    page = h.read("<p>a" + f"<{tag}>" * depth + "b" + "<li>c<b>d</i></p>" * 1000 + f"</{tag}>" * depth)
    assert time.monotonic() - begin < 20 and page.blocks


def test_a_long_page_is_read_whole(model):
    words = " ".join(f"word{i}, and more." for i in range(40_000))
    assert model.text(f"<body><article><p>{words}</p></article></body>") == words


def test_article_behind_an_open_head(model):
    text = "One two three four five six seven. Eight nine ten, eleven twelve thirteen."
    assert model.text(f"<html><head><title>x</title><article><p>{text}</p></article>") == text
