import html
import re

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import html_text
from pixelmill.llm.common import table
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def nodes(spark):
    return html_text.tree_nodes(html_text.fit_tree(html_text.labelled_blocks(spark)))


def _text(spark, nodes, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r["page_id"]: r for r in html_text.main_text(rows, nodes).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[i]["text"] for i in range(len(pages))]


def test_unseen_labelled_pages(spark, nodes):
    rows = html_text.labelled_blocks(spark, 600, seed=1234)
    judged = rows.select("label", html_text.decided(nodes, {k: F.col(k) for k in html_text.FEATURES}).cast("double").alias("p"))
    wrong, n = judged.agg(F.sum((F.col("p") != F.col("label")).cast("int")), F.count(F.lit(1))).first()
    assert n > 5000 and wrong / n < 0.01


def test_expression_equals_the_fitted_model(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = html_text.labelled_blocks(spark, 120, seed=5)
    model = html_text.fit_tree(rows)
    nodes = html_text.tree_nodes(model)
    both = model.transform(VectorAssembler(inputCols=html_text.FEATURES, outputCol="features").transform(html_text.labelled_blocks(spark, 120, seed=6)))
    assert both.where(F.col("prediction") != html_text.decided(nodes, {k: F.col(k) for k in html_text.FEATURES}).cast("double")).count() == 0


def test_given_pages_keep_their_articles(spark, nodes):
    """The given tables have one template, so their articles can be cut out by a pattern."""
    pages = table(spark, SF_SMALL, "pages")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages, nodes).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0].strip("</>") == "b" else " ", article)
        assert got[r["page_id"]] == " ".join(html.unescape(plain).split())


LONG = " ".join(f"word{i}" for i in range(60))
LAYOUT = f"""<!doctype html><html><head><title>No</title><meta name=x><style>p {{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body class="home has-sidebar"><div id="page" class="site"><header class="site-header"><a href="/">Site</a><p>A line about the site</p></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies so that all of this works as it should, and more.</p><button>Yes</button></div>
<main><article class="post has-comments"><header class="entry-header"><h1>A  title</h1></header>
<p>{LONG} <a href="x">linked words</a> and <b>bo</b>ld&nbsp;&amp;&#233;&#x41;&hellip;
<p>Ok.</p><div class="ad-slot">Buy this now, it is cheap and good for you.</div><!-- <p>no</p> -->
<ul><li>first<li>second</ul><table><tr><td>a<td>b</table><pre>x   y</pre>
<form><label>Mail</label><input><p>Write to us whenever you would like to do so.</p></form><p>Ende</p></article></main>
<aside><h3>Popular</h3><p>{LONG}</p></aside><section id="comments"><article class="comment"><p>{LONG}</p></article></section>
<footer><p>&copy; 2020 {LONG}</p></footer></div></body></html>"""


def test_a_whole_layout(spark, nodes):
    assert _text(spark, nodes, LAYOUT) == [f"A title {LONG} linked words and bold &éA… Ok. first second a b x y Ende"]


def test_pages_that_mark_nothing(spark, nodes):
    menu = '<div><a href="1">Home</a> | <a href="2">News</a> | <a href="3">Sport</a></div>'
    page = f"<body>{menu}<h1>What a headline it is</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div>Contact</div>{menu}"
    assert _text(spark, nodes, page) == [f"What a headline it is {LONG} Short. {LONG}"]


@pytest.mark.parametrize("name", ["menu", "main-nav", "sidebar", "left_sidebar", "adBox", "google-ads", "cookie-banner", "comments", "comment-list",
                                  "newsletter-signup", "site-footer", "share-buttons", "notice", "related-posts"])
def test_named_parts_go(spark, nodes, name):
    for mark in (f'class="x {name}"', f"id='{name}'", f"class={name}"):
        page = f'<div class="content"><p>{LONG}</p><div {mark}><p>{LONG}</p></div><p>Last words.</p></div>'
        assert _text(spark, nodes, page) == [f"{LONG} Last words."]


@pytest.mark.parametrize("name", ["has-sidebar", "post-with-comments", "shadow", "header-image-page commentary", "badge", "loading"])
def test_names_that_mark_nothing(spark, nodes, name):
    page = f'<article class="{name if not name.startswith("header") else "commentary"}"><p>{LONG}</p></article>'
    assert _text(spark, nodes, page) == [LONG]


def test_awkward_pages(spark, nodes):
    pages = [None, "", "   ", "<", "<p", "<!--", "<script>x", "<article><p>open <b>text", "<article><p>cut &am", "<article><p>a < b &lt;p&gt; <3 c</p>",
             "<article><p>one</b></p></i><p>two</article>", "<article><p title='a > b' data-x=\"</p>\">in</p></article>", "<article><a href=x><p>l</a><p>after all</article>",
             "<ARTICLE><P>Upper</P></ARTICLE>", "<article><textarea>no</textarea><p>é x\x00</p><svg><text>no</text></svg></article>",
             "<article><![CDATA[raw &amp; text]]><p hidden>no</p><p style='display: none'>no</p></article>"]
    assert _text(spark, nodes, *pages) == ["", "", "", "", "", "", "", "open text", "cut &am", "a < b <p> <3 c", "one two", "in", "l after all", "Upper",
                                           "é x\x00", "raw &amp; text"]


def test_long_pages_and_deep_nesting(spark, nodes):
    many = "".join(f"<p>paragraph {i} of many</p>" for i in range(60_000))
    deep = "<div>" * 30_000 + "<p>deep down here</p>" + "</section>" * 30_000
    broken = "<article>" + "<b>" * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000
    got = _text(spark, nodes, f"<article>{many}</article>", f"<article>{deep}", broken)
    assert got[0].startswith("paragraph 0 of many paragraph 1 ") and got[0].count("of many") == 60_000
    assert got[1] == "deep down here" and got[2] == " ".join(["x"] * 20_000)


def test_repeated_rows_other_columns_and_an_empty_table(spark, nodes):
    rows = [(1, "u", "<article><p>a b</p></article>", "t", 5)] * 2 + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row long")
    got = html_text.main_text(pages, nodes)
    assert sorted(got.columns) == ["n_chars", "page_id", "row", "text", "url"]
    assert sorted((tuple(r[c] for c in ("page_id", "url", "text", "n_chars", "row")) for r in got.collect()), key=str) == \
        [(1, "u", "a b", 3, 5), (1, "u", "a b", 3, 5), (None, None, "", 0, None)]
    assert html_text.main_text(pages.limit(0), nodes).collect() == []
