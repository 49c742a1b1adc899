"""The main text of web pages, block by block.

A page becomes a flat list of text blocks: the text between two block-level tags,
with its number of words and of linked words, and what the elements around it say
(their kinds and names). The features of a block are its own and those of its
neighbours on the page. A decision tree, fitted on a small labelled table of
blocks, tells main text from the rest; its nodes become one column expression, so
that blocks are judged and joined where they are scanned, without a shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, written

BATCH_BYTES = 4 << 20
#: Depth of the tree, at most.
DEPTH = 8
#: Pages of the labelled table.
LABELLED_PAGES = 300

# Elements of HTML by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text for programs, not for readers.
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN_TAGS = frozenset("head svg math object audio video canvas map".split())
#: Elements that frame a page or ask its reader for something.
FRAME_TAGS = frozenset("nav aside footer form menu dialog button select fieldset search".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are closed by the start of another: tag -> tags that it ends.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Where the search for an element to end stops.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Parts of class names, ids and roles by which pages mark what is not their text.
OTHER_NAMES = frozenset(
    "ad adbox ads adsense adslot advert advertisement advertisements advertising adverts alert alertdialog announcement"
    " announcements anzeige aside banner banners billboard breadcrumb breadcrumbs captcha comentarios comment commentaires"
    " commenter commentform commentlist comments commentsection complementary consent contactform contentinfo cookie"
    " cookiebar cookies copyright crumbs dialog disclaimer discussion disqus donate feedback footer form forms gdpr header"
    " hidden infobar kommentare login masthead menu menubar modal nav navbar navi navigation newsletter notice notices"
    " notification outbrain pager pagination paywall popular popup privacy promo promoted promotion rail recommended"
    " register related replies reply respond responses search share sharing sidebar sidemenu sidenav signup skip skyscraper"
    " social sponsor sponsored submenu subnav subscribe subscription taboola tags talkback teaser teasers toast toolbar"
    " topbar topmenu topnav tracking trending usercomments warning werbung widget widgets".split())
#: Said before another part, these speak of the layout of the whole page.
SAID_OF_LAYOUT = frozenset("has with no without not layout is type status format category tag".split())
MAIN_NAMES = frozenset("article articlebody blogpost content entry main maincontent post postbody postcontent prose story".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<said>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<rest>[^>]*+)(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)"
                       r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")

# The parts that pages of the labelled table are put together from. [m 3 9]: three to
# nine words of main text, [o 3 9]: of anything else, [lm 3 9] and [lo 3 9]: as a link.
_MENU = "<ul><li>[lo 1 2]</li><li>[lo 1 3]</li><li>[lo 1 2]</li><li>[lo 1 4]</li></ul>"
#: Other than text, marked by elements or names.
MARKED = [
    f"<nav>{_MENU}</nav>", "<footer><p>[o 3 60]</p><p>[lo 1 3]</p></footer>", "<footer>[o 20 70]</footer>",
    "<aside><h3>[o 1 3]</h3><p>[o 10 80]</p></aside>", "<form><p>[o 3 40]</p></form>", f'<div class="menu">{_MENU}</div>',
    '<div class="ad">[o 3 40]</div>', '<div class="notice"><p>[o 5 60]</p></div>', '<div class="sidebar"><h3>[o 1 3]</h3><p>[o 10 70]</p></div>',
    '<div class="comments"><h3>[o 1 3]</h3><div class="comment"><p>[o 1 6]</p><p>[o 20 70]</p></div></div>',
    '<section class="comments"><article><p>[o 10 60]</p></article></section>', '<div class="related"><article><h3>[lo 3 9]</h3><p>[o 10 30]</p></article></div>',
    '<div class="share">[lo 1 3]</div>', '<p class="cookie">[o 10 50]</p>',
]
#: Other than text by its place alone, on pages that mark their main text.
UNMARKED = ["<header><p>[o 2 30]</p></header>", "<div>[o 1 9]</div>", "<div>[o 5 60]</div>", "<p>[o 10 70]</p><p>[o 10 70]</p>", "<h3>[o 1 5]</h3><p>[o 5 50]</p>", "<section><p>[o 20 60]</p></section>",
            f"<div>{_MENU}</div>", "<p>[o 3 9] [lo 1 3]</p>"]
#: Other than text by its length and links.
SHORT = [f"<div>{_MENU}</div>", "<div>[o 1 5]</div>", "<div>[lo 1 4]</div><div>[lo 1 4]</div>", "<div>[lo 1 3] [lo 1 3] [o 1 1] [lo 1 3]</div>",
         "<div>[lo 9 30] [lo 9 30]</div>", "<div>[o 1 4] [lo 2 9]</div>"]
TEXT = ["<p>[m 30 90]</p>", "<p>[m 15 60] [lm 1 5] [m 5 30]</p>", "<p>[m 20 70]</p>", "<p>[m 40 120]</p>"]
SHORT_TEXT = ["<p>[m 1 4]</p>", "<p>[m 4 12]</p>", "<h2>[m 1 6]</h2>", "<blockquote>[m 6 30]</blockquote>", "<ul><li>[m 1 9]</li><li>[m 3 9]</li></ul>",
              "<p>[lm 2 9]</p>", "<p>[m 2 9] [lm 1 3]</p>"]
MARKS = ["<article>{}</article>", "<main>{}</main>", "<main><article><header>[m 3 9]</header>{}</article></main>", '<div id="content">{}</div>', '<div class="post">{}</div>']


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages put together by chance, in turn: main text that is marked; only
    other parts that are marked; nothing marked; a page without main text; a lone text."""
    rng = random.Random(seed)
    some = lambda parts, low, high: [rng.choice(parts) for _ in range(rng.randint(low, high))]

    def words(match: re.Match) -> str:
        kind, low, high = match[1], int(match[2]), int(match[3])
        text = " ".join([("main" if "m" in kind else "rest") + "x" * rng.randint(0, 9) for _ in range(rng.randint(low, high))])
        return f'<a href="/x">{text}</a>' if "l" in kind else text

    pages = []
    for i in range(n):
        kind = ("marked", "marked", "others", "bare", "none", "lone")[i % 6]
        if kind == "marked":
            inside = [*some(TEXT + SHORT_TEXT, 1, 9), *some(MARKED, 0, 2)]
            rng.shuffle(inside)
            page = [*some(MARKED + UNMARKED, 0, 4), rng.choice(MARKS).format("<h1>[m 2 9]</h1>" + "".join(inside)), *some(MARKED + UNMARKED, 0, 4)]
        elif kind == "others":
            page = ["<header><p>[o 2 30]</p></header>", *some(MARKED, 0, 3), "<h1>[m 3 9]</h1>", *some(TEXT, 1, 3), *some(MARKED + TEXT + SHORT_TEXT, 0, 3), *some(TEXT, 1, 3), *some(MARKED, 1, 3)]
        elif kind == "bare":
            page = [*some(SHORT, 1, 4), "<h1>[m 3 9]</h1>", *some(TEXT, 2, 4), *some(SHORT_TEXT[:2], 0, 1), *some(TEXT, 2, 4), *some(SHORT, 1, 4)]
        else:
            page = [*some(MARKED + SHORT, 2, 8)] if kind == "none" else ["<p>[m 10 90]</p>"]
        pages.append(re.sub(r"\[(l?[mo]) (\d+) (\d+)\]", words, "".join(page)))
    return pages

BLOCKS = "array<struct<text:string,words:int,linked:int,frame:int,other:int,main:int,heading:int>>"
FEATURES = ["words", "density", "frame", "other", "main", "heading", "words_before", "density_before", "words_after",
            "density_after", "page_main"]


def _names(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's names mark it as other than text, and as text;
    ``inside``: within main text, where a header is that of the text."""
    other = main = False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = next((v for v in values if v), ""), key.lower()
        if key in ("hidden", "aria-hidden", "style"):
            other = other or (value.lower() == "true" if key == "aria-hidden" else key == "hidden" or bool(UNSEEN.search(value)))
            continue
        for name in html.unescape(value).split():
            parts = [p.lower() for p in NAME_PARTS.findall(name)]
            if SAID_OF_LAYOUT.isdisjoint(parts[:-1]):
                marks = OTHER_NAMES.intersection(parts)
                other = other or bool(marks - {"header"} if inside else marks)
                main = main or not MAIN_NAMES.isdisjoint(parts)
    return other, main


class _Page:
    """The open elements around a place in a page, and the blocks so far."""

    def __init__(self):
        self.blocks: list[tuple] = []
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.open: Counter[str] = Counter()
        #: framing, other, main, links, headings, hidden: open elements of each kind
        self.state = (0, 0, 0, 0, 0, 0)
        self.pieces: list[tuple[str, bool]] = []

    def text(self, raw: str, decode: bool = True) -> None:
        if raw and not self.state[5]:
            self.pieces.append((html.unescape(raw) if decode else raw, self.state[3] > 0))

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(p for p, _ in self.pieces)).strip()
        if text:
            linked = len("".join(p if inside else " " for p, inside in self.pieces).split())
            frame, other, main, _, heading, _ = self.state
            words = text.count(" ") + 1
            self.blocks.append((text, words, min(linked, words), frame, other, main, int(heading > 0)))
        self.pieces = []

    def start(self, tag: str, kinds: tuple[int, ...]) -> None:
        self.stack.append((tag, kinds))
        self.open[tag] += 1
        self.state = tuple(x + y for x, y in zip(self.state, kinds))

    def close(self, low: int, high: int | None = None) -> None:
        for tag, kinds in self.stack[low:high]:
            self.open[tag] -= 1
            self.state = tuple(x - y for x, y in zip(self.state, kinds))
        del self.stack[low:high]

    def end(self, tag: str) -> None:
        """An end tag: an inline element that reaches over blocks ends alone."""
        if not self.open[tag]:
            return
        over = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close(i, i + 1 if over else None)
                return
            over = over or tag not in BLOCK_TAGS and self.stack[i][0] in BLOCK_TAGS

    def imply_ends(self, tag: str) -> None:
        """Ends the elements that the start of ``tag`` ends."""
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCK_TAGS else set())
        if not any(self.open[e] for e in ends):
            return
        scope = SCOPES.get(tag)
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in ends:
                self.close(i)
                if scope is None:
                    return
            elif name in scope if scope is not None else name in BLOCK_TAGS:
                return


def blocks_of(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """The text blocks of a page in their order: text, words, linked words, framing
    elements around it, elements named as other than text, elements that are or are
    named as main text, and whether it is a heading."""
    p = _Page()
    at = 0
    while (token := TOKEN.search(page, at)) is not None:
        p.text(page[at:token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if token[0].startswith("<![CDATA["):
                p.text(token[0][9:].removesuffix("]]>"), decode=False)
            continue
        if tag in BLOCK_TAGS:
            p.flush()
        if token["end"]:
            p.end(tag)
            continue
        said = token["said"] if token["said"] is not None else token["rest"]
        if tag in RAW_TAGS:  # up to its own end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS:
            continue
        if tag == "a":  # links do not nest
            p.end("a")
        p.imply_ends(tag)
        if tag == "body":  # whatever is left of the head ends here
            p.close(0)
        main = p.state[2]
        other, named_main = _names(said, main > 0) if tag not in ("html", "body") else (False, False)
        framing = tag in FRAME_TAGS or tag == "header" and not main
        p.start(tag, (int(framing), int(other), int(tag in MAIN_TAGS or named_main and not other), int(tag == "a"),
                      int(tag in HEADINGS), int(tag in HIDDEN_TAGS)))
    p.text(page[at:])
    p.flush()
    return p.blocks


def page_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with ``_blocks`` (array of text, words, linked,
    frame, other, main, heading) and ``_page_main``: whether a block of the page stands
    in main text that nothing else marks. Null pages have no blocks."""
    kept = [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    kind = pa.list_(pa.struct([("text", pa.string()), *[(c, pa.int32()) for c in ("words", "linked", "frame", "other", "main", "heading")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BATCH_BYTES):
            found = [blocks_of(h) for h in batch.column("html").to_pylist()]
            offsets = pa.array([0, *accumulate(len(b) for b in found)], pa.int32())
            columns = list(zip(*[b for page in found for b in page])) or [()] * kind.value_type.num_fields
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.ListArray.from_arrays(offsets, values),
                 pa.array([int(any(b[5] and not b[3] and not b[4] for b in page)) for page in found], pa.int32())],
                names=["row", "_blocks", "_page_main"])

    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row}, _blocks {BLOCKS}, _page_main int").select("row.*", "_blocks", "_page_main")


def block_features(blocks: Column, x: Column, i: Column, page_main: Column) -> dict[str, Column]:
    """Features of block ``x``, the ``i``-th of its page, and of its neighbours."""
    def of(b: Column) -> tuple[Column, Column]:
        return F.coalesce(b["words"], F.lit(0)).cast("double"), F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    words, density = of(x)
    words_before, density_before = of(F.get(blocks, i - 1))
    words_after, density_after = of(F.get(blocks, i + 1))
    return {"words": words, "density": density, **{c: x[c].cast("double") for c in ("frame", "other", "main", "heading")},
            "words_before": words_before, "density_before": density_before, "words_after": words_after,
            "density_after": density_after, "page_main": page_main.cast("double")}


def labelled_blocks(spark: SparkSession, n_pages: int = LABELLED_PAGES, seed: int = 7) -> DataFrame:
    """The labelled table: the blocks of :func:`labelled_pages`, with ``FEATURES`` and
    ``label`` (1: main text)."""
    pages = list(enumerate(labelled_pages(n_pages, seed)))
    found = page_blocks(spark.createDataFrame(pages, "n int, html string"))
    flat = found.select("_blocks", "_page_main", F.posexplode("_blocks").alias("i", "x"))
    features = block_features(F.col("_blocks"), F.col("x"), F.col("i"), F.col("_page_main"))
    return flat.select(*[c.alias(k) for k, c in features.items()], F.col("x.text").startswith("main").cast("double").alias("label"))


def fit_tree(blocks: DataFrame, depth: int = DEPTH) -> DecisionTreeClassificationModel:
    """A decision tree over ``FEATURES`` of a labelled table."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(blocks).select("features", "label")
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(rows)


def tree_nodes(model: DecisionTreeClassificationModel) -> list[tuple]:
    """The tree as plain data: (feature, threshold, left, right) with the numbers of
    the children, or (None, prediction, 0, 0) for a leaf; node 0 is the root."""
    nodes: list[tuple] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.numDescendants() == 0:
            nodes[at] = (None, float(node.prediction()), 0, 0)
        else:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            nodes[at] = (FEATURES[split.featureIndex()], float(split.threshold()), left, right)
        return at

    add(model._call_java("rootNode"))
    return nodes


def decided(nodes: list[tuple], features: dict[str, Column], at: int = 0) -> Column:
    """Whether the tree takes a block for main text, as one expression."""
    feature, value, left, right = nodes[at]
    if feature is None:
        return F.lit(value >= 0.5)
    return F.when(features[feature] <= value, decided(nodes, features, left)).otherwise(decided(nodes, features, right))


def main_text(pages: DataFrame, nodes: list[tuple] | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, and ``text`` and ``n_chars`` (code points): the blocks
    that the tree takes for main text, in page order, joined by one space. ``nodes``:
    a tree of :func:`tree_nodes`; fitted on :func:`labelled_blocks` where it is not given.

    Character references are decoded; white space inside a block is one space.
    Null and empty pages, and pages without main text, have an empty text. Pages that
    end inside a tag, a comment or an element are read as far as they go. Whole pages
    are read, however long. Repeated rows each give a row; other columns are passed
    through (a column named ``text`` or ``n_chars`` is replaced). An empty table
    gives no rows. One narrow pass."""
    if nodes is None:
        nodes = tree_nodes(fit_tree(written(labelled_blocks(pages.sparkSession), "labelled-blocks")))
    found = page_blocks(pages.drop(*[c for c in ("text", "n_chars", "_blocks", "_page_main") if c in pages.columns]), html_col)
    kept = F.filter("_blocks", lambda x, i: decided(nodes, block_features(F.col("_blocks"), x, i, F.col("_page_main"))))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).drop("_blocks", "_page_main")
