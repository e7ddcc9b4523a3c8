"""Main text of web pages: flat blocks and a decision tree.

A page is cut into flat text blocks.  Each block is described by its own words and
link density, those of its two neighbours on either side, and two marks: how strongly
enclosing elements name themselves as beside the text (0 to 3), and as the article (0
to 2).  A decision tree, trained on a small labelled table (``html_labelled``), tells
which blocks are main text; it is applied as a Spark conditional expression.

A mark of 1 is weak (a list of links, a form; for the article a name), so the tree
goes by words and links there.  An article or main element ends the marks of what it
lies in, but for comments, related pages and the like.

Words are counted by white space, and by letters in scripts that have none.  Where the
tree keeps no block at all, as of a page of one short line, the unmarked blocks stay.

Defined cases: a null, empty or text-free page gives an empty text; pages that end
early or leave elements open are read as far as they go; script and style end at
their end tag only, whatever they hold; comments in the markup hold no text;
repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_labelled import BLOCKS, PAGES

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_OPEN = re.compile(r"</?[a-zA-Z!?]")
_NAME = re.compile(r"[a-z]+")
#: Letters of scripts that are written without spaces: Thai to Khmer, kana and ideographs.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
_UNSPACED = re.compile(UNSPACED)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("head noscript template svg math iframe object select button textarea canvas audio video datalist".split())
#: What elements and names say of being beside the text: weak, plain, and whatever lies inside.
BESIDE = dict.fromkeys("form menu".split(), 1) | dict.fromkeys("nav footer aside dialog".split(), 3)
BESIDE_NAMES = (
    dict.fromkeys("breadcrumb breadcrumbs login menu menubar nav navbar navigation pager pagination search share sharing social toolbar".split(), 1)
    | dict.fromkeys(
        "ad ads advert advertisement advertising adverts alert banner complementary consent contentinfo cookie cookies copyright dialog disclaimer "
        "footer gdpr legal modal newsletter notice notification popup promo promotion sidebar signup sponsor sponsored subscribe subscription widget".split(),
        2,
    )
    | dict.fromkeys("comment comments disqus recommended related reply replies".split(), 3)
)
TOP_NAMES = frozenset("header masthead topbar".split())
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article content entry main post story".split())
#: Words that make a name one of a page's state, such as "has-menu" or "comments-open".
STATE_NAMES = frozenset("layout has no with is open enabled".split())
#: A name with a word of each is one of a page's layout, such as "content-sidebar-wrap".
INNER_NAMES, AROUND_NAMES = frozenset("content main".split()), frozenset("wrap wrapper container area".split())
#: With these a header is one of the text, such as "entry-header".
TITLE_NAMES = ARTICLE_NAMES | {"page", "primary"}
BLOCK = "array<struct<text:string,words:int,link_words:int,beside:int,article:int>>"
NEIGHBOURS = {"before": -1, "after": 1, "before2": -2, "after2": 2}
FEATURES = ["words", "link_density", *[f"{kind}_{at}" for at in NEIGHBOURS for kind in ("words", "density")], "beside", "article"]


def n_words(text: str) -> int:
    """Words by white space; two letters of a script without spaces count as one."""
    unspaced = 0 if text.isascii() else len(_UNSPACED.findall(text))
    return len((_UNSPACED.sub(" ", text) if unspaced else text).split()) + (unspaced + 1) // 2


def _marks(tag: str, attrs: str, article: int) -> tuple[int, int]:
    """How strongly an element names itself as beside the text, and as the article."""
    beside, own = BESIDE.get(tag, 2 if tag == "header" and not article else 0), 2 if tag in ARTICLE else 0
    if attrs and tag not in ("html", "body"):
        for name, a, b, c, bare in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if bare or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                beside = 3
            elif name in ("class", "id", "role"):
                for token in value.split():
                    parts = set(_NAME.findall(token))
                    top = not article and parts & TOP_NAMES and not parts & TITLE_NAMES
                    told = max([BESIDE_NAMES.get(x, 0) for x in parts] + [2 if top else 0])
                    if not told:
                        own = max(own, int(bool(parts & ARTICLE_NAMES)))
                    elif not (parts & STATE_NAMES or parts & INNER_NAMES and parts & AROUND_NAMES):
                        beside = max(beside, told)
    return beside, 0 if beside > 1 else own


def page_blocks(page: str | None) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, beside, article) of each block, in page order."""
    page, out = page or "", []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int, bool]] = []  # name, beside, article, skipped
    link = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(n_words(t) for t, inside in parts if inside)
                top = stack[-1] if stack else ("", 0, 0, False)
                n = n_words(text)
                out.append((text, n, min(linked, n), top[1], top[2]))
            parts.clear()

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        if at > last and _OPEN.match(page, at):
            break  # the page ends inside a tag
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                if not (stack and stack[-1][3]):
                    parts.append((html.unescape(s) if "&" in s else s, link > 0))
            continue
        tag, closing = tag.lower(), (m[1] or m[4]) == "/"
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and any(x[0] not in INLINE for x in stack[i + 1 :]):
                        del stack[i]
                    else:
                        del stack[i:]
                    break
        else:
            if tag in RAW:
                end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or size if end else size
                continue
            while stack and (tag == "a" and stack[-1][0] == "a" or tag not in INLINE and (stack[-1][0] in INLINE and not stack[-1][1] or stack[-1][0] == "p")):
                stack.pop()
            if tag == "body" or tag == "html":
                while stack and stack[-1][0] == "head":
                    stack.pop()
            _, beside, article, skipped = stack[-1] if stack else ("", 0, 0, False)
            if not (m[3] or m[6] or "").rstrip().endswith("/") or tag in INLINE:
                new_beside, new_article = _marks(tag, m[3] or m[6] or "", article)
                if tag == "main" or tag == "article" and beside < 3:
                    beside = 0
                stack.append((tag, max(beside, new_beside), 0 if new_beside > 1 else max(article, new_article), skipped or tag in SKIPPED))
        link = sum(x[0] == "a" for x in stack)
    flush()
    return out


def blocks(page: Column) -> Column:
    @F.pandas_udf(BLOCK)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([[dict(zip(("text", "words", "link_words", "beside", "article"), b, strict=True)) for b in page_blocks(p)] for p in pages], dtype=object)

    return cut(page.cast("string"))


def described(b: Column) -> Column:
    """The blocks with the features of the tree."""
    num = lambda x, f: F.coalesce(x[f], F.lit(0)).cast("double")
    density = lambda x: F.when(num(x, "words") > 0, num(x, "link_words") / num(x, "words")).otherwise(0.0)

    def features(x: Column, i: Column) -> Column:
        around = [F.get(b, i + step) for step in NEIGHBOURS.values()]
        values = [num(x, "words"), density(x), *[f for y in around for f in (num(y, "words"), density(y))], num(x, "beside"), num(x, "article")]
        return F.struct(x["text"].alias("text"), *[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])

    return F.transform(b, features)


def labelled_table() -> list[tuple[float, ...]]:
    """(label, features...) of every labelled block."""
    rows, pages = [], []
    for page in PAGES:
        own = []
        for text, _, linked, beside, article in page_blocks(page):
            n = n_words(text[1:])
            own.append((text[0] == "+", n, min(linked, n) / n if n else 0.0, beside, article))
        pages.append(own)
    for line in BLOCKS:
        cells = [b.split() for b in line.split(", ")]
        pages.append([(label == "+", int(n), int(linked) / int(n), 2 * int(beside), 2 * int(article)) for label, n, linked, beside, article in cells])
    for own in pages:
        for i, (label, n, d, beside, article) in enumerate(own):
            around = [own[i + step][1:3] if 0 <= i + step < len(own) else (0, 0.0) for step in NEIGHBOURS.values()]
            rows.append((float(label), float(n), d, *[float(f) for pair in around for f in pair], float(beside), float(article)))
    return rows


def train_tree(spark: SparkSession, depth: int = 6):
    """The tree as nested (feature, threshold, at most, above); a leaf is its label."""
    rows = spark.createDataFrame([(r[0], Vectors.dense(r[1:])) for r in labelled_table()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, seed=5, minInstancesPerNode=2).fit(rows)

    def read(node):
        if node.numDescendants() == 0:
            return node.prediction()
        split = node.split()
        return (FEATURES[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(model._call_java("rootNode"))


def is_main(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree == 1.0)
    feature, threshold, below, above = tree
    return F.when(x[feature] <= threshold, is_main(below, x)).otherwise(is_main(above, x))


def main_text(pages: DataFrame, page: str = "html", tree=None) -> DataFrame:
    """``pages`` with ``main_blocks``, the texts of the blocks that the tree keeps.

    Of a page of which it keeps none, all blocks stay that are neither marked as beside
    the text nor half made of links.
    """
    tree = tree or train_tree(pages.sparkSession)
    cut = pages.withColumn("main_blocks", blocks(F.col(f"`{page}`")))
    every = described(F.col("main_blocks"))
    kept = F.filter(every, lambda x: is_main(tree, x))
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.filter(every, lambda x: (x["beside"] <= 1) & (x["link_density"] < 0.5)))
    return cut.withColumn("main_blocks", F.transform(kept, lambda x: x["text"]))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.array_join("main_blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
