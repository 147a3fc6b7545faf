"""Main text of web pages (operator 8).

A page is cut into flat text blocks.  Each block has its number of words and
its share of words in links (link density), those of the two blocks before and of the two
behind it, and what surrounds it: an article or main element, an element or role
for menus, headers, footers, sidebars or forms, one whose whole class or id names such a thing, an
advert, a notice or comments, and whether it is a heading or a paragraph.  A decision tree, trained
with MLlib on the small labelled table in ``html_samples``, says which blocks are main text.  On
pages whose markup tells nothing, it decides by words and links alone.

Scripts, styles, comments, templates and hidden elements hold no text; character
references are decoded; a self-closed svg or math is empty; white space inside a block becomes one space; blocks
are joined in page order by one newline.  Nothing else is dropped or cut.

Defined results: null or empty html gives an empty text; markup that breaks off
or is not closed is read as far as it goes; repeated rows each get a row; extra
columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from opinia.llm.html_samples import SAMPLES

SILENT = "script|style|template|noscript|svg|math|iframe|object|textarea|select|title"
PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:svg|math)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<(?P<silent>{SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=silent)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)(?:>|\Z)", re.S | re.I)
HINTS = re.compile(r"(?<![\w-])(class|id|role|hidden|style)(?![\w-])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form dialog menu button header fieldset head".split())
CLOSES = {  # an element that ends an open one of these kinds
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
} | {n: {"p"} for n in "div ul ol dl table section article main aside nav header footer form pre blockquote h1 h2 h3 h4 h5 h6 hr".split()}
BARRIER = frozenset("article main section aside nav header footer form div table ul ol dl blockquote body html".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts advertisement sponsor sponsored banner "
    "promo promotion cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager widget login search form comment comments commentlist "
    "discussion disqus replies reply respond complementary contentinfo dialog toolbar copyright".split())
MAIN_WORDS = frozenset("content article post entry story main body text".split())
# parts of compound names that say nothing by themselves: "ad-box", "site-footer", "related-posts"
FILLERS = frozenset("site page box list container wrapper wrap block area section bar item items inner outer top bottom left right "
                    "main global posts links form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDES = frozenset("comment comments reply replies ad ads sponsored".split())  # an article element of these is no article
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "words_before_2", "links_before_2",
            "words_behind_2", "links_behind_2", "boiler", "named", "article", "heading", "paragraph")


def _names(value: str, known: frozenset) -> bool:
    """One of the whole names in a class or id is one of the words, or a compound of them and fillers: "cookie-notice", but
    not "social-policy"."""
    for name in value.split():
        parts = {x for x in re.split(r"[^a-z0-9]+", name) if x}
        if parts & known and parts <= known | FILLERS:
            return True
    return False


def _kind(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(starts boilerplate by element or role, by name, starts an article, is hidden)."""
    boiler, named, article, hidden = name in BOILER, False, name in ("article", "main"), False
    if attrs and name not in ("html", "body"):
        for key, value in HINTS.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif key == "role":
                boiler |= value in ROLES
                article |= value in ("main", "article")
            elif key in ("class", "id"):
                if _names(value, BOILER_WORDS) and not (article and not _names(value, ASIDES)):
                    named = True
                elif _names(value, MAIN_WORDS):
                    article = True
    return boiler, named, article, hidden


def blocks_of(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of the non-empty blocks in page order."""
    raw: list[tuple] = []  # text, link density, then what is around
    # name, then around: boilerplate by element, by name, article, hidden, link, heading, paragraph
    stack: list[tuple] = []
    parts: list[str] = []
    linked = [0]
    nothing = (False,) * 7
    around = nothing
    state = {"at": around}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            boiler, named, article, _, _, heading, paragraph = state["at"]
            raw.append((text, min(1.0, linked[0] / (text.count(" ") + 1)), boiler, named, article, heading, paragraph))
        linked[0] = 0

    def add(chunk: str) -> None:
        if chunk and not around[3]:
            if not chunk.isspace():
                state["at"] = around
                if around[4]:
                    linked[0] += len(html.unescape(chunk).split())
            parts.append(chunk)

    at, page = 0, page or ""
    for m in PIECES.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if m["end"]:
            if any(e[0] == name for e in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in BARRIER:
                    break
            if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                boiler, named, article, hidden, link, heading, paragraph = stack[-1][1:] if stack else nothing
                b, c, a, h = _kind(name, m["attrs"])
                if name in HEADINGS:
                    heading = True
                    boiler = boiler and not _article_header(stack)  # the headline of an article belongs to it
                stack.append((name, boiler or b, named or c, article or a and not (boiler or named), hidden or h, link or name == "a", heading,
                              paragraph or name in ("p", "blockquote", "pre")))
        around = stack[-1][1:] if stack else nothing
    add(page[at:])
    flush()
    sizes = [float(r[0].count(" ") + 1) for r in raw]

    def near(i: int) -> list[float]:
        return [sizes[i], raw[i][1]] if 0 <= i < len(raw) else [0.0, 0.0]

    return [(r[0], [*near(i), *near(i - 1), *near(i + 1), *near(i - 2), *near(i + 2), *map(float, r[2:])]) for i, r in enumerate(raw)]


def _article_header(stack: list) -> bool:
    """The innermost boilerplate element is a plain header right inside an article."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "header":
            return k > 0 and stack[k - 1][3] and not (stack[k - 1][1] or stack[k - 1][2])
        if stack[k][0] in BOILER:
            return False
    return False


def labelled_table() -> list[tuple[list[float], float]]:
    rows = []
    for page in SAMPLES:
        for text, features in blocks_of(page):
            rows.append((features, float("§" in text)))
    return rows


def train(spark, depth: int = 10):
    """Decision tree of the labelled table as nested tuples (feature, threshold,
    left, right); a leaf is True for main text."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    # what the markup calls an article counts more: it is rarely wrong
    rows = [(Vectors.dense(f), y, 10.0 if f[FEATURES.index("article")] else 1.0) for f, y in labelled_table()]
    tree = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=8, weightCol="weight", seed=7)
    model = tree.fit(spark.createDataFrame(rows, ["features", "label", "weight"]))

    def walk(node):
        if node.subtreeDepth() == 0:
            return node.prediction() == 1.0
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._call_java("rootNode"))


def decide(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        i, threshold, left, right = tree
        tree = left if features[i] <= threshold else right
    return tree


RESULT = "text string, n_chars long, n_blocks int, n_main int"


def extract(pages: DataFrame, tree, html_column: str = "html") -> DataFrame:
    """``pages`` (without the html) plus text, n_chars, n_blocks, n_main."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fresh = StructType.fromDDL(RESULT)
    keep = [c for c in pages.columns if c not in (*fresh.names, html_column)]
    base = pages.select(*keep, F.col(html_column).alias("_html"))
    out = StructType(base.schema.fields[:-1] + fresh.fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            res = []
            for page in b.column(len(keep)):
                found = blocks_of(page.as_py())
                main = [t for t, f in found if decide(tree, f)]
                text = "\n".join(main)
                res.append((text, len(text), len(found), len(main)))
            new = list(zip(*res, strict=True)) if res else [()] * 4
            cols = [b.column(i) for i in range(len(keep))]
            cols += [pa.array(v, schema.field(i - 4).type) for i, v in enumerate(new)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return base.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(spark)).select("page_id", "url", "text", "n_chars")
