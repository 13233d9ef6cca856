"""Main text of web pages by site template removal.

Every page is read once to hash its element subtrees; Spark counts on how many distinct pages of a
host each subtree stands. A second reading deletes the subtrees that recur across many pages of the host,
along with elements that are never content, and returns the text of the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_table
from .base import holds_at_most, query, table, text_or_empty
from .url_rules import url_host

#: A subtree is template when it stands on so many distinct pages of its host. On less than this share of
#: them it is a narrow one, of a section or a language, and only containers without prose are deleted then.
MIN_PAGES, MIN_SHARE = 5, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<|[^<]+", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
ENDS_P = BLOCK - {"br", "html", "body", "option", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends an open one of the same row, up to the element in the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
MAIN = {"article", "main"}
NEVER = set("head script style noscript template iframe svg math object canvas nav aside button select textarea menu dialog xmp".split())
#: A form that holds one of these is a container of the page, any other is dropped.
FRAMES_PAGE = set("article main section nav header footer aside h1".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
OUTSIDE = {"header", "footer"}  # of the page; inside an article a header holds its headline
#: Containers that may be template inside an article; its paragraphs and headlines are never deleted.
PARTS = set("div section ul ol dl table figure details footer header".split())
BOILERPLATE = set(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing social related "
    "breadcrumb breadcrumbs comment comments disqus respond reply replies widget pager pagination masthead skip complementary search "
    "contentinfo".split()
)
PAGE_PARTS = {"header", "footer"}
#: What a name may say beside a word of the list and still name boilerplate: its place and its kind of container.
BESIDE = set(
    "site page main top bottom left right primary secondary global local header footer user reader box bar block container "
    "wrapper wrap inner outer holder list links link section area panel group row col column item items button buttons icon icons "
    "post posts article articles story stories slot unit zone overlay form body content text title signup bubble toast js the".split()
)
OF_PAGE = set("site page main top bottom global primary wrapper wrap container inner bar block the".split())
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def names_in(attributes: str) -> tuple[bool, bool, set[str]]:
    """Whether a name in class, id or role stands for boilerplate as a whole, whether one stands for the head or foot
    of a page, and all names in lower case.

    ``cookie-box`` and ``relatedPosts`` are boilerplate; ``has-sidebar``, ``comments-open`` and ``share-price`` say something else.
    """
    names = {name for value in NAMES.findall(attributes) for name in value.strip("\"'").split()}
    boilerplate = ends = False
    for name in names:
        words = {w for w in re.split(r"[^a-z]+", CAMEL.sub("-", name).lower()) if w}
        boilerplate |= bool(words & BOILERPLATE) and words <= BOILERPLATE | BESIDE
        ends |= bool(words & PAGE_PARTS) and words <= PAGE_PARTS | OF_PAGE
    return boilerplate, ends, {n.lower() for n in names}


class _Node:
    __slots__ = ("tag", "drop", "named", "main", "inside", "start", "first", "parts", "holds", "frames", "prose")

    def __init__(self, tag: str, drop: bool, named: bool, main: bool, inside: bool, start: int, first: int):
        self.tag, self.drop, self.named, self.main, self.inside, self.start, self.first = tag, drop, named, main, inside, start, first
        self.parts: list[str] = []
        self.holds, self.frames, self.prose = main, tag in FRAMES_PAGE, tag in PROSE


def read_page(html: str, template: frozenset | set = frozenset(), narrow: frozenset | set = frozenset()) -> tuple[str, list[int]]:
    """Main text, and the hashes of the subtrees that may be template.

    Text inside article or main elements is the main text; without them, that of the whole body. Names
    of boilerplate drop an element, but never the body, a main element or what holds one. Of the ``narrow``
    templates those without paragraphs or headlines are deleted.
    """
    out: list[str] = []
    mains: list[str] = []
    hashes: list[int] = []
    root = _Node("#root", False, False, False, False, 0, 0)
    stack = [root]

    def close() -> None:
        node = stack.pop()
        parent = stack[-1]
        mark = xxhash.xxh64_intdigest(f"{node.tag}({','.join(node.parts)})") - (1 << 63)
        parent.parts.append(str(mark))
        drop = node.drop or (node.named and not node.holds) or (node.tag == "form" and not node.frames)
        text = "".join(out[node.start :])
        may = not node.holds and (not node.inside or node.tag in PARTS) and node.tag not in ("html", "body")
        if drop:
            del out[node.start :]
            del mains[node.first :]
        elif may and text.strip():
            hashes.append(mark)
            if mark in template or (mark in narrow and not node.prose):
                del out[node.start :]
        parent.frames |= node.frames
        if not drop:
            parent.holds |= node.holds
            parent.prose |= node.prose
        if node.tag in BLOCK:
            out.append(" ")
        if node.main and not node.inside and not drop:
            mains.append("".join(out[node.start :]))

    def close_open(ended: set[str], within: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                return
            if stack[k].tag in ended:
                while len(stack) > k:
                    close()
                return

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text = unescape(m[0])
                out.append(text)
                if not text.isspace():
                    stack[-1].parts.append(" ".join(text.split()))
            continue
        tag = tag.lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in ENDS_P:
            close_open({"p"}, {"table", "td", "th", "div", "article", "section", "li", "body"})
        if tag in SIBLINGS:
            close_open(*SIBLINGS[tag])
        if tag in BLOCK:
            out.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        inside = stack[-1].inside or stack[-1].main
        named, ends, names = names_in(m[3]) if m[3] else (False, False, set())
        named &= tag not in ("html", "body", "main")
        main = tag == "main" or (tag == "article" and not named) or (tag not in NEVER and "main" in names and "role" in m[3].lower())
        outside = not inside and not main and (tag in OUTSIDE or ends) and tag not in ("html", "body")
        stack.append(_Node(tag, tag in NEVER, named or outside, main, inside, len(out), len(mains)))
    while len(stack) > 1:
        close()
    return " ".join("".join([x + " " for x in mains] or out).split()), hashes


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [sorted(set(read_page(html)[1])) for html in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["host"], batch["page"], pa.array(marks, pa.list_(pa.int64()))], ["host", "page", "marks"])


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    html = text_or_empty(html_col)
    return pages.select(url_host(F.col(url_col)).alias("host"), F.md5(html).alias("page"), html.alias("html"))


def distinct_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, marks): the subtree hashes of each distinct page; copies on a host are one page."""
    marked = _keyed(pages, url_col, html_col).mapInArrow(_hash_rows, "host string, page string, marks array<long>")
    return marked.dropDuplicates(["host", "page"])


def site_templates(distinct: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, mark, n, wide): the subtree hashes on ``min_pages`` distinct pages of a host; ``wide`` ones on ``min_share`` of them."""
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = distinct.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= min_pages).join(sizes, "host")
    return often.select("host", "mark", "n", (F.col("n") >= min_share * F.col("pages")).alias("wide"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", small: int = 10_000, **thresholds) -> DataFrame:
    """``pages`` with a column ``main_text`` (an input column of that name is replaced).

    Null html has the text ``""``. Every row is answered, repeated ones alike. Pages without a host
    are one site. Templates are broadcast by host if counted small; else each page is joined with
    those of its own, so that no row carries all templates of a large host.
    """
    distinct = written_table(distinct_pages(pages, url_col, html_col), "page-marks")
    templates = written_table(site_templates(distinct, **thresholds), "templates")
    both = [F.collect_list(F.when(F.col("wide"), F.col("mark"))).alias("__wide"), F.collect_list(F.when(~F.col("wide"), F.col("mark"))).alias("__narrow")]
    rows = pages.drop("main_text").withColumns({"__host": url_host(F.col(url_col)), "__page": F.md5(text_or_empty(html_col))})
    same = F.col("__host") == F.col("__of")
    if holds_at_most(templates, small):
        marked = F.broadcast(templates.groupBy(F.col("host").alias("__of")).agg(*both))
    else:
        own = distinct.select("host", "page", F.explode("marks").alias("mark")).join(templates, ["host", "mark"])
        marked = own.groupBy(F.col("host").alias("__of"), F.col("page").alias("__at")).agg(*both)
        same &= F.col("__page") == F.col("__at")
    joined = rows.join(marked, same, "left")

    def extract(html: pa.Array, wide: pa.Array, narrow: pa.Array) -> pa.Array:
        columns = zip(html.to_pylist(), wide.to_pylist(), narrow.to_pylist())
        return pa.array([read_page(h or "", frozenset(w or ()), frozenset(n or ()))[0] for h, w, n in columns], pa.string())

    return joined.select(
        *[F.col(c) for c in pages.columns if c != "main_text"],
        F.arrow_udf(extract, "string")(text_or_empty(html_col), F.col("__wide"), F.col("__narrow")).alias("main_text"),
    )


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
