"""Main text of pages by a site style tree.

The pages of a host are merged into one tree. A node is a place: the containers around it, by
tag, class and id. For each node Spark counts on how many different pages each block of text
and each sequence of child tags stands there. What differs from page to page is content;
what is the same on most pages is the site's frame. Counts give the entropies in closed form:
a feature on c of m pages has entropy ln c / ln m.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import cut, only

#: A node on fewer different pages is not judged.
MIN_PAGES = 8
#: Nodes less important than this are removed.
THRESHOLD = 0.3
#: Weight of a node's own layout against its content.
LAYOUT_WEIGHT = 0.1
BROADCAST_NODES = 100_000
SALTS = 32

# Elements that never hold main text.
DROPPED = frozenset("nav footer header aside form script style noscript template button select option iframe svg math canvas object video audio head title menu dialog fieldset textarea".split())
# Roles that never hold main text.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of class names and ids that mark what stands around the main text.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice gdpr popup modal "
    "overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar side header masthead footer "
    "foot comment comments disqus respond reply replies share sharing social related recommended recommendations widget pagination pager toolbar".split())
# Words before a frame word that make it say something of the element's content.
MODIFIERS = frozenset("with has have no without category tag is".split())
# Elements that begin a block of text.
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary "
    "table tbody td tfoot th thead tr ul caption nav footer header aside form".split())
CONTAINERS = frozenset("article aside blockquote div dl figure footer form header main nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg"
_CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "summary", "figcaption"}
_SAME_LEVEL = {"li": ("li", {"ul", "ol"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
               "tr": ("tr td th", {"table"}), "tbody": ("tbody thead tfoot tr td th", {"table"}), "option": ("option", {"select"})}

_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|(?:[^<]|<(?![a-zA-Z/!?]))+""",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    path: str  # of the innermost container
    frame: bool  # inside what fixed rules take away
    article: bool
    heading: bool
    marks: tuple[int, ...] = ()  # the elements around it whose class or id is a frame word


class Page(NamedTuple):
    blocks: list[Block]
    layouts: list[tuple[str, str]]  # path of each container and its child tags


class _Open:
    __slots__ = ("article", "children", "frame", "marks", "path", "tag")

    def __init__(self, tag: str, path: str, frame: bool, article: bool, marks: tuple[int, ...] = ()) -> None:
        self.tag, self.path, self.frame, self.article, self.marks = tag, path, frame, article, marks
        self.children: list[str] = []


def _signature(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Tag with class and id, without long numbers; whether fixed rules take it away; 2 if a class or id begins with
    a frame word, 1 if one has such a word further on, but not where it says what the element has, as with-sidebar."""
    frame, marked, marks = tag in DROPPED, 0, ""
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name in ("class", "id"):
                words = _WORD.findall(value.replace("_", "-"))
                if not FRAME_WORDS.isdisjoint(words):
                    parts = [x for x in (_WORD.findall(v) for v in value.split()) if x and x[0] not in MODIFIERS and not FRAME_WORDS.isdisjoint(x)]
                    marked = max([marked, *(1 + (x[0] in FRAME_WORDS) for x in parts)])
                marks += ("." if name == "class" else "#") + "-".join(w for w in words if not (w.isdigit() and len(w) > 2))
            elif name == "role":
                frame |= value in DROPPED_ROLES
            elif name == "style":
                frame |= "display:none" in value.replace(" ", "")
            elif name == "hidden" or value == "true":
                frame = True
    return tag + marks, frame, marked


def read_page(html: str) -> Page:
    """Blocks of text and container layouts in page order. Missing end tags are made up for; what
    is cut off ends with the page."""
    stack = [_Open("#root", "", False, False)]
    page = Page([], [])
    held: list[str] = []
    n_marks = 0
    weak: set[int] = set()
    wrappers: set[int] = set()  # marked elements around an article or main: their marks do not count

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                top = stack[-1]
                page.blocks.append(Block(text, top.path, top.frame, top.article, any(x.tag in ("h1", "h2", "h3") for x in stack[-3:]), top.marks))

    def close(at: int) -> None:
        while len(stack) > at:
            gone = stack[-1]
            if gone.tag in BLOCKS:
                flush()
            stack.pop()
            if gone.tag in CONTAINERS:
                page.layouts.append((gone.path, " ".join(gone.children)))

    for m in _TOKEN.finditer(html):
        tag = m[3]
        if tag is None:
            token = m[0]
            if m[1] is None and (token[0] != "<" or not re.match(r"<[a-zA-Z/!?]", token)):
                held.append(token)
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "br":
                held.append(" ")
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at and (tag in BLOCKS or tag in DROPPED or not any(x.tag in BLOCKS for x in stack[at + 1:])):
                if tag in BLOCKS or stack[at].frame != stack[at - 1].frame or stack[at].marks != stack[at - 1].marks:
                    flush()
                close(at)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        signature, frame, marked = _signature(tag, m[4])
        if tag in BLOCKS:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in CONTAINERS:
                        break
        if tag in _SAME_LEVEL:
            closes, stops = _SAME_LEVEL[tag]
            low = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in closes.split():
                    low = i
            if low < len(stack):
                flush()
                close(low)
        top = stack[-1]
        if (frame and not top.frame) or (marked and not top.frame):
            flush()
        if top.children[-1:] != [tag]:
            top.children.append(tag)
        if tag in ("html", "body"):
            continue
        path = f"{top.path}>{signature}" if tag in CONTAINERS else top.path
        if not m[4].endswith("/") or tag in BLOCKS:
            marks = top.marks
            if tag in ("article", "main"):
                if not (top.frame or frame):
                    wrappers.update(marks)
            elif marked:
                n_marks += 1
                if marked == 1:
                    weak.add(n_marks)
                marks = (*marks, n_marks)
            stack.append(_Open(tag, path, top.frame or frame, top.article or tag in ("article", "main"), marks))
    flush()
    close(1)
    return Page(_framed(page.blocks, wrappers, weak), page.layouts)


def _framed(blocks: list[Block], wrappers: set[int], weak: set[int]) -> list[Block]:
    """Blocks in marked elements as frame, but for wrappers and for those that hold most of the page's text; where
    there is an article, only the weak ones of those."""
    sizes: dict[int, int] = {}
    total = 0
    for b in blocks:
        if not b.frame:
            total += len(b.text)
            for mark in b.marks:
                sizes[mark] = sizes.get(mark, 0) + len(b.text)
    article = any(b.article and not b.frame for b in blocks)
    most = {k for k, n in sizes.items() if 2 * n > total and (k in weak or not article)}
    return [b._replace(frame=True) if not (wrappers | most).issuperset(b.marks) else b for b in blocks]


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.IGNORECASE)
    return m[1].lower() if m else ""


def node_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, kind (text or layout), feature (hash) and c, the different pages that have it.

    Pages that are the same byte for byte count once. The counting is by partial sums, so a
    host with a third of all pages is no hot spot.
    """
    seed = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("feature", pa.int64()), ("page", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                rows: set[tuple[str, str, str, int, int]] = set()
                for url, html, page in zip(*(c.slice(a, 200).to_pylist() for c in batch.columns), strict=True):
                    host, read = host_of(url), read_page(html or "")
                    rows.update((host, b.path, "text", _key(b.text), page) for b in read.blocks if not b.frame and not b.heading)
                    rows.update((host, path, "layout", _key(children), page) for path, children in read.layouts)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, seed, strict=True)], schema=seed)

    html = F.col(f"`{html_col}`")
    source = pages.select(F.col(f"`{url_col}`"), html, F.xxhash64(F.coalesce(html, F.lit(""))).alias("page"))
    features = source.mapInArrow(run, "host string, path string, kind string, feature long, page long")
    return features.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"))


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def node_importance(counts: DataFrame, weight: float = LAYOUT_WEIGHT) -> DataFrame:
    """host, path, m (different pages with the node) and importance.

    Content: one less the mean entropy of the texts there, each counted as often as it stands.
    Layout: the entropy of the child sequences, against the pages of the node. importance =
    weight * layout + (1 - weight) * content, from 0 (the same everywhere) to 1.
    """
    # each page has a node's layout at least once; sum c over its layouts is the size of the node
    is_layout, c = F.col("kind") == "layout", F.col("c")
    # both kinds in one aggregate: two would read the pages twice
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(is_layout, c)).alias("m"), F.sum(F.when(is_layout, c * F.log("c"))).alias("clogc"),
        F.sum(F.when(~is_layout, c)).alias("n"), F.sum(F.when(~is_layout, c * F.log("c"))).alias("tlogt"))
    log_m = F.log(F.greatest("m", F.lit(2)))
    return sums.filter("m IS NOT NULL AND n IS NOT NULL").select(
        "host", "path", "m",
        (F.lit(weight) * (1 - F.col("clogc") / F.col("m") / log_m)
         + (1 - weight) * (1 - F.least(F.col("tlogt") / F.col("n") / log_m, F.lit(1.0)))).alias("importance"))


def main_text(pages: DataFrame, keep: Iterable[str] | None = None, url_col: str = "url", html_col: str = "html",
              threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """row (struct of the columns keep, by default all) and text of each page.

    Fixed rules take away menus, headers, footers, sidebars, notices, adverts, forms, comments,
    scripts and styles. Class words do not count on article, main and what contains them, nor on
    what holds most of the page's text. The style tree then removes the branches of low importance: inside an
    article those whose own class or id marks them off, elsewhere any. If a page has an article or main
    element with text, only text inside it is main text. Character references are decoded, white space in a
    block is one space, and blocks are joined by a line feed, all in page order.

    A null or empty html, and one without main text, gives an empty text. Pages of unknown host form
    one host ''. Equal pages get equal texts. An empty table gives no rows.
    """
    keep = list(pages.columns if keep is None else keep)
    nodes = node_importance(node_counts(only(pages, [url_col, html_col]), url_col, html_col))
    low = nodes.filter((F.col("m") >= min_pages) & (F.col("importance") < threshold)).groupBy("host").agg(
        F.collect_set("path").alias("paths"), F.count("*").alias("n"))
    low = cut(low)
    size = low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    source = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    if size <= broadcast_nodes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.paths) for r in low.collect()})
        source = source.withColumn("paths", F.lit(None).cast("array<string>"))
    else:
        shared = None
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
        salted = low.select("host", "paths", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        source = source.withColumns({"host": host, "salt": F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")}).join(
            salted, ["host", "salt"], "left").select("row", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                out = []
                for url, html, paths in zip(*(c.slice(a, 200).to_pylist() for c in batch.columns[1:]), strict=True):
                    gone = frozenset(paths or ()) if shared is None else shared.value.get(host_of(url), frozenset())
                    out.append(page_text(read_page(html or ""), gone))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 200), pa.array(out, pa.string())], names=["row", "text"])
    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, text string")


def page_text(page: Page, gone: frozenset[str]) -> str:
    blocks = [b for b in page.blocks if not b.frame]
    inside = [b for b in blocks if b.article]
    blocks = [b for b in inside or blocks if not _removed(b, gone)]
    return "\n".join(b.text for b in blocks)


def _removed(block: Block, gone: frozenset[str]) -> bool:
    """Whether the block's node, or one around it, is removed. In an article, only nodes with a mark."""
    if not gone:
        return False
    path = block.path
    while path:
        if path in gone and (not block.article or _marked_off(path)):
            return True
        path = path.rpartition(">")[0]
    return False


def _marked_off(path: str) -> bool:
    last = path.rpartition(">")[2]
    return not re.match(r"(?:article|main)\b", last) and ("." in last or "#" in last) and bool(re.search(r">(?:article|main)\b", path.rpartition(">")[0]))
