"""One row per page with typed arrays of its elements, and the element tables.

Containment (text of a heading, items of a list, cells of a row) is never a join: the
pieces of one kind inside a subtree are neighbours in document order, so a running count
at the subtree's start and end gives the slice of the page's array that belongs to it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.html import selector_rank
from ..functions.text import js_trim, let, non_empty, token_estimate, utf16_length
from .clean import count_removed, mark_removed
from .serialise import written
from .tokens import tree

HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_COUNTED = ["texts", "items", "headers", "rows", "cells"]
#: Where the session says nothing else, rows that the windows leave sorted by page are folded as they come: hash
#: aggregates of lists give up after 128 pages, write the lists out, sort all rows once more and merge.
SORTED_FOLD = ("spark.sql.execution.replaceHashWithSortAgg", "true")


def part_array() -> Column:
    """Visible parts of one token: aria-label, title, alt of an image, then text."""
    attrs = F.col("attrs")
    parts = F.array(
        js_trim(attrs["aria-label"]),
        js_trim(attrs["title"]),
        F.when(F.col("tag") == "img", js_trim(attrs["alt"])),
        js_trim(F.col("text")),
    )
    return F.filter(parts, lambda p: p != "")


#: Stands between text nodes; no page text holds it.
BREAK = "\u0000"


def is_ignored() -> Column:
    """Tokens that a parser skips without ending a text node: end tags without a start, doctypes,
    tags of html, head and body, unfinished tags. An end tag of p or br makes an element."""
    tag = F.col("tag")
    stray = F.col("is_close") & ~F.coalesce(F.col("paired"), F.lit(False)) & ~tag.isin("p", "br")
    return stray | tag.isin("#declaration", "#unfinished", "html", "head", "body")


def is_plain_text() -> Column:
    return F.col("tag") == "#text"


def text_pieces(alive: Column) -> Column:
    """What a token adds to the text of its page: text nodes are what stands between breaks."""
    text = F.translate(F.col("text"), BREAK, "\ufffd")
    attrs = F.col("attrs")
    named = F.array(
        attrs["aria-label"], attrs["title"], F.when(F.col("tag") == "img", attrs["alt"]),
        F.when(~is_plain_text(), text),
    )
    parts = F.filter(named, lambda p: p.isNotNull())
    element = F.concat(F.lit(BREAK), F.array_join(parts, BREAK), F.lit(BREAK))
    return (
        F.when(~alive, F.lit(BREAK)).when(is_plain_text(), text)
        .when(is_ignored() & (F.size(parts) == 0), "").otherwise(element)
    )


def _with_counts(marked: DataFrame) -> DataFrame:
    """+ alive and, per counted kind, how many are alive up to and with this token."""
    tag = F.col("tag")
    opens = ~F.col("is_close")
    is_a = {
        "texts": F.col("text").isNotNull(),
        "items": opens & (tag == "li"),
        "headers": opens & (tag == "th"),
        "rows": opens & (tag == "tr"),
        "cells": opens & (tag == "td"),
    }
    so_far = (
        W.partitionBy("page_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    alive = F.col("i").isNotNull() & ~F.col("removed")
    marked = marked.withColumn("alive", alive)
    return marked.withColumns({
        f"n_{k}": F.count(F.when(F.col("alive") & is_a[k], 1)).over(so_far).cast("int")
        for k in _COUNTED
    })


def _page_arrays(marked: DataFrame, keep: tuple, wanted: set) -> DataFrame:
    """Fold each page's tokens into the wanted arrays; only the page's own rows meet."""
    tag, attrs = F.col("tag"), F.col("attrs")
    opens = F.col("alive") & ~F.col("is_close")
    counts = [F.col(f"n_{k}").alias(k) for k in _COUNTED]
    first_text = F.col("n_texts") - F.when(F.col("text").isNotNull(), 1).otherwise(0)
    span = ["end", first_text.alias("text0")]

    def gather(condition, *columns):
        return F.sort_array(F.collect_list(F.when(condition, F.struct("i", *columns))))

    def html():
        in_tree = (
            F.col("i").isNotNull() & F.col("in_body")
            & ~tag.isin("html", "head", "body") & ~((tag == "#comment") & F.col("after_body"))
        )
        return written(F.col("alive"), ~F.col("removed_before"), in_tree)

    def buttons():
        is_button = selector_rank(fixed.BUTTON_SELECTORS, tag, attrs).isNotNull()
        value = F.when(tag.isin("input", "button", "li", "option"), attrs["value"])
        return gather(opens & is_button, *span, value.alias("value"))

    def json_ld():
        is_script = (tag == "script") & ~F.col("is_close")
        return gather(
            is_script & (F.lower(attrs["type"]) == "application/ld+json"),
            js_trim("text").alias("json"),
        )

    arrays = {
        "matches": lambda: gather(F.col("rank").isNotNull(), "end", "rank", "grp"),
        "counts": lambda: gather(F.col("i").isNotNull(), *counts),
        "texts": lambda: gather(F.col("alive") & F.col("text").isNotNull(), "text"),
        "parts": lambda: gather(F.col("in_body"), text_pieces(F.col("alive")).alias("piece")),
        "html": html,
        "headings": lambda: gather(
            opens & tag.isin(*HEADING_TAGS), *span,
            F.substring("tag", 2, 1).cast("int").alias("level")),
        "paragraphs": lambda: gather(opens & (tag == "p"), *span),
        "lists": lambda: gather(opens & tag.isin("ul", "ol"), "end", "tag", *counts),
        "items": lambda: gather(opens & (tag == "li"), *span),
        "tables": lambda: gather(opens & (tag == "table"), "end", *counts),
        "headers": lambda: gather(opens & (tag == "th"), *span),
        "rows": lambda: gather(opens & (tag == "tr"), "end", *counts),
        "cells": lambda: gather(opens & (tag == "td"), *span),
        "images": lambda: gather(
            opens & (tag == "img"), attrs["src"].alias("src"), attrs["alt"].alias("alt")),
        "links": lambda: gather(opens & (tag == "a"), *span, attrs["href"].alias("href")),
        "buttons": buttons,
        "meta": lambda: gather(
            (tag == "meta") & ~F.col("is_close"), attrs["name"].alias("name"),
            attrs["property"].alias("property"), attrs["content"].alias("content")),
        "json_ld": json_ld,
    }
    return marked.groupBy("page_id").agg(
        *[F.max(k).alias(k) for k in keep],
        F.coalesce(F.max("html_length"), F.lit(0)).alias("original_length"),
        *[make().alias(f"a_{name}") for name, make in arrays.items() if name in wanted],
    )


# Slices of a page's arrays, for use inside let(): `d` is the page, `e` an element.


def _at_end(d, e):
    return F.get(d["counts"], F.least(e["end"], F.size(d["counts"]) - 1))


def _text_of(d, e) -> Column:
    n = _at_end(d, e)["texts"] - e["text0"]
    return js_trim(F.array_join(F.slice(d["texts"], e["text0"] + 1, n), ""))


def _inside(d, e, kind, array) -> Column:
    return F.slice(array, e[kind] + 1, _at_end(d, e)[kind] - e[kind])


def _page(*arrays) -> Column:
    return F.struct(
        F.col("a_counts").alias("counts"),
        F.col("a_texts")["text"].alias("texts"),
        *[F.col(f"a_{a}").alias(a) for a in arrays],
    )


def _texts(d, array):
    return F.transform(array, lambda e: _text_of(d, e))


def _headings() -> Column:
    def build(d):
        found = F.transform(
            d["headings"],
            lambda e: F.struct(e["level"].alias("level"), e["i"].alias("i"),
                               _text_of(d, e).alias("text")),
        )
        by_level = F.sort_array(F.filter(found, lambda h: h["text"] != ""))
        return F.transform(by_level, lambda h: F.struct(h["level"], h["text"]))

    return let(_page("headings"), build)


def _lists() -> Column:
    def build(d):
        def with_items(items):
            return F.transform(
                d["lists"],
                lambda e: F.struct(
                    F.when(e["tag"] == "ol", "ordered").otherwise("unordered").alias("type"),
                    F.filter(_inside(d, e, "items", items), lambda t: t != "").alias("items"),
                ),
            )

        lists = let(_texts(d, d["items"]), with_items)
        return F.filter(lists, lambda x: F.size(x["items"]) > 0)

    return let(_page("lists", "items"), build)


def _tables() -> Column:
    def build(d):
        texts = F.struct(
            _texts(d, d["headers"]).alias("headers"), _texts(d, d["cells"]).alias("cells")
        )

        def with_rows(x):
            rows = F.transform(d["rows"], lambda r: _inside(d, r, "cells", x["cells"]))
            return let(rows, lambda cells_of_rows: F.transform(
                d["tables"],
                lambda e: F.struct(
                    F.filter(_inside(d, e, "headers", x["headers"]), lambda t: t != "")
                    .alias("headers"),
                    F.filter(_inside(d, e, "rows", cells_of_rows),
                             lambda cells: F.exists(cells, lambda c: c != "")).alias("rows"),
                ),
            ))

        return F.filter(
            let(texts, with_rows), lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0)
        )

    return let(_page("tables", "headers", "rows", "cells"), build)


def _images() -> Column:
    kept = F.filter("a_images", lambda e: (e["src"] != "") & ~e["src"].startswith("data:"))
    return F.transform(kept, lambda e: F.struct(e["src"], e["alt"]))


def _links() -> Column:
    def build(d):
        kept = F.filter(
            d["links"],
            lambda e: (e["href"] != "") & ~e["href"].rlike("^(?:#|javascript:)"),
        )
        links = F.transform(
            kept, lambda e: F.struct(_text_of(d, e).alias("text"), e["href"].alias("href"))
        )
        return F.filter(links, lambda x: x["text"] != "")

    return let(_page("links"), build)


def _buttons() -> Column:
    def build(d):
        texts = F.transform(
            d["buttons"],
            lambda e: F.struct(
                F.coalesce(non_empty(_text_of(d, e)), non_empty(e["value"])).alias("text")
            ),
        )
        return F.filter(texts, lambda x: x["text"].isNotNull())

    return let(_page("buttons"), build)


def _paragraphs() -> Column:
    return let(
        _page("paragraphs"),
        lambda d: F.filter(_texts(d, d["paragraphs"]), lambda t: t != ""),
    )


def _meta() -> Column:
    kept = F.filter(
        "a_meta",
        lambda e: (e["name"].isNotNull() | e["property"].isNotNull()) & (e["content"] != ""),
    )
    return F.transform(kept, lambda e: F.struct(e["name"], e["property"], e["content"]))


def _json_ld() -> Column:
    """Blocks that parse, as written; pretty-printing is left to the reader."""
    texts = F.filter("a_json_ld", lambda e: F.try_parse_json(e["json"]).isNotNull())
    return F.transform(texts, lambda e: e["json"])


def _visible_text() -> Column:
    runs = F.split(F.array_join(F.col("a_parts")["piece"], ""), BREAK)
    parts = F.filter(F.transform(runs, js_trim), lambda p: p != "")

    def join(ps):
        kept = F.filter(ps, lambda p, k: (k == 0) | (p != F.get(ps, k - 1)))
        return F.array_join(kept, "\n")

    return let(parts, join)


# Column of the cleaning result: how it is built, and from which arrays.
_TEXT = {"counts", "texts"}
_CLEAN_COLUMNS = {
    "cleaned_html": (lambda: F.array_join("a_html", ""), {"html"}),
    "visible_text": (_visible_text, {"parts"}),
    "headings": (_headings, _TEXT | {"headings"}),
    "lists": (_lists, _TEXT | {"lists", "items"}),
    "tables": (_tables, _TEXT | {"tables", "headers", "rows", "cells"}),
    "images": (_images, {"images"}),
    "links": (_links, _TEXT | {"links"}),
    "buttons": (_buttons, _TEXT | {"buttons"}),
    "meta": (_meta, {"meta"}),
    "paragraphs": (_paragraphs, _TEXT | {"paragraphs"}),
    "json_ld": (_json_ld, {"json_ld"}),
    "original_length": (lambda: F.col("original_length"), set()),
    "removed_by_group": (lambda: count_removed(F.col("a_matches")), {"matches"}),
}
CLEAN_COLUMNS = list(_CLEAN_COLUMNS)
STATS_COLUMNS = ["original_length", "cleaned_html", "visible_text", "removed_by_group"]
COUNTED_COLUMNS = ["headings", "lists", "tables", "images", "links", "buttons", "meta"]
DOCUMENT_COLUMNS = [
    "meta", "json_ld", "headings", "visible_text", "tables", "images", "lists", "links",
]


def clean_pages(
    pages: DataFrame, columns: list | None = None, keep: tuple = ("url",),
    colocated: bool = False, rules=None, in_tree_order: bool = False,
) -> DataFrame:
    """The cleaning result: one row per page.

    cleaned_html, visible_text, headings, lists, tables, images, links, buttons, meta,
    paragraphs, json_ld (blocks found on the page) and the size and removal figures.
    Name `columns` to plan only those.  `rules=[]` cleans nothing away.  With
    `in_tree_order`, misnested tags make the tree that a parser makes of them.
    """
    if SORTED_FOLD[0] not in pages.sparkSession.conf.getAll:
        pages.sparkSession.conf.set(*SORTED_FOLD)
    columns = CLEAN_COLUMNS if columns is None else columns
    wanted = set().union(*[_CLEAN_COLUMNS[c][1] for c in columns])
    pages = pages.withColumn("html_length", utf16_length("html"))
    marked = _with_counts(mark_removed(tree(pages, colocated, (*keep, "html_length"), in_tree_order), rules))
    arrays = _page_arrays(marked, keep, wanted)
    return arrays.select("page_id", *keep, *[_CLEAN_COLUMNS[c][0]().alias(c) for c in columns])


def stats_columns() -> list[tuple[str, Column]]:
    """Size and removal figures of a cleaning result, by name."""
    return [
        ("original_length", F.col("original_length")),
        ("cleaned_length", utf16_length("cleaned_html")),
        ("elements_removed", F.aggregate("removed_by_group", F.lit(0), lambda a, n: a + n)),
        ("token_estimate", token_estimate(F.col("visible_text"))),
    ]


def clean_stats(clean: DataFrame) -> DataFrame:
    """(page_id, original_length, cleaned_length, elements_removed, token_estimate)."""
    return clean.select("page_id", *[column.alias(name) for name, column in stats_columns()])


def element_counts(clean: DataFrame) -> DataFrame:
    """Elements of each kind per page; 0 where there are none."""
    return clean.select("page_id", *[F.size(k).alias(k) for k in COUNTED_COLUMNS])


def _rows(clean: DataFrame, array: str) -> DataFrame:
    pos = F.posexplode(array).alias("ord", "e")
    return clean.select("page_id", pos).select("page_id", (F.col("ord") + 1).alias("ord"), "e.*")


def headings(clean: DataFrame) -> DataFrame:
    """(page_id, ord, level, text), by level, then in document order."""
    return _rows(clean, "headings")


def lists(clean: DataFrame) -> DataFrame:
    """(page_id, ord, type, items); an outer list repeats the items of inner lists."""
    return _rows(clean, "lists")


def tables(clean: DataFrame) -> DataFrame:
    """(page_id, ord, headers, rows) of tables with a header or a row."""
    return _rows(clean, "tables")


def table_headers(clean: DataFrame) -> DataFrame:
    """(page_id, ord, pos, header)."""
    return tables(clean).select("page_id", "ord", F.posexplode("headers").alias("pos", "header"))


def table_rows(clean: DataFrame) -> DataFrame:
    """(page_id, ord, pos, cells)."""
    return tables(clean).select("page_id", "ord", F.posexplode("rows").alias("pos", "cells"))


def images(clean: DataFrame) -> DataFrame:
    """(page_id, ord, src, alt)."""
    return _rows(clean, "images")


def links(clean: DataFrame) -> DataFrame:
    """(page_id, ord, text, href)."""
    return _rows(clean, "links")


def buttons(clean: DataFrame) -> DataFrame:
    """(page_id, ord, text)."""
    return _rows(clean, "buttons")


def meta_tags(clean: DataFrame) -> DataFrame:
    """(page_id, ord, name, property, content), taken before any removal."""
    return _rows(clean, "meta")


def existing_json_ld(clean: DataFrame) -> DataFrame:
    """(page_id, ord, json) of the valid JSON-LD blocks on the page."""
    pos = F.posexplode("json_ld").alias("ord", "json")
    return clean.select("page_id", pos).withColumn("ord", F.col("ord") + 1)


def preview_elements(
    clean: DataFrame,
    images: int = fixed.PREVIEW_IMAGE_LIMIT,
    links: int = fixed.PREVIEW_LINK_LIMIT,
) -> DataFrame:
    """The page's structured data with only its first images and links, to look at."""
    return clean.select(
        "page_id", "headings", "lists", "tables",
        F.slice("images", 1, images).alias("images"),
        F.slice("links", 1, links).alias("links"),
        "buttons", "meta",
    )
