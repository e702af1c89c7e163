"""Pages to tokens to a tree: one row per token, every open tag with its subtree's end.

All windows share the prefix page_id, so one Exchange of the compact page rows feeds
them all (none if the pages table is bucketed by page_id).  A page is one cell, which
bounds what one window group can hold.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.html import attributes_of, raw_content, split_tokens, tag_of
from ..functions.text import decode_entities
from .nesting import in_order, token_order

PAGE_END = 2**31 - 1


#: HTML in a partition of spread_by_size.
BYTES_A_PARTITION = 8 << 20


def spread_by_size(pages: DataFrame) -> DataFrame:
    """Spread pages by page_id over shuffle partitions, or over more if there is more HTML than
    these should hold, so that what a task sorts does not grow with the table. Reads the pages once for
    their size; clean the result with colocated=True."""
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(partitions, -(-size // BYTES_A_PARTITION)), "page_id")


def by_page(pages: DataFrame, colocated: bool = False) -> DataFrame:
    """Spread pages over the cluster by page_id, before they are split into tokens.

    The number of partitions is given, so that AQE does not merge them by their compact
    size: a page grows when it is split, and the work per byte is high.  Set `colocated`
    for a table bucketed by page_id: its scan is spread that way already.
    """
    if colocated:
        return pages
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(partitions, "page_id")


def tokens(
    pages: DataFrame, colocated: bool = False, keep: tuple = (), in_tree_order: bool = False,
) -> DataFrame:
    """(page_id, i, tok, tag, is_close), in document order; i counts from 0.

    A page without any token keeps one row with a null i.  Page columns named in `keep`
    ride on the page's first row only, so they are not copied to every token.  With
    `in_tree_order`, tokens that are misnested come in the order of the page's tree; it is
    found before pages are spread, or read from a column token_order of theirs.
    """
    if in_tree_order and "token_order" not in pages.columns:
        pages = pages.withColumn("token_order", token_order(F.col("html")))
    pages, found = by_page(pages, colocated), split_tokens(F.col("html"))
    if in_tree_order:
        pages = pages.select("page_id", *keep, "token_order", found.alias("tokens"))
        found = in_order(F.col("tokens"), F.col("token_order"))
    split = pages.select("page_id", *keep, F.posexplode_outer(found).alias("i", "tok"))
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    return split.select(
        "page_id", "i", "tok",
        tag_of(F.col("tok")).alias("tag"),
        F.coalesce(F.col("tok").startswith("</") & F.col("tok").rlike("^</[a-zA-Z]"), F.lit(False)).alias("is_close"),
        *[F.when(first, F.col(k)).alias(k) for k in keep],
    )


def _pairs(toks: DataFrame) -> DataFrame:
    """Pair open and close tags of the same name: + level, pair (the close's i), step.

    The level of an open tag is the number of its name open after it, that of a close tag
    the number before it; so the next row of the same level is the partner.
    """
    tag, is_close = F.col("tag"), F.col("is_close")
    foreign_closed = tag.isin("svg", "math") & F.col("tok").endswith("/>")
    self_contained = (
        tag.startswith("#")
        | tag.isin(*fixed.VOID_TAGS, "html", "body")
        | (tag.isin(*fixed.RAW_TEXT_TAGS) & ~is_close)
        | foreign_closed
    )
    toks = toks.withColumn("step", F.when(self_contained, 0).when(is_close, -1).otherwise(1))
    by_tag = W.partitionBy("page_id", "tag").orderBy("i")
    next_same = F.struct(F.col("i"), F.col("is_close"))
    toks = toks.withColumns({
        "level": F.sum("step").over(by_tag.rowsBetween(W.unboundedPreceding, 0))
        + F.when(F.col("step") == -1, 1).otherwise(0),
        "next_same": F.lead(next_same).over(by_tag),
    })
    by_level = W.partitionBy("page_id", "tag", "level").orderBy("i")
    opens, closes = F.col("step") == 1, F.col("step") == -1
    return toks.withColumns({
        "pair": F.when(opens & (F.lead("step").over(by_level) == -1), F.lead("i").over(by_level)),
        "paired": (opens & (F.lead("step").over(by_level) == -1))
        | (closes & (F.lag("step").over(by_level) == 1)),
    })


def _next(value: str, partition: list[str]) -> Column:
    keys = ", ".join(partition)
    return F.expr(f"lead({value}) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY i)")


def nodes(toks: DataFrame) -> DataFrame:
    """+ end: for each open tag the i of the last token of its subtree.

    + needs_section, needs_row: a row or cell before which a table leaves out a section or row,
    and own_section_end, own_row_end: where that ends.

    An element ends at its own end tag, but no later than the container it stands in; a link or
    a button also ends before the next one, as they do not nest; an
    element whose end tag may be left out (p, li, dt, dd, td, th, tr, tbody, thead, tfoot,
    option) also ends before what implies its end.
    """
    tag, is_close, i = F.col("tag"), F.col("is_close"), F.col("i")
    opens = F.col("step") == 1
    paired_container = F.col("paired") & tag.isin(*fixed.CONTAINER_TAGS)

    # A token that ends a node carries the last i that still belongs to the node.
    def ender(condition, own_names):
        return F.when(condition, F.when(is_close & tag.isin(*own_names), i).otherwise(i - 1))

    cells = [*fixed.CELL_TAGS, "tr", *fixed.SECTION_TAGS]
    rows = ["tr", *fixed.SECTION_TAGS]
    p_ends = (
        (opens & tag.isin(*fixed.PARAGRAPH_ENDERS))
        | (tag == "hr")
        | (is_close & tag.isin("p", "li", "dd", "dt"))
        | tag.isin(*cells, "caption")
    )
    toks = _pairs(toks).withColumns({
        "p_mark": ender(p_ends, ["p"]),
        "depth_step": F.when(paired_container, F.col("step")).otherwise(0),
    })
    in_page = W.partitionBy("page_id").orderBy("i")
    toks = toks.withColumns({
        "p_end": _next("p_mark", ["page_id"]),
        "depth": F.sum("depth_step").over(in_page.rowsBetween(W.unboundedPreceding, 0))
        + F.when(F.col("depth_step") == -1, 1).otherwise(0),
    })
    # Rows of one depth stand in the same container until the next container's close.
    toks = toks.withColumns({
        "close_mark": F.when(F.col("depth_step") == -1, i),
        "item_mark": F.when(tag == "li", ender(F.lit(True), ["li"])),
        "term_mark": F.when(tag.isin("dt", "dd"), ender(F.lit(True), ["dt", "dd"])),
        "option_mark": F.when(tag.isin("option", "optgroup"), ender(F.lit(True), ["option"])),
        "cell_mark": F.when(tag.isin(*cells), ender(F.lit(True), fixed.CELL_TAGS)),
        "row_mark": F.when(tag.isin(*rows), ender(F.lit(True), ["tr"])),
        "section_mark": F.when(
            tag.isin(*fixed.SECTION_TAGS), ender(F.lit(True), fixed.SECTION_TAGS)
        ),
    })
    marks = ["close", "item", "term", "option", "cell", "row", "section"]
    # The last tag of a table's frame before this one, in the same table.
    frame = F.when(tag == "table", "table").when(tag.isin(*fixed.SECTION_TAGS), "section").when(
        tag == "tr", "row").when(tag.isin(*fixed.CELL_TAGS), "cell")
    earlier = W.partitionBy("page_id", "depth").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    ended = F.when(is_close, F.concat(F.lit("/"), frame)).otherwise(frame)
    toks = toks.withColumns({
        **{f"{m}_end": _next(f"{m}_mark", ["page_id", "depth"]) for m in marks},
        "frame": F.last(ended, ignorenulls=True).over(earlier),
    })

    own = (
        F.when(tag == "p", F.col("p_end"))
        .when(tag == "li", F.col("item_end"))
        .when(tag.isin("dt", "dd"), F.col("term_end"))
        .when(tag == "option", F.col("option_end"))
        .when(tag.isin(*fixed.CELL_TAGS), F.col("cell_end"))
        .when(tag == "tr", F.col("row_end"))
        .when(tag.isin(*fixed.SECTION_TAGS), F.col("section_end"))
        .when(
            tag.isin("a", "button"),
            F.col("next_same.i") - F.when(F.col("next_same.is_close"), 0).otherwise(1),
        )
        .otherwise(F.col("pair"))
    )
    container = F.when(F.col("close_end") == F.col("pair"), F.col("pair")).otherwise(
        F.col("close_end") - 1
    )
    end = (
        F.when(opens, F.coalesce(F.least(own, container), F.lit(PAGE_END)))
        .when(tag.isin("html", "body") & ~is_close, F.lit(PAGE_END))
        .when(~tag.startswith("#") & ~is_close, i)
    )
    is_row, is_cell = opens & (tag == "tr"), opens & tag.isin(*fixed.CELL_TAGS)
    toks = toks.withColumns({
        "needs_section": F.coalesce((is_row | is_cell) & F.col("frame").isin("table", "/section"), F.lit(False)),
        "needs_row": F.coalesce(is_cell & F.col("frame").isin("table", "section", "/section", "/row"), F.lit(False)),
        "own_section_end": F.coalesce(F.least(F.col("section_end"), container), F.lit(PAGE_END)),
        "own_row_end": F.coalesce(F.least(F.col("row_end"), container), F.lit(PAGE_END)),
    })
    helpers = ["frame", "step", "level", "next_same", "pair", "depth_step", "depth", "p_mark", "p_end"]
    helpers += [f"{m}_mark" for m in marks] + [f"{m}_end" for m in marks]
    return toks.withColumn("end", end).drop(*helpers)


def with_attrs(node_rows: DataFrame) -> DataFrame:
    """+ attrs MAP<STRING,STRING> of every open tag; null without attributes."""
    return node_rows.withColumn("attrs", F.when(~F.col("is_close"), attributes_of(F.col("tok"))))


def with_text(node_rows: DataFrame) -> DataFrame:
    """+ text: the decoded text of a text token or of a raw-text element; else null."""
    tag, tok = F.col("tag"), F.col("tok")
    return node_rows.withColumn(
        "text",
        F.when(tag == "#text", decode_entities(tok))
        .when(F.col("is_close"), None)
        .when(tag.isin("textarea", "title"), decode_entities(raw_content(tok)))
        .when(tag.isin(*fixed.RAW_TEXT_TAGS), raw_content(tok)),
    )


def tree(
    pages: DataFrame, colocated: bool = False, keep: tuple = (), in_tree_order: bool = False,
) -> DataFrame:
    """Tokens with subtree ends, attributes and decoded text."""
    return with_text(with_attrs(nodes(tokens(pages, colocated, keep, in_tree_order))))
