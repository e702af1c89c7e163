"""The tree written out again: what a parser's serialiser gives for the tokens that are left."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import escape_attribute, escape_text

#: Raw-text elements whose content is read, and so written, with character references.
_ESCAPED_RAW = ["textarea", "title"]


def _attributes(attrs: Column) -> Column:
    """Attributes as written first, each name once, values in double quotes."""
    parts = F.transform(
        F.map_entries(attrs),
        lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_attribute(e["value"]), F.lit('"')),
    )
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def _comment(tok: Column) -> Column:
    """A comment, also one that a parser makes of a declaration; a doctype gives none."""
    data = F.regexp_replace(F.regexp_replace(tok, "^<!--(?:-?>)?", ""), r"--!?>\z", "")
    bogus = F.regexp_replace(F.regexp_replace(tok, r"^<[!/]?", ""), r">\z", "")
    return F.when(tok.startswith("<!--"), F.concat(F.lit("<!--"), data, F.lit("-->"))).when(
        ~tok.rlike("(?i)^<!doctype") & (tok != "</>"), F.concat(F.lit("<!--"), bogus, F.lit("-->"))
    )


def begins() -> Column:
    """What a token writes where it stands: its start tag, text or comment; null for nothing."""
    tag, tok, text = F.col("tag"), F.col("tok"), F.col("text")
    start = F.concat(F.lit("<"), tag, _attributes(F.col("attrs")), F.lit(">"))
    raw = F.when(tag.isin(*_ESCAPED_RAW), escape_text(text)).otherwise(text)
    stray = F.col("is_close") & ~F.coalesce(F.col("paired"), F.lit(False))
    return (
        F.when(tag == "#text", escape_text(text))
        .when(tag.isin("#comment", "#declaration"), _comment(tok))
        .when(tag == "#unfinished", None)
        # an end tag without a start tag is skipped, but these two make an element
        .when(stray & (tag == "p"), F.lit("<p></p>"))
        .when(stray & (tag == "br"), F.lit("<br>"))
        .when(F.col("is_close"), None)
        .when(tag.isin(*fixed.RAW_TEXT_TAGS), F.concat(start, raw, F.lit("</"), tag, F.lit(">")))
        .otherwise(start)
    )


def has_end_tag() -> Column:
    """Does a start tag have an end tag of its own, written at the end of its subtree?"""
    tag = F.col("tag")
    return ~F.col("is_close") & ~tag.startswith("#") & ~tag.isin(*fixed.VOID_TAGS, *fixed.RAW_TEXT_TAGS)


def written(alive: Column, alive_before: Column, in_tree: Column) -> Column:
    """The pieces of a page in the order in which they are written, to be joined.

    `alive`: tokens that are left; `alive_before`: those outside removed elements that began
    earlier; `in_tree`: tokens that belong to the tree at all. End tags stand after the last token of
    their subtree, those of inner elements first. Sections and rows that a table leaves
    out are written too.
    """
    i = F.col("i")

    def piece(at, order, rank, text):
        return F.struct(
            at.alias("at"), F.lit(order).alias("order"), (-i).alias("back"),
            F.lit(rank).alias("rank"), text.alias("text"))

    def gather(condition, struct):
        return F.collect_list(F.when(condition, struct))

    section = alive_before & in_tree & F.col("needs_section")
    row = alive_before & in_tree & F.col("needs_row")
    start = F.concat(
        F.when(section, "<tbody>").otherwise(""), F.when(row, "<tr>").otherwise(""),
        F.when(alive & in_tree, F.coalesce(begins(), F.lit(""))).otherwise(""))
    end = F.concat(F.lit("</"), F.col("tag"), F.lit(">"))
    pieces = F.concat(
        gather(start != "", piece(i, 0, 0, start)),
        gather(alive & in_tree & has_end_tag(), piece(F.col("end"), 1, 0, end)),
        gather(row, piece(F.col("own_row_end"), 1, 1, F.lit("</tr>"))),
        gather(section, piece(F.col("own_section_end"), 1, 2, F.lit("</tbody>"))),
    )
    return F.sort_array(pieces)["text"]
