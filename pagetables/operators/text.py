"""Text of a page as rows, and the other ways of putting it together."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import js_trim
from .elements import is_ignored, is_plain_text, part_array


def text_parts(marked: DataFrame) -> DataFrame:
    """(page_id, i, k, text): visible parts in document order, from the body on.

    A text node is what stands between two elements, comments or removed subtrees; tokens that a
    parser ignores don't split it. It has the i of its first token.
    """
    order = W.partitionBy("page_id").orderBy("i")
    kept = ~F.col("removed")
    breaks = ~kept | ~(is_plain_text() | is_ignored())
    body = marked.where("in_body").withColumn(
        "run", F.sum(F.when(breaks, 1).otherwise(0)).over(order))
    texts = body.where(kept & is_plain_text()).groupBy("page_id", "run").agg(
        F.sort_array(F.collect_list(F.struct("i", "text"))).alias("pieces"))
    texts = texts.select(
        "page_id", F.col("pieces")[0]["i"].alias("i"), F.lit(0).alias("k"),
        js_trim(F.array_join(F.col("pieces")["text"], "")).alias("text")).where("text <> ''")
    others = body.where(kept & ~is_plain_text()).select(
        "page_id", "i", F.posexplode(part_array()).alias("k", "text"))
    return texts.union(others)


def dedupe_adjacent(parts: DataFrame) -> DataFrame:
    """Drop a part that equals the one just before it."""
    order = W.partitionBy("page_id").orderBy("i", "k")
    before = F.lag("text").over(order)
    return (
        parts.withColumn("before", before)
        .where(F.col("before").isNull() | (F.col("before") != F.col("text")))
        .drop("before")
    )


def visible_text(clean: DataFrame) -> DataFrame:
    """(page_id, visible_text)."""
    return clean.select("page_id", "visible_text")


def paragraph_text(clean: DataFrame, min_len: int = fixed.MIN_PARAGRAPH_LENGTH) -> DataFrame:
    """Headings, then paragraphs and list items of at least `min_len` characters."""
    long_enough = lambda t: F.length(t) >= min_len
    items = F.flatten(F.col("lists")["items"])
    parts = F.concat(
        F.col("headings")["text"],
        F.filter("paragraphs", long_enough),
        F.filter(items, long_enough),
    )
    return clean.select("page_id", F.array_join(parts, "\n\n").alias("paragraph_text"))


def flatten_text(marked: DataFrame) -> DataFrame:
    """All parts of a page, one per line, repeats kept."""
    ordered = F.sort_array(F.collect_list(F.struct("i", "k", "text")))
    return text_parts(marked).groupBy("page_id").agg(
        F.array_join(ordered["text"], "\n").alias("flat_text")
    )


def merge_facts(texts: DataFrame, facts: DataFrame, text: str = "visible_text") -> DataFrame:
    """Facts, one per line, a blank line, then the page's text.

    `facts` is (page_id, ord, fact).  A page without facts still gets the blank line.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ord", "fact")))
    by_page = facts.groupBy("page_id").agg(F.array_join(ordered["fact"], "\n").alias("facts"))
    return texts.join(by_page, "page_id", "left").select(
        "page_id",
        F.concat(F.coalesce("facts", F.lit("")), F.lit("\n\n"), F.col(text)).alias("merged_text"),
    )
