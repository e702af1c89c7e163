"""Removal by rule, over the token table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.html import selector_rank
from ..functions.text import js_trim

# (selector, group, counted) in the order of removal.
REMOVAL_RULES = [
    *[(s, 1, True) for s in fixed.TECHNICAL_SELECTORS],
    (fixed.JSON_LD_SELECTOR, 1, False),
    *[(s, 2, True) for s in fixed.HIDDEN_SELECTORS],
    *[(s, 3, True) for s in fixed.BOILERPLATE_SELECTORS],
]


def match_selectors(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """+ rank: position of the first matching selector, null if none matches."""
    rank = selector_rank(selectors, F.col("tag"), F.col("attrs"))
    return nodes.withColumn(
        "rank", F.when(~F.col("is_close") & ~F.col("tag").startswith("#"), rank)
    )


def _group_of(rank: Column) -> Column:
    last1 = len(fixed.TECHNICAL_SELECTORS) + 1
    last2 = last1 + len(fixed.HIDDEN_SELECTORS)
    return F.when(rank <= last1, 1).when(rank <= last2, 2).when(rank.isNotNull(), 3)


def mark_removed(tree: DataFrame, rules=None) -> DataFrame:
    """+ rank, grp, removed, removed_before, in_body, after_body.

    A token is removed if a matched element at or before it has not ended yet: a running
    maximum over the page, no join.  The body starts at its tag, or at the first token
    that cannot stand in the head.  `rules=[]` keeps everything.
    """
    i, tag, is_close = F.col("i"), F.col("tag"), F.col("is_close")
    rules = REMOVAL_RULES if rules is None else rules
    if rules:
        marked = match_selectors(tree, [rule[0] for rule in rules])
    else:
        marked = tree.withColumn("rank", F.lit(None).cast("int"))
    so_far = (
        W.partitionBy("page_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before = W.partitionBy("page_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    removal_end = F.max(F.when(F.col("rank").isNotNull(), F.col("end")))
    starts_body = ((tag == "#text") & (js_trim("text") != "")) | (
        ~tag.startswith("#") & ~is_close & ~tag.isin(*fixed.HEAD_TAGS)
    )
    ends_body = is_close & tag.isin("body", "html")
    return marked.withColumns({
        "grp": _group_of(F.col("rank")),
        "removed": F.coalesce(removal_end.over(so_far) >= i, F.lit(False)),
        "removed_before": F.coalesce(removal_end.over(before) >= i, F.lit(False)),
        "in_body": F.coalesce(F.bool_or(starts_body).over(so_far), F.lit(False)),
        "after_body": F.coalesce(F.bool_or(ends_body).over(so_far), F.lit(False)),
    })


def removals(tree: DataFrame, group: int | None = None) -> DataFrame:
    """Elements that match a removal rule: (page_id, start, end, tag, rank, grp)."""
    marked = match_selectors(tree, [rule[0] for rule in REMOVAL_RULES])
    found = marked.where(F.col("rank").isNotNull()).select(
        "page_id", F.col("i").alias("start"), "end", "tag", "rank",
        _group_of(F.col("rank")).alias("grp"),
    )
    return found if group is None else found.where(F.col("grp") == group)


def surviving_tokens(marked: DataFrame) -> DataFrame:
    """Tokens outside every removed subtree."""
    return marked.where(F.col("i").isNotNull() & ~F.col("removed"))


_RULE_COUNTED = [counted for _, _, counted in REMOVAL_RULES]


def count_removed(matches) -> Column:
    """Counted removals per group, as ARRAY of 3, from a page's matched elements.

    `matches` is an array of structs (i, end, rank, grp) in document order.  Rules run in
    order on what is left, so an element counts unless it stands inside one removed by an
    earlier rule.  One pass keeps, for each rule, the furthest end seen so far.
    """
    rules = len(REMOVAL_RULES)
    state = F.struct(
        F.array_repeat(F.lit(-1), rules).alias("ends"),
        F.array_repeat(F.lit(0), 3).alias("counts"),
    )
    counted = F.array(*[F.lit(c) for c in _RULE_COUNTED])

    def step(acc, m):
        gone = F.exists(F.slice(acc["ends"], F.lit(1), m["rank"] - 1), lambda end: end >= m["i"])
        adds = ~gone & F.get(counted, m["rank"] - 1)
        return F.struct(
            F.transform(
                acc["ends"],
                lambda end, r: F.when(r == m["rank"] - 1, F.greatest(end, m["end"])).otherwise(end),
            ).alias("ends"),
            F.transform(
                acc["counts"],
                lambda n, g: F.when(adds & (g == m["grp"] - 1), n + 1).otherwise(n),
            ).alias("counts"),
        )

    return F.aggregate(matches, state, step, lambda acc: acc["counts"])


def removal_counts(marked: DataFrame) -> DataFrame:
    """(page_id, technical, hidden, boilerplate, elements_removed)."""
    match = F.struct("i", "end", "rank", "grp")
    pages = marked.groupBy("page_id").agg(
        F.collect_list(F.when(F.col("rank").isNotNull(), match)).alias("matches")
    )
    counts = pages.select("page_id", count_removed(F.sort_array("matches")).alias("n"))
    n = [F.get("n", F.lit(k)) for k in range(3)]
    return counts.select(
        "page_id",
        n[0].alias("technical"), n[1].alias("hidden"), n[2].alias("boilerplate"),
        (n[0] + n[1] + n[2]).alias("elements_removed"),
    )
