"""HTML in one text column: the token pattern, attributes and selectors."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import RAW_TEXT_TAGS
from .text import decode_entities, let, lookup_table

# Possessive quantifiers keep the matcher from recursing on long pages.
_ATTRS = r"""(?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
_COMMENT = r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
_RAW = "|".join(
    rf"<(?i:{t})(?=[\s/>]){_ATTRS}>[\s\S]*?(?:</(?i:{t})(?=[\s/>])[^>]*+>|\z)"
    for t in RAW_TEXT_TAGS
)
_TAG = rf"</?[a-zA-Z][^\s/>]*+{_ATTRS}>"
_UNFINISHED_TAG = r"</?[a-zA-Z][\s\S]*+"
_DECLARATION = r"<[!?/][^>]*+(?:>|\z)"
_TEXT = r"(?:[^<]++|<(?![a-zA-Z/!?]))++"

TOKEN_PATTERN = "|".join([_COMMENT, _RAW, _TAG, _UNFINISHED_TAG, _DECLARATION, _TEXT])

_OPEN_TAG = rf"^<[a-zA-Z][^\s/>]*+({_ATTRS})>"
_ATTR = r"""[^\s/=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)?"""
_ATTR_VALUE = r"""(?s)^[^\s/=][^\s/>=]*\s*=\s*(["']?)(.*)\1$"""


def split_tokens(html) -> Column:
    """Array of tokens: comments, raw-text elements, tags, declarations, text."""
    return F.regexp_extract_all(html, F.lit(TOKEN_PATTERN), F.lit(0))


def tag_of(tok: Column) -> Column:
    """Lower-case tag name, or #text, #comment, #declaration, #unfinished."""
    name = F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))
    # text is known by its first character; a name is worked out for tags only, and once
    return (
        F.when(tok.isNull() | ~tok.startswith("<"), F.lit("#text"))
        .when(tok.rlike(r"^</?[a-zA-Z]"), F.when(tok.endswith(">"), name).otherwise(
            F.when(name.isin(*RAW_TEXT_TAGS), name).otherwise(F.lit("#unfinished"))))
        .when(tok.startswith("<!--"), F.lit("#comment"))
        .when(tok.rlike("^<[!?/]"), F.lit("#declaration"))
        .otherwise(F.lit("#text"))
    )


def attributes_of(tok: Column) -> Column:
    """MAP of attributes of an open tag: names in lower case, the first duplicate wins,
    a bare name is the empty text; null for a tag without attributes."""
    section = F.regexp_extract(tok, _OPEN_TAG, 1)
    parts = F.regexp_extract_all(section, F.lit(_ATTR), F.lit(0))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"^[^\s/=][^\s/>=]*", 0)).alias("key"),
            decode_entities(F.regexp_extract(p, _ATTR_VALUE, 2), in_attribute=True).alias("value"),
        ),
    )

    def first_of_each_name(es):
        firsts = F.filter(es, lambda e, n: F.array_position(es["key"], e["key"]) == n + 1)
        repeated = (F.size(es) > 1) & (F.size(F.array_distinct(es["key"])) < F.size(es))
        return F.when(repeated, firsts).otherwise(es)

    return F.when(
        tok.startswith("<") & tok.rlike(r"^<[a-zA-Z][^\s/>]*[\s/]+[^\s/>]"),
        let(entries, lambda es: F.map_from_entries(first_of_each_name(es))),
    )


def raw_content(tok: Column) -> Column:
    """Text of a raw-text element, between its open and its end tag."""
    return F.regexp_replace(
        F.regexp_replace(tok, rf"^<[a-zA-Z][^\s/>]*+{_ATTRS}>", ""), r"</[a-zA-Z]+[^>]*>\z", ""
    )


# --- selectors ---

_SIMPLE = re.compile(
    r"""\.(?P<cls>[\w-]+) | \#(?P<id>[\w-]+) |
        \[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<val>[^"]*)")?\] |
        :not\((?P<neg>[^()]+)\)""",
    re.X,
)


def classes_of(attrs: Column) -> Column:
    """Class names of an element, from its attribute map."""
    return F.regexp_extract_all(attrs["class"], F.lit(r"[^\t\n\f\r ]+"), F.lit(0))


def selector_condition(selector: str, tag: Column, attrs: Column) -> Column:
    """Does an element match: tag, .class, #id, [a], [a="v"], [a*="v"], :not(...)?"""
    name = re.match(r"[\w-]*", selector).group()
    rest = selector[len(name):]
    checks = [tag == name] if name else []
    for m in _SIMPLE.finditer(rest):
        if m["cls"]:
            check = F.array_contains(classes_of(attrs), m["cls"])
        elif m["id"]:
            check = attrs["id"] == m["id"]
        elif m["neg"]:
            check = ~selector_condition(m["neg"], tag, attrs)
        elif m["op"] == "=":
            value = attrs[m["attr"]]
            check = (F.lower(value) if m["attr"] == "type" else value) == m["val"]
        elif m["op"] == "*=":
            check = attrs[m["attr"]].contains(m["val"])
        else:
            check = attrs[m["attr"]].isNotNull()
        checks.append(F.coalesce(check, F.lit(False)))
    condition = checks[0]
    for check in checks[1:]:
        condition = condition & check
    return condition


def selector_rank(selectors: list[str], tag: Column, attrs: Column) -> Column:
    """1-based position of the first selector that matches, or null.

    Plain tag and class selectors, nearly all of them, are looked up in literal maps;
    only the others are tested one by one, and only on elements with attributes.
    """
    tags, classes, others, bare = {}, {}, [], []
    for rank, selector in enumerate(selectors, start=1):
        if re.fullmatch(r"[\w-]+", selector):
            tags.setdefault(selector, rank)
        elif re.fullmatch(r"\.[\w-]+", selector):
            classes.setdefault(selector[1:], rank)
        elif ":not(" in selector:
            bare.append((rank, selector))
        else:
            others.append((rank, selector))

    def lookup(ranks, key):
        return F.try_element_at(lookup_table(ranks, "int"), key)

    found = []
    if tags:
        found.append(lookup(tags, tag))
    if classes:
        by_class = F.array_min(F.transform(classes_of(attrs), lambda c: lookup(classes, c)))
        found.append(F.when(attrs["class"].isNotNull(), by_class))

    def ranks(tests):
        return [F.when(selector_condition(selector, tag, attrs), F.lit(rank)) for rank, selector in tests]

    if others:
        tested = ranks(others)
        found.append(F.when(attrs.isNotNull(), F.least(*tested) if len(tested) > 1 else tested[0]))
    found += ranks(bare)
    return F.least(*found) if len(found) > 1 else found[0]
