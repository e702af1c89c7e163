"""Text helpers as Column expressions."""

import json
from html import entities as _entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHARS_PER_TOKEN, WINDOWS_1252

# Space characters that a script's trim() strips: ASCII controls, NBSP, the Unicode
# space separators, line separators and the byte order mark.
JS_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# All named references come from the standard library. Some old ones need no semicolon.
_NAMED = {n[:-1]: text for n, text in _entities.html5.items() if n.endswith(";")}
_OPEN_NAMES = sorted((n for n in _entities.html5 if not n.endswith(";")), key=len, reverse=True)

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|[^&]++|&"


def let(value: Column, body) -> Column:
    """Bind `value` once per row for use inside `body`, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(col) -> Column:
    """Strip every Unicode space at both ends; spaces inside stay."""
    return F.btrim(col, F.lit(JS_SPACE))


def non_empty(col) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(col, F.lit(""))


def utf16_length(col) -> Column:
    """Length as scripts count it: a character beyond U+FFFF is two."""
    col = F.col(col) if isinstance(col, str) else col
    units = (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(col) == F.length(col), F.length(col)).otherwise(units)


def token_estimate(col) -> Column:
    return F.ceil(utf16_length(col) / CHARS_PER_TOKEN).cast("long")


def escape_text(col: Column) -> Column:
    """Text as a serialiser writes it."""
    for char, reference in [("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")]:
        col = F.replace(col, F.lit(char), F.lit(reference))
    return col


def escape_attribute(col: Column) -> Column:
    """An attribute value as a serialiser writes it between double quotes."""
    for char, reference in [("&", "&amp;"), ("\u00a0", "&nbsp;"), ('"', "&quot;")]:
        col = F.replace(col, F.lit(char), F.lit(reference))
    return col


def lookup_table(pairs: dict, kind: str) -> Column:
    """A literal map; written as one JSON literal, which is folded when planning."""
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{kind}>")


def word_list(words) -> Column:
    """A literal array of words without spaces."""
    return F.split(F.lit(" ".join(words)), " ")


def code_point(number: Column) -> Column:
    """The character of a code point, as HTML reads numeric references."""
    cp1252 = lookup_table(WINDOWS_1252, "int")
    usable = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    number = F.coalesce(F.try_element_at(cp1252, number.cast("string")), number)
    char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
    return F.when(usable, char).otherwise(F.lit("\ufffd"))


def _reference(ref: Column, in_attribute: bool) -> Column:
    body = F.regexp_replace(ref, "^&#?|;$", "")
    closed = ref.endswith(";")
    # a number too long for a code point is none, however many zeros it begins with
    hex_digits = F.regexp_replace(body, "^[xX]0*", "")
    hexadecimal = F.when(F.length(hex_digits) <= 6, F.conv(hex_digits, 16, 10).try_cast("int"))
    decimal_digits = F.regexp_replace(body, "^0+(?=[0-9])", "")
    decimal = F.when(F.length(decimal_digits) <= 7, decimal_digits.try_cast("int"))
    table = lookup_table(_NAMED, "string")
    named = F.when(closed, F.try_element_at(table, body))
    # without a semicolon, or with an unknown name, the longest old name that begins it counts
    begins = F.regexp_extract(body, f"^(?:{'|'.join(_OPEN_NAMES)})", 0)
    opened = F.when(begins != "", F.concat(
        F.try_element_at(table, begins), F.substr(ref, F.length(begins) + 2)))
    if in_attribute:
        opened = F.lit(None).cast("string")
    return (
        F.when(~ref.startswith("&") | (ref == "&"), ref)
        .when(ref.isin("&amp;", "&AMP;"), F.lit("&"))
        .when(ref == "&quot;", F.lit('"'))
        .when(ref == "&lt;", F.lit("<"))
        .when(ref == "&gt;", F.lit(">"))
        .when(ref == "&nbsp;", F.lit("\u00a0"))
        .when(ref.rlike("^&#[xX]"), code_point(F.coalesce(hexadecimal, F.lit(0))))
        .when(ref.startswith("&#"), code_point(F.coalesce(decimal, F.lit(0))))
        .otherwise(F.coalesce(named, opened, ref))
    )


def decode_entities(col, in_attribute: bool = False) -> Column:
    """Decode character references; unknown names stay as written.

    In attributes a name needs its semicolon, so that query strings stay whole.
    """
    col = F.col(col) if isinstance(col, str) else col
    parts = F.regexp_extract_all(col, F.lit(_REFERENCE), F.lit(0))
    decoded = F.array_join(F.transform(parts, lambda p: _reference(p, in_attribute)), "")
    return F.when(F.instr(col, "&") > 0, decoded).otherwise(col)


def number_text(col: Column) -> Column:
    """A number as scripts print it: no trailing zeros, no exponent for everyday sizes."""
    plain = col.cast("string")
    wide = F.regexp_replace(plain.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    return F.when(plain.contains("E"), F.coalesce(wide, plain)).otherwise(
        F.regexp_replace(plain, r"\.0$", "")
    )
