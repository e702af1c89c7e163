"""Reading loose JSON with the truth rules of scripts, and writing JSON by hand.

A fragment is JSON text: SQL null means the key is absent, the text `null` that it is
written as null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def field(value: Column, *path: str) -> Column:
    """VARIANT at a path of keys; SQL null if absent."""
    return F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in path), "variant")


def elements(value: Column) -> Column:
    """ARRAY<VARIANT> of a JSON array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    """STRING of a JSON string, number or boolean, else null."""
    return F.try_variant_get(value, "$", "string")


# How the JSON text of each kind of value begins.
_BEGINS = {
    "string": '"', "number": "[-0-9]", "boolean": "[tf]", "array": r"\[", "object": r"\{",
    "null": "n",
}


def frag_is(frag: Column, *kinds: str) -> Column:
    """Is a fragment a string, number, boolean, array, object or null?  False if absent."""
    begins = "|".join(_BEGINS[k] for k in kinds)
    return F.coalesce(frag.rlike(f"^(?:{begins})"), F.lit(False))


def is_kind(value: Column, *kinds: str) -> Column:
    return frag_is(F.to_json(value), *kinds)


def fragment(value: Column) -> Column:
    """JSON text of a value; SQL null if absent."""
    return F.to_json(value)


_UNSET = r'^(?:null|""|false|-?0(?:\.0*)?(?:E.*)?)$'


def frag_is_set(frag: Column) -> Column:
    """Neither absent, null, '', 0 nor false."""
    return F.coalesce(~frag.rlike(_UNSET), F.lit(False))


def is_set(value: Column) -> Column:
    return frag_is_set(F.to_json(value))


def if_set(value: Column, then=None) -> Column:
    """Fragment of a value that is set, or what `then` makes of it; SQL null otherwise."""
    return let(
        F.to_json(value), lambda f: F.when(frag_is_set(f), f if then is None else then(f))
    )


def text_of(value: Column) -> Column:
    """What a script gets when it turns the value into text; null if absent or null."""
    def spell(f):
        return (
            F.when(frag_is(f, "string"), as_text(value))
            .when(frag_is(f, "array"), F.regexp_replace(f, r'[\[\]"]', ""))
            .when(frag_is(f, "object"), F.lit("[object Object]"))
            .when(f != "null", f)
        )

    return let(F.to_json(value), spell)


def compact_json(text) -> Column:
    """JSON text without the white space between its parts, keys in the order they have; null if it is none."""
    text = F.col(text) if isinstance(text, str) else text
    nested = text.rlike(r"^\s*[\[{]")
    return F.when(nested, F.get_json_object(text, "$")).otherwise(F.to_json(F.try_parse_json(text)))


def in_order(frag: Column, text: Column) -> Column:
    """A fragment with its keys as they were written: `text` is the JSON text that it was read from.

    VARIANT sorts the keys of objects; values that are passed through as they are keep their order.
    """
    nested = frag_is(frag, "object", "array") & text.isNotNull()
    return F.when(nested, F.coalesce(compact_json(text), frag)).otherwise(frag)


def quoted(text: Column) -> Column:
    """A text as a JSON string; SQL null becomes the fragment null."""
    return F.regexp_extract(F.to_json(F.array(text)), r"^\[([\s\S]*)\]$", 1)


def or_null(frag: Column) -> Column:
    """A fragment that is written as null when there is no value."""
    return F.coalesce(frag, F.lit("null"))


def entry_list(entries: list[tuple[str, Column]]) -> Column:
    """ARRAY of `"key":fragment`, null where the fragment is absent."""
    return F.array(*[F.concat(F.lit(f'"{key}":'), frag) for key, frag in entries])


def json_object(*entries: tuple[str, Column]) -> Column:
    """JSON object of the entries that are not absent, in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", entry_list(list(entries))), F.lit("}"))


def json_array(frags: Column) -> Column:
    """JSON array of an ARRAY of fragments."""
    return F.concat(F.lit("["), F.array_join(frags, ","), F.lit("]"))


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|\{\s*\}|\[\s*\]|[{}\[\],:]|[^\s{}\[\],:"]++'


#: Tokens that pretty_json folds at a time.
_PRETTY_CHUNK = 256


def pretty_json(text) -> Column:
    """JSON text with an indent of two spaces, keys in the order they have.

    A fold copies what it has at every step, so the tokens are folded in short chunks; the depth
    at which each chunk begins is summed up first.
    """
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))
    opens, closes = (lambda t: t.isin("{", "[")), (lambda t: t.isin("}", "]"))

    def step(acc, t):
        deeper, out = acc["depth"] + 1, acc["depth"] - 1
        depth = F.when(opens(t), deeper).when(closes(t), out).otherwise(acc["depth"])
        spelled = (
            F.when(opens(t), F.concat(t, line(deeper)))
            .when(closes(t), F.concat(line(out), t))
            .when(t == ",", F.concat(t, line(acc["depth"])))
            .when(t == ":", F.lit(": "))
            .when(t.rlike(r"^[{\[]"), F.regexp_replace(t, r"\s", ""))
            .otherwise(t)
        )
        return F.struct(depth.alias("depth"), F.concat(acc["cur"], spelled).alias("cur"))

    def fold(chunk, base):
        start = F.struct(base.alias("depth"), F.lit("").alias("cur"))
        return F.aggregate(chunk, start, step, lambda acc: acc["cur"])

    def bases(chunks):
        rise = F.transform(chunks, lambda c: F.size(F.filter(c, opens)) - F.size(F.filter(c, closes)))
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(rise, start, lambda acc, n: F.struct(
            (acc["sum"] + n).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at"),
        ), lambda acc: acc["at"])

    def whole(toks):
        last = F.ceil(F.size(toks) / _PRETTY_CHUNK).cast("int") - 1
        chunks = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.slice(toks, k * _PRETTY_CHUNK + 1, F.lit(_PRETTY_CHUNK)))
        joined = let(chunks, lambda cs: let(bases(cs), lambda bs: F.array_join(
            F.transform(cs, lambda c, k: fold(c, F.get(bs, k))), "")))
        return F.when(F.size(toks) > 0, joined).otherwise(F.when(toks.isNotNull(), ""))

    return let(F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0)), whole)
