"""Host names in standard spelling as Column expressions: percent-encoding, other scripts, numbers as addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, non_empty

_FORBIDDEN = r"""[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7f]"""
_NUMBER = r"^(?:[0-9]+|0x[0-9a-f]*)$"
# Fixed values of RFC 3492.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _START_BIAS, _START = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits and divisions that a 32-bit delta needs at most.
_STEPS = 7


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """Bias after a delta."""
    damped = F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2))
    limit = (_BASE - _TMIN) * _TMAX // 2

    def shrink(s, _):
        return F.when(s["d"] > limit, F.struct(_div(s["d"], _BASE - _TMIN).alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)

    start = let(damped, lambda d: F.struct((d + _div(d, points)).alias("d"), F.lit(0).cast("long").alias("k")))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)), start, shrink,
        lambda s: s["k"] + _div(s["d"] * (_BASE - _TMIN + 1), s["d"] + _SKEW),
    )


def _written(delta: Column, bias: Column) -> Column:
    """A delta as a number of variable length."""
    def digit(s, k):
        t = F.least(F.greatest(k - bias, F.lit(_TMIN).cast("long")), F.lit(_TMAX).cast("long"))

        def step(t):
            more = s["q"] >= t
            value = F.when(more, t + (s["q"] - t) % (_BASE - t)).otherwise(s["q"])
            return F.struct(
                F.when(more, _div(s["q"] - t, _BASE - t)).otherwise(F.lit(-1).cast("long")).alias("q"),
                F.concat(s["out"], F.substr(F.lit(_DIGITS), (value + 1).cast("int"), F.lit(1))).alias("out"),
            )
        return F.when(s["q"] < 0, s).otherwise(let(t, step))

    places = F.sequence(F.lit(_BASE).cast("long"), F.lit(_BASE * _STEPS).cast("long"), F.lit(_BASE).cast("long"))
    return F.aggregate(places, F.struct(delta.alias("q"), F.lit("").alias("out")), digit, lambda s: s["out"])


def punycode(label: Column) -> Column:
    """RFC 3492 form of a text, without the prefix."""
    def encode(points):
        basic = F.filter(points, lambda p: p < _START)
        plain = F.array_join(F.transform(basic, lambda p: F.char(p)), "")

        def one_point(state, point):
            def visit(s, p):
                smaller = s.withField("delta", s["delta"] + 1)
                written = F.struct(
                    s["n"].alias("n"), F.lit(0).cast("long").alias("delta"),
                    _adapted(s["delta"], s["h"] + 1, s["h"] == F.size(basic)).alias("bias"),
                    (s["h"] + 1).alias("h"), F.concat(s["out"], _written(s["delta"], s["bias"])).alias("out"),
                )
                return F.when(p < point, smaller).when(p == point, written).otherwise(s)

            reached = state.withField("delta", state["delta"] + (point - state["n"]) * (state["h"] + 1))
            return F.aggregate(points, reached, visit, lambda s: s.withField("delta", s["delta"] + 1).withField("n", point + 1))

        start = F.struct(
            F.lit(_START).cast("long").alias("n"), F.lit(0).cast("long").alias("delta"), F.lit(_START_BIAS).cast("long").alias("bias"),
            F.size(basic).cast("long").alias("h"), F.when(F.size(basic) > 0, F.concat(plain, F.lit("-"))).otherwise("").alias("out"),
        )
        others = F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= _START)))
        return F.aggregate(others, start, one_point, lambda s: s["out"])

    chars = F.regexp_extract_all(label, F.lit(r"(?s)."), F.lit(0))
    return let(F.transform(chars, lambda c: F.ascii(c).cast("long")), encode)


def _address(host: Column) -> Column:
    """Dotted decimal form of a host of numbers (decimal, octal, hexadecimal; the last may stand for
    several bytes), null if it is none."""
    def number(part):
        value = (
            F.when(part.rlike("^0x[0-9a-f]*$"), F.conv(F.coalesce(non_empty(F.substr(part, F.lit(3))), F.lit("0")), 16, 10))
            .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
            .when(part.rlike("^(?:0|[1-9][0-9]*)$"), part)
        )
        return value.try_cast("long")

    def join(numbers):
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        lead = F.slice(numbers, F.lit(1), n - 1)
        # an unreadable number is above any limit
        fits = F.forall(lead, lambda v: F.coalesce(v, F.lit(256)) < 256) & (F.coalesce(last, F.lit(1 << 40)) < F.pow(F.lit(256), 5 - n))
        high = F.aggregate(lead, F.lit(0).cast("long"), lambda total, v: total * 256 + v, lambda v: v * F.pow(F.lit(256), 5 - n).cast("long"))
        return F.when((n <= 4) & fits, let(high + last, lambda v: F.concat_ws(
            ".", *[F.shiftright(v, bits).bitwiseAND(F.lit(255)).cast("string") for bits in (24, 16, 8, 0)])))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), join)


def standard_host(host: Column, spelled: bool = True) -> Column:
    """The host of a web URL as a browser writes it, null if it refuses it.

    Percent-encoding is decoded, letters are lower-cased, full-width forms and other full stops become ASCII, labels in
    other scripts are written as xn--, numbers as dotted addresses. Letters with combining marks are not composed. With
    spelled=False, labels stay in their script.
    """
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))

    def write(text):
        def label(part):
            return F.when(part.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(part))).otherwise(part)

        name = F.array_join(F.transform(F.split(text, r"\."), label), ".") if spelled else text
        last = F.regexp_extract(text, r"([^.]*)\.?$", 1)
        return F.when((text == "") | text.rlike(_FORBIDDEN), None).when(last.rlike(_NUMBER), _address(text)).otherwise(name)

    decoded = F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
    mapped = F.regexp_replace(F.translate(decoded, wide + "。｡", narrow + ".."), "[­​⁠﻿]", "")
    return let(F.lower(mapped), write)
