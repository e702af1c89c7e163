"""URL checks and resolution as Column expressions.

Values that are used more than once are bound with let(), so the trees stay small.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import standard_host
from .text import let, non_empty

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_SPECIAL = r"^(?i:https?|wss?|ftp):"
_HOST = r"""(?:[^\x00-\x20/?#\\@:<>^|"`{}\[\]]+|\[[0-9a-fA-F:.]+\])"""
_SPECIAL_URL = (
    rf"^(?i:https?|wss?|ftp):[/\\]*(?:[^/?#\\@]*@)*{_HOST}(?::[0-9]{{0,5}})?(?:[/?#\\][\s\S]*)?$"
)
_AUTHORITY = r"^((?i:https?|wss?|ftp):[/\\]*(?:[^/?#\\@]*@)*)([^/?#\\:]*)"
#: Hosts that are right as they are but for capitals: the last label starts with a letter, or an address in brackets.
_PLAIN_HOST = r"^(?:(?:[a-zA-Z0-9_-]+\.)*[a-zA-Z][a-zA-Z0-9_-]*\.?|\[.*)$"
_OTHER_URL = r"^(?!(?i:https?|wss?|ftp):)[a-zA-Z][a-zA-Z0-9+.\-]*:"
_ABSOLUTE_URL = rf"{_SPECIAL_URL}|{_OTHER_URL}"
_EDGE_SPACE = r"^[\x00-\x20]+|[\x00-\x20]+$"
_UNSAFE_RUN = r"""[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]+"""
_RUNS = rf"""{_UNSAFE_RUN}|[\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]+"""


def is_url(col) -> Column:
    """Would a browser accept it as an absolute URL?"""
    def check(u):
        host = F.regexp_extract(u, _AUTHORITY, 2)
        good = let(host, lambda h: h.rlike(_PLAIN_HOST) | standard_host(h, spelled=False).isNotNull())
        return u.rlike(_ABSOLUTE_URL) & (~u.rlike(_SPECIAL) | good)

    return let(F.regexp_replace(col, _EDGE_SPACE, ""), check)


def percent_encode(col: Column) -> Column:
    """Escape spaces, quotes, angle brackets, braces, backquotes and all non-ASCII."""
    def encode(text):
        encoded = F.transform(
            F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0)),
            lambda r: F.when(
                r.rlike(rf"^{_UNSAFE_RUN}$"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
            ).otherwise(r),
        )
        return F.when(text.rlike(_UNSAFE_RUN), F.array_join(encoded, "")).otherwise(text)

    return let(col, encode)


def without_dots(col: Column) -> Column:
    """Resolve . and .. in an absolute path."""
    none = F.array().cast("array<string>")

    def fold(kept, part):
        return (
            F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part == ".", kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    def resolve(path):
        kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), none, fold)
        tail = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(none)
        joined = F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))
        return F.when(path.rlike(r"/\.\.?(?:/|$)"), joined).otherwise(path)

    return let(col, resolve)


def url_base(url) -> Column:
    """STRUCT origin, path, query of a base URL, in standard spelling; null if it is none."""
    def parts(u):
        def spelled(host):
            before, after = F.regexp_extract(u, _AUTHORITY, 1), F.regexp_extract(u, _AUTHORITY + r"([^/?#]*)", 3)
            name = F.when(host.rlike(_PLAIN_HOST), F.lower(host)).otherwise(standard_host(host))
            return F.when(u.rlike(_SPECIAL), F.concat(F.lower(before), name, F.lower(after))).otherwise(
                F.lower(F.regexp_extract(u, r"^([^:]+://[^/?#]*)", 1)))

        authority = let(F.regexp_extract(u, _AUTHORITY, 2), spelled)
        path = F.coalesce(non_empty(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)), F.lit("/"))
        return F.when(
            is_url(u) & u.contains("://"),
            F.struct(
                F.regexp_replace(authority, r"^(http://[\s\S]*):80$|^(https://[\s\S]*):443$", "$1$2")
                .alias("origin"),
                without_dots(percent_encode(path)).alias("path"),
                percent_encode(F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)).alias("query"),
            ),
        )

    return let(F.regexp_replace(url, _EDGE_SPACE, ""), parts)


def resolve_url(url, base: Column) -> Column:
    """A relative URL on a base (see url_base); null if the base is null."""
    def join(r):
        path = F.regexp_extract(r, r"^[^?#]*", 0)
        rest = percent_encode(F.regexp_extract(r, r"^[^?#]*([\s\S]*)$", 1))
        folder = F.regexp_extract(base["path"], r"^(.*/)", 1)
        full = F.when(path.startswith("/"), path).when(path == "", base["path"]).otherwise(
            F.concat(folder, path)
        )
        query = F.when(r.rlike("^(?:#|$)"), base["query"]).otherwise("")
        resolved = F.concat(base["origin"], without_dots(percent_encode(full)), query, rest)
        absolute = let(
            url_base(r),
            lambda b: F.concat(
                b["origin"], b["path"], b["query"],
                percent_encode(F.regexp_extract(r, r"(#[\s\S]*)$", 1)),
            ),
        )
        return (
            F.when(r.rlike(_SPECIAL), absolute).when(r.rlike(_SCHEME), r).otherwise(resolved)
        )

    cleaned = F.regexp_replace(F.regexp_replace(url, _EDGE_SPACE, ""), r"[\t\n\r]", "")
    return F.when(base.isNotNull(), let(cleaned, join))
