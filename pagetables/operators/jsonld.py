"""JSON-LD of an entity, written key by key as (key, fragment or absent)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repair import price_message, repair_date, repair_price, repair_url_on
from ..functions.text import let, number_text
from ..functions.urls import url_base
from ..functions.variants import (
    as_text, elements, entry_list, field, frag_is, fragment, if_set, in_order, is_kind, is_set,
    json_array, json_object, or_null, pretty_json, quoted, text_of,
)

SEARCH_INPUT = "required name=search_term_string"


# Top-level fields repaired as URLs and as dates.
_URL_FIELDS = ["url", "logo", "thumbnailUrl", "contentUrl", "embedUrl"]
_NESTED_URLS = [("author", "url"), ("publisher", "logoUrl")]
_DATE_FIELDS = ["datePublished", "dateModified", "uploadDate"]
# Fields that are passed through as they are, as JSON text.
_PASSED = (
    "name string, description string, brand string, sku string, gtin string, sameAs string, "
    "headline string, duration string, potentialAction struct<target: string, queryInput: string>, "
    "author struct<name: string, type: string>, publisher struct<name: string>"
)
_URLS = [(k,) for k in _URL_FIELDS] + _NESTED_URLS


def with_repairs(entity_rows: DataFrame) -> DataFrame:
    """+ base, urls, dates, passed: the page URL taken apart, every URL and date of the entity
    repaired, each kind by one expression, and the JSON texts of what is passed through.

    urls holds four lists: the single fields, the images, the offers' and the items' URLs.
    """
    raw, base = F.col("raw"), F.col("base")
    nested_url = lambda x: _string(field(x, "url"))
    texts = F.array(
        F.array(*[_string(field(raw, *path)) for path in _URLS]),
        F.transform(elements(field(raw, "image")), _string),
        F.transform(_offer_list(raw), nested_url),
        F.transform(elements(field(raw, "itemListElement")), nested_url),
    )
    days = F.array(*[_day(field(raw, k)) for k in _DATE_FIELDS])
    return entity_rows.withColumn("base", url_base("page_url")).withColumns({
        "urls": F.transform(
            texts, lambda us: F.transform(us, lambda u: repair_url_on(u, base))
        ),
        "dates": F.transform(days, repair_date),
        "passed": F.from_json("source", _PASSED),
    })


def _url_list(n: int) -> Column:
    return F.get("urls", F.lit(n))


def _string(value: Column) -> Column:
    """The text of a JSON string; anything else has none."""
    return F.when(is_kind(value, "string"), as_text(value))


def _day(value: Column) -> Column:
    """A date's text; a number counts milliseconds."""
    millis = F.timestamp_millis(F.try_variant_get(value, "$", "double").cast("long"))
    return let(F.to_json(value), lambda f: F.when(
        frag_is(f, "number"), F.date_format(millis, "yyyy-MM-dd")
    ).when(f == "true", F.lit("1970-01-01")).when(frag_is(f, "string"), as_text(value)))


def _as_written(value: Column, *path: str) -> Column:
    """Fragment of a value that is passed through, its keys in order."""
    text = F.col("passed")
    for key in path:
        text = text[key]
    return in_order(value, text)


def _passed_if_set(raw: Column, *path: str) -> Column:
    return if_set(field(raw, *path), lambda f: _as_written(f, *path))


def _passed(raw: Column, *path: str) -> Column:
    return _as_written(fragment(field(raw, *path)), *path)


def _typed(name: str) -> tuple[str, Column]:
    return ("@type", F.lit(f'"{name}"'))


def _url(*path: str) -> Column:
    """Fragment of a URL from `urls`; null if there is none."""
    return quoted(F.get(_url_list(0), F.lit(_URLS.index(path))))


def _url_if_set(raw: Column, *path: str) -> Column:
    return F.when(is_set(field(raw, *path)), _url(*path))


def _date_if_set(raw: Column, key: str) -> Column:
    day = F.get("dates", F.lit(_DATE_FIELDS.index(key)))
    return if_set(
        field(raw, key), lambda f: F.when(day.isNotNull(), quoted(day)).otherwise(f)
    )


def _number(value: Column) -> Column:
    return number_text(repair_price(text_of(value)))


def _filled(value: Column) -> Column:
    """A list with elements."""
    return F.size(F.coalesce(elements(value), F.array().cast("array<variant>"))) > 0


def _images(value: Column) -> Column:
    kept = F.filter(_url_list(1), lambda u: u.isNotNull())
    return F.when(_filled(value), json_array(F.transform(kept, quoted)))


def base_json_ld(raw: Column) -> list[tuple[str, Column]]:
    return [
        ("@context", F.lit('"https://schema.org"')),
        ("@type", fragment(field(raw, "@type"))),
        ("name", _passed_if_set(raw, "name")),
        ("description", _passed_if_set(raw, "description")),
        ("url", _url_if_set(raw, "url")),
    ]


def _as_written_in(frag: Column, texts: Column, key: Column) -> Column:
    """Fragment of an object's key, with the last text that the object has for that key."""
    own = F.filter(texts, lambda e: e["key"] == key)
    return in_order(frag, F.try_element_at(own, F.lit(-1))["value"])


def product_brand(raw: Column) -> Column:
    """Brand first, then the brand's own keys as they were written; its own @type wins, and of a key
    that comes twice the last value."""
    brand = field(raw, "brand")
    values = F.try_variant_get(brand, "$", "map<string,variant>")
    texts = F.map_entries(F.from_json(F.col("passed")["brand"], "map<string,string>"))
    own_type = _as_written_in(fragment(field(brand, "@type")), texts, F.lit("@type"))
    pair = lambda k, v: F.concat(quoted(k), F.lit(":"), v)
    names = F.coalesce(F.array_distinct(texts["key"]), F.map_keys(values))
    keys = F.transform(
        F.filter(names, lambda k: k != "@type"),
        lambda k: pair(k, _as_written_in(F.to_json(F.try_element_at(values, k)), texts, k)),
    )
    typed = F.concat(F.lit('"@type":'), F.coalesce(own_type, F.lit('"Brand"')))
    as_object = F.concat(F.lit("{"), F.concat_ws(",", F.array(typed), keys), F.lit("}"))
    # A text or a list has its positions for keys, and those come first.
    pieces = F.when(
        is_kind(brand, "string"),
        F.transform(F.regexp_extract_all(as_text(brand), F.lit(r"(?s)."), F.lit(0)), quoted),
    ).otherwise(F.transform(elements(brand), lambda x: F.to_json(x)))
    indexed = F.transform(pieces, lambda p, n: pair(n.cast("string"), p))
    as_list = F.concat(F.lit("{"), F.concat_ws(",", indexed, F.array(typed)), F.lit("}"))
    return if_set(
        brand,
        lambda f: F.when(frag_is(f, "object"), as_object)
        .when(frag_is(f, "string", "array"), as_list)
        .otherwise(F.lit('{"@type":"Brand"}')),
    )


def product_rating(raw: Column) -> Column:
    rating = field(raw, "aggregateRating")

    keys = ["ratingValue", "reviewCount", "bestRating", "worstRating"]
    texts = F.array(*[text_of(field(rating, k)) for k in keys])

    def build(n):
        def with_default(k, default):
            return F.coalesce(F.nullif(F.get(n, F.lit(k)), F.lit("0")), F.lit(str(default)))

        return json_object(
            _typed("AggregateRating"),
            ("ratingValue", or_null(F.get(n, F.lit(0)))),
            ("reviewCount", or_null(F.get(n, F.lit(1)))),
            ("bestRating", with_default(2, 5)),
            ("worstRating", with_default(3, 1)),
        )

    numbers = F.transform(texts, lambda t: number_text(repair_price(t)))
    return F.when(is_set(rating), let(numbers, build))


def _offer_list(raw: Column) -> Column:
    """One or many offers as a list, without the empty ones."""
    offers = field(raw, "offers")
    return F.filter(F.coalesce(elements(offers), F.array(offers)), is_set)


def product_offers(raw: Column) -> Column:
    def one(offer, n):
        url = quoted(F.get(_url_list(2), n))
        return json_object(
            _typed("Offer"),
            ("price", _number(field(offer, "price"))),
            ("priceCurrency", if_set(field(offer, "priceCurrency"))),
            ("availability", if_set(field(offer, "availability"))),
            ("url", F.when(is_set(field(offer, "url")), url)),
        )

    return F.when(is_set(field(raw, "offers")), json_array(F.transform(_offer_list(raw), one)))


def price_repairs(raw: Column) -> Column:
    """ARRAY of messages, one per offer whose price text had to be cleaned."""
    def message(offer):
        text = text_of(field(offer, "price"))
        return let(text, lambda t: price_message(t, repair_price(t)))

    found = F.filter(F.transform(_offer_list(raw), message), lambda m: m.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(is_set(field(raw, "offers")), found).otherwise(none)


def product_json_ld(raw: Column) -> list[tuple[str, Column]]:
    return [
        ("image", _images(field(raw, "image"))),
        ("brand", product_brand(raw)),
        ("sku", _passed_if_set(raw, "sku")),
        ("gtin", _passed_if_set(raw, "gtin")),
        ("aggregateRating", product_rating(raw)),
        ("offers", product_offers(raw)),
    ]


def organization_json_ld(raw: Column) -> list[tuple[str, Column]]:
    lists = if_set(
        field(raw, "sameAs"),
        lambda f: F.when(frag_is(f, "string", "array") & (f != "[]"), _as_written(f, "sameAs")),
    )
    return [("logo", _url_if_set(raw, "logo")), ("sameAs", lists)]


def website_json_ld(raw: Column) -> list[tuple[str, Column]]:
    action = "potentialAction"
    query = F.coalesce(
        _passed_if_set(raw, action, "queryInput"), F.lit(f'"{SEARCH_INPUT}"')
    )
    search = if_set(field(raw, action, "target"), lambda f: json_object(
        _typed("SearchAction"), ("target", _as_written(f, action, "target")), ("query-input", query)
    ))
    return [(action, search)]


def itemlist_json_ld(raw: Column) -> list[tuple[str, Column]]:
    count, items = field(raw, "numberOfItems"), field(raw, "itemListElement")

    def one(item, n):
        own = F.nullif(fragment(field(item, "position")), F.lit("null"))
        return json_object(
            _typed("ListItem"),
            ("position", F.coalesce(own, (n + 1).cast("string"))),
            ("url", quoted(F.get(_url_list(3), n))),
            ("name", fragment(field(item, "name"))),
        )

    return [
        ("numberOfItems", F.when(is_set(count), or_null(_number(count)))),
        ("itemListElement", F.when(
            _filled(items), json_array(F.transform(elements(items), one))
        )),
    ]


def article_json_ld(raw: Column) -> list[tuple[str, Column]]:
    author_type = F.coalesce(_passed_if_set(raw, "author", "type"), F.lit('"Person"'))
    logo_object = json_object(_typed("ImageObject"), ("url", _url("publisher", "logoUrl")))
    return [
        ("headline", _passed_if_set(raw, "headline")),
        ("image", _images(field(raw, "image"))),
        ("author", F.when(is_set(field(raw, "author")), json_object(
            ("@type", author_type),
            ("name", _passed(raw, "author", "name")),
            ("url", _url("author", "url")),
        ))),
        ("publisher", F.when(is_set(field(raw, "publisher")), json_object(
            _typed("Organization"),
            ("name", _passed(raw, "publisher", "name")),
            ("logo", F.when(is_set(field(raw, "publisher", "logoUrl")), logo_object)),
        ))),
        ("datePublished", _date_if_set(raw, "datePublished")),
        ("dateModified", _date_if_set(raw, "dateModified")),
    ]


def video_json_ld(raw: Column) -> list[tuple[str, Column]]:
    return [
        ("thumbnailUrl", _url_if_set(raw, "thumbnailUrl")),
        ("uploadDate", _date_if_set(raw, "uploadDate")),
        ("duration", _passed_if_set(raw, "duration")),
        ("contentUrl", _url_if_set(raw, "contentUrl")),
        ("embedUrl", _url_if_set(raw, "embedUrl")),
    ]


BUILDERS = {
    ("Product",): product_json_ld,
    ("Organization",): organization_json_ld,
    ("WebSite",): website_json_ld,
    ("ItemList",): itemlist_json_ld,
    ("Article", "BlogPosting"): article_json_ld,
    ("VideoObject",): video_json_ld,
}


def build_json_ld(raw: Column, kind: Column) -> Column:
    """JSON-LD text, on rows with repairs; types without a builder get the base keys only."""
    own = None
    for types, builder in BUILDERS.items():
        entries = entry_list(builder(raw))
        case = kind.isin(*types)
        own = F.when(case, entries) if own is None else own.when(case, entries)
    return F.concat(
        F.lit("{"), F.concat_ws(",", entry_list(base_json_ld(raw)), own), F.lit("}")
    )


def build_error(raw: Column, kind: Column) -> Column:
    """The error of an entity that cannot be built and takes its page down, else null."""
    image, items = field(raw, "image"), field(raw, "itemListElement")
    no_map = "entity.{}.map is not a function"

    def is_text(value):
        return F.coalesce(F.to_json(value).rlike('^"[^"]'), F.lit(False))

    return (
        F.when(kind.isin("Product", "Article", "BlogPosting") & is_text(image),
               no_map.format("image"))
        .when((kind == "ItemList") & is_text(items), no_map.format("itemListElement"))
        .when((kind == "ItemList") & F.exists(elements(items), F.is_variant_null),
              "Cannot read properties of null (reading 'position')")
    )


def script_blocks(accepted: DataFrame) -> DataFrame:
    """+ script: the JSON-LD as a block to paste into a page."""
    return accepted.withColumn(
        "script",
        F.concat(
            F.lit('<script type="application/ld+json">\n'),
            pretty_json(F.col("json_ld")),
            F.lit("\n</script>"),
        ),
    )
