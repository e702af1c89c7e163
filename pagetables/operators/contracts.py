"""Extraction payloads to entities, and the loose contract each entity fits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import as_text, elements, field, is_kind


def parse_extractions(extractions: DataFrame) -> DataFrame:
    """+ schemas ARRAY<VARIANT>, null if the payload has no array of that name; sources: the JSON
    text of each, where keys have the order in which they were written."""
    payload = F.try_parse_json("payload")
    return extractions.withColumns({
        "schemas": elements(field(payload, "schemas")),
        "sources": F.from_json("payload", "schemas array<string>")["schemas"],
    })


def entities(extractions: DataFrame, outer: bool = False) -> DataFrame:
    """(page_id, page_url, idx, raw, source, type): one row per entity, idx from 0.

    With `outer`, a page without entities keeps one row with a null idx, and has_schemas
    says whether its payload held the array at all.
    """
    return explode_entities(parse_extractions(extractions), outer)


def entity_type(raw: Column) -> Column:
    """The @type of an entity if it is a text, else null."""
    kind = field(raw, "@type")
    return F.when(is_kind(kind, "string"), as_text(kind))


def explode_entities(parsed: DataFrame, outer: bool = False) -> DataFrame:
    """Entities of payloads that parse_extractions has read.

    Pages without entities are left out after the explode: for an inner one, Spark filters by the size of
    the parsed array where payloads are read, before they are spread, and so parses all of them there too.
    """
    rows = parsed.select(
        "page_id", "page_url",
        *([F.col("schemas").isNotNull().alias("has_schemas")] if outer else []),
        "sources", F.posexplode_outer("schemas").alias("idx", "raw"),
    )
    if not outer:
        rows = rows.where(F.col("idx").isNotNull())
    return rows.select(
        *[c for c in rows.columns if c != "sources"], F.get("sources", F.col("idx")).alias("source"),
        entity_type(F.col("raw")).alias("type"),
    )


# --- shapes: a Column that says whether a value has it; absent and null are fine ---


def _or_none(value: Column, check: Column) -> Column:
    return value.isNull() | F.is_variant_null(value) | F.coalesce(check, F.lit(False))


def is_core_string(value: Column) -> Column:
    """Also URLs and dates, which are any text."""
    return _or_none(value, is_kind(value, "string"))


def is_core_number(value: Column) -> Column:
    return _or_none(value, is_kind(value, "string", "number"))


def _type_ok(value: Column, *allowed: str) -> Column:
    kind = field(value, "@type")
    text = is_kind(kind, "string")
    return kind.isNull() | ((text & as_text(kind).isin(*allowed)) if allowed else text)


def _strings(value: Column) -> Column:
    return is_kind(value, "array") & F.forall(elements(value), lambda x: is_kind(x, "string"))


def _object(value: Column, strings=(), numbers=(), more=()) -> Column:
    """An object with an optional text @type and fields of the given shapes."""
    checks = [is_core_string(field(value, k)) for k in strings]
    checks += [is_core_number(field(value, k)) for k in numbers]
    checks += list(more)
    ok = is_kind(value, "object") & _type_ok(value)
    for check in checks:
        ok = ok & check
    return _or_none(value, ok)


def is_brand(value: Column) -> Column:
    return _object(value, ["name"])


def is_org(value: Column) -> Column:
    same_as = field(value, "sameAs")
    return _object(value, ["name", "url", "logo"], more=[_or_none(same_as, _strings(same_as))])


def is_person_or_org(value: Column) -> Column:
    """A person has fewer rules than an organization, so its rules decide."""
    return _object(value, ["name", "url"])


def is_image(value: Column) -> Column:
    with_url = is_kind(value, "object") & is_core_string(field(value, "url"))
    return _or_none(value, is_kind(value, "string") | _strings(value) | with_url)


def is_offer(value: Column) -> Column:
    strings = ["priceCurrency", "availability", "url", "priceValidUntil", "itemCondition", "sku"]
    return _object(value, strings, ["price"], [is_org(field(value, "seller"))])


def is_offers(value: Column) -> Column:
    many = is_kind(value, "array") & F.forall(elements(value), is_offer)
    return is_offer(value) | many


def is_rating(value: Column) -> Column:
    return _object(value, numbers=["ratingValue", "reviewCount", "bestRating", "worstRating"])


def _is_string_list(value: Column) -> Column:
    return _or_none(value, _strings(value))


def _is_list(value: Column) -> Column:
    return _or_none(value, is_kind(value, "array"))


def _list_of(check):
    def test(value: Column) -> Column:
        return _or_none(value, is_kind(value, "array") & F.forall(elements(value), check))

    return test


def _is_list_item(value: Column) -> Column:
    return (
        is_kind(value, "object") & _type_ok(value, "ListItem")
        & is_core_number(field(value, "position")) & is_core_string(field(value, "url"))
        & is_core_string(field(value, "name")) & is_image(field(value, "image"))
    )


def _is_question(value: Column) -> Column:
    answer = field(value, "acceptedAnswer")
    answer_ok = (
        is_kind(answer, "object") & field(answer, "@type").isNotNull()
        & _type_ok(answer, "Answer") & is_core_string(field(answer, "text"))
    )
    return (
        is_kind(value, "object") & field(value, "@type").isNotNull()
        & _type_ok(value, "Question") & is_core_string(field(value, "name"))
        & _or_none(answer, answer_ok)
    )


# Contract: the types it is for and the shape of each of its fields, in trial order.
CONTRACTS = {
    "Product": (["Product"], {
        "name": is_core_string, "description": is_core_string, "image": is_image,
        "brand": is_brand, "offers": is_offers, "aggregateRating": is_rating,
        "sku": is_core_string, "gtin": is_core_string, "mpn": is_core_string,
    }),
    "Article": (["Article", "BlogPosting", "NewsArticle"], {
        "headline": is_core_string, "name": is_core_string, "description": is_core_string,
        "image": is_image, "author": is_person_or_org, "publisher": is_org,
        "datePublished": is_core_string, "dateModified": is_core_string,
        "mainEntityOfPage": is_core_string,
    }),
    "Organization": (["Organization", "Corporation", "LocalBusiness", "Store", "Restaurant"], {
        "name": is_core_string, "url": is_core_string, "logo": is_image,
        "description": is_core_string, "sameAs": _is_string_list,
    }),
    "ItemList": (["ItemList"], {
        "name": is_core_string, "description": is_core_string, "numberOfItems": is_core_number,
        "itemListElement": _list_of(_is_list_item),
    }),
    "Recipe": (["Recipe"], {
        "name": is_core_string, "description": is_core_string, "image": is_image,
        "author": is_person_or_org, "cookTime": is_core_string, "prepTime": is_core_string,
        "totalTime": is_core_string, "recipeYield": is_core_string,
        "recipeIngredient": _is_string_list, "recipeInstructions": _is_list,
        "aggregateRating": is_rating,
    }),
    "Review": (["Review"], {
        "author": is_person_or_org, "reviewRating": is_rating, "reviewBody": is_core_string,
        "datePublished": is_core_string,
    }),
    "VideoObject": (["VideoObject"], {
        "name": is_core_string, "description": is_core_string, "thumbnailUrl": is_image,
        "uploadDate": is_core_string, "duration": is_core_string, "contentUrl": is_core_string,
        "embedUrl": is_core_string,
    }),
    "FAQPage": (["FAQPage"], {"mainEntity": _list_of(_is_question)}),
    "WebSite": (["WebSite"], {"name": is_core_string, "url": is_core_string}),
    "BreadcrumbList": (["BreadcrumbList"], {"itemListElement": _is_list}),
}
FALLBACK = "Fallback"


def fits(name: str, raw: Column) -> Column:
    """Do all fields of an entity have the shapes of a contract?"""
    ok = F.lit(True)
    for key, check in CONTRACTS[name][1].items():
        ok = ok & check(field(raw, key))
    return ok


def classify(entity_rows: DataFrame) -> DataFrame:
    """+ contract: the contract the entity fits, Fallback, or null without a text @type."""
    kind = F.col("type")
    contract = None
    for name, (types, _) in CONTRACTS.items():
        case = kind.isin(*types) & fits(name, F.col("raw"))
        contract = F.when(case, name) if contract is None else contract.when(case, name)
    contract = contract.when(kind.isNotNull(), FALLBACK)
    return entity_rows.withColumn("contract", contract)


ISSUE_SCHEMA = (
    "array<struct<path: array<string>, message: string, expected: string, "
    "received: string, code: string>>"
)


def issue_report(errors: DataFrame) -> DataFrame:
    """One row per issue of (page_id, issues): running number, field, problem, total."""
    parsed = errors.select("page_id", F.from_json("issues", ISSUE_SCHEMA).alias("all"))
    rows = parsed.select(
        "page_id", F.size("all").alias("total_issues"), F.posexplode("all").alias("n", "e")
    )
    path = F.array_join(F.col("e.path"), ".")
    expected = F.nullif(F.col("e.expected"), F.lit(""))
    received = F.coalesce(F.nullif(F.col("e.received"), F.lit("")), F.lit("N/A"))
    return rows.select(
        "page_id",
        (F.col("n") + 1).alias("issue"),
        F.when(F.col("e.path").isNull(), "root").otherwise(path).alias("field"),
        F.col("e.message").alias("problem"),
        F.coalesce(expected, F.col("e.code")).alias("expected"),
        received.alias("received"),
        F.col("e.code").alias("code"),
        "total_issues",
        F.concat(
            F.lit("  • "), F.when(F.col("e.path").isNull(), "root").otherwise(path),
            F.lit(": "), F.col("e.message"), F.lit(" (expected: "),
            F.coalesce(expected, F.lit("N/A")), F.lit(", got: "), received, F.lit(")"),
        ).alias("summary"),
    )
