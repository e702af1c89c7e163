"""Contracts, required fields, JSON-LD and page outcomes on small payloads."""

import json
from datetime import datetime

import pytest

from pagetables.operators import contracts as co
from pagetables.operators import validate as va

URL = "https://h.example/a/b"
CTX = "https://schema.org"

# entity, its reason or JSON-LD without @context and @type
ENTITIES = {
    "no_name": ({"@type": "Product"}, "Missing required field: Product.name"),
    "null_name": ({"@type": "Product", "name": None}, "Missing required field: Product.name"),
    "empty_name": ({"@type": "Event", "name": ""}, "Missing required field: Event.name"),
    "zero_name": ({"@type": "Event", "name": 0}, {}),
    "false_name": ({"@type": "HowTo", "name": False}, {}),
    "empty_items": ({"@type": "ItemList", "itemListElement": []},
                    "Empty required field: ItemList.itemListElement"),
    "article_name": ({"@type": "Article", "name": "n"}, "Missing required field: Article.headline"),
    "faq": ({"@type": "FAQPage"}, {}),
    "unknown": ({"@type": "Thing", "name": "n", "x": 1, "url": 7}, {"name": "n", "url": None}),
    "object_image": ({"@type": "Product", "name": "n", "image": {"url": "/x"}}, {"name": "n"}),
    "own_brand": ({"@type": "Product", "name": "n", "brand": {"@type": "X", "name": "b"}},
                  {"name": "n", "brand": {"@type": "X", "name": "b"}}),
    "text_brand": ({"@type": "Product", "name": "n", "brand": "ab"},
                   {"name": "n", "brand": {"0": "a", "1": "b", "@type": "Brand"}}),
    "rating": ({"@type": "Product", "name": "n", "aggregateRating": {"ratingValue": "4,5", "bestRating": 0}},
               {"name": "n", "aggregateRating": {
                   "@type": "AggregateRating", "ratingValue": 4.5, "reviewCount": None,
                   "bestRating": 5, "worstRating": 1}}),
    "null_offers": ({"@type": "Product", "name": "n", "offers": [None, None]},
                    {"name": "n", "offers": []}),
    "text_offer": ({"@type": "Product", "name": "n", "offers": "x"},
                   {"name": "n", "offers": [{"@type": "Offer"}]}),
    "offers": ({"@type": "Product", "name": "n", "sku": "", "gtin": "g", "mpn": "m", "offers": [
        {"price": 12.50, "priceCurrency": "EUR", "url": "//o.example"},
        {"price": "EUR 1,234", "availability": "", "url": 5}]},
        {"name": "n", "gtin": "g", "offers": [
            {"@type": "Offer", "price": 12.5, "priceCurrency": "EUR", "url": "https://o.example"},
            {"@type": "Offer", "price": 1234, "url": None}]}),
    "org": ({"@type": "Organization", "name": "n", "logo": "l.png", "sameAs": ["x"], "address": {}},
            {"name": "n", "logo": "https://h.example/a/l.png", "sameAs": ["x"]}),
    "site": ({"@type": "WebSite", "name": "n", "potentialAction": {"target": {"a": 1}}},
             {"name": "n", "potentialAction": {
                 "@type": "SearchAction", "target": {"a": 1},
                 "query-input": "required name=search_term_string"}}),
    "items": ({"@type": "ItemList", "numberOfItems": "none", "itemListElement": [
        {"position": 0, "url": "/p", "name": None}, "x", {"name": "b"}]},
        {"numberOfItems": None, "itemListElement": [
            {"@type": "ListItem", "position": 0, "url": "https://h.example/p", "name": None},
            {"@type": "ListItem", "position": 2, "url": None},
            {"@type": "ListItem", "position": 3, "url": None, "name": "b"}]}),
    "post": ({"@type": "BlogPosting", "headline": "h", "image": ["/i", "", 3, None],
              "author": {"@type": "Organization", "name": "a"},
              "publisher": {"name": "p", "logoUrl": "//l.example"},
              "datePublished": "Jan 2, 2026", "dateModified": 86400000},
             {"headline": "h", "image": ["https://h.example/i"],
              "author": {"@type": "Person", "name": "a", "url": None},
              "publisher": {"@type": "Organization", "name": "p",
                            "logo": {"@type": "ImageObject", "url": "https://l.example"}},
              "datePublished": "2026-01-02", "dateModified": "1970-01-02"}),
    "video": ({"@type": "VideoObject", "name": "n", "thumbnailUrl": ["/t"], "uploadDate": "soon",
               "duration": "PT1M"},
              {"name": "n", "thumbnailUrl": None, "uploadDate": "soon", "duration": "PT1M"}),
    "news": ({"@type": "NewsArticle", "headline": "h", "name": "n"}, {"name": "n"}),
}
FAILING = {
    "text_image": ({"@type": "Product", "name": "n", "image": "/x"},
                   "entity.image.map is not a function"),
    "text_items": ({"@type": "ItemList", "itemListElement": "x"},
                   "entity.itemListElement.map is not a function"),
    "null_item": ({"@type": "ItemList", "itemListElement": [None]},
                  "Cannot read properties of null (reading 'position')"),
}
CONTRACTS = [
    ({"@type": "Product", "extra": 1}, "Product"),
    ({"@type": "Product", "name": 5}, "Fallback"),
    ({"@type": "Product", "offers": [{"price": "1"}, None]}, "Product"),
    ({"@type": "Product", "offers": {"price": True}}, "Fallback"),
    ({"@type": "Product", "offers": {"seller": {"sameAs": [1]}}}, "Fallback"),
    ({"@type": "Product", "brand": {"@type": None}}, "Fallback"),
    ({"@type": "Product", "image": ["a", None]}, "Fallback"),
    ({"@type": "Product", "image": {"url": None}}, "Product"),
    ({"@type": "Product", "aggregateRating": {"ratingValue": "4"}}, "Product"),
    ({"@type": "NewsArticle", "author": {"sameAs": 1}}, "Article"),
    ({"@type": "Article", "publisher": {"sameAs": 1}}, "Fallback"),
    ({"@type": "Store", "sameAs": None, "address": 3}, "Organization"),
    ({"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "position": "1"}]}, "ItemList"),
    ({"@type": "ItemList", "itemListElement": [{"@type": "Thing"}]}, "Fallback"),
    ({"@type": "Recipe", "recipeInstructions": [1, {}]}, "Recipe"),
    ({"@type": "Review", "reviewRating": 5}, "Fallback"),
    ({"@type": "VideoObject", "embedUrl": 1}, "Fallback"),
    ({"@type": "FAQPage", "mainEntity": [{"@type": "Question", "acceptedAnswer": None}]}, "FAQPage"),
    ({"@type": "FAQPage", "mainEntity": [{"name": "q"}]}, "Fallback"),
    ({"@type": "WebSite", "potentialAction": 1}, "WebSite"),
    ({"@type": "BreadcrumbList", "itemListElement": {}}, "Fallback"),
    ({"@type": "Other"}, "Fallback"),
    ({"name": "x"}, None),
    ({"@type": 3}, None),
    ("text", None),
]


def payloads(spark, lists):
    rows = [(n, URL, p if isinstance(p, str) else json.dumps({"schemas": p}), None)
            for n, p in enumerate(lists)]
    return spark.createDataFrame(
        rows, "page_id long, page_url string, payload string, usage string")


def test_reasons_and_json_ld(spark):
    names = list(ENTITIES)
    rows = va.validate(co.entities(payloads(spark, [[ENTITIES[n][0]] for n in names]))).collect()
    for row in rows:
        entity, want = ENTITIES[names[row.page_id]]
        if isinstance(want, str):
            assert (row.reason, row.json_ld) == (want, None)
        else:
            got = json.loads(row.json_ld)
            assert list(got)[:2] == ["@context", "@type"]
            assert got == {"@context": CTX, "@type": entity["@type"], **want}, names[row.page_id]
    repairs = {names[r.page_id]: r.repairs for r in rows}
    assert repairs["offers"] == ["Cleaned price: EUR 1,234 → 1234"]
    assert repairs["org"] == []


def test_page_validation(spark):
    ok, bad = {"@type": "FAQPage"}, {"@type": "Product"}
    cases = [([], "No valid entities after validation"), ([bad], "No valid entities after validation"),
             ([ok, bad], None), ("{}", va.fixed.BAD_EXTRACTION), ("not json", va.fixed.BAD_EXTRACTION),
             ([ok, {"name": 1}], va.fixed.BAD_EXTRACTION)]
    cases += [([ok, entity], error) for entity, error in FAILING.values()]
    # A rejected entity is never built, so it cannot fail its page.
    cases += [([ok, {"@type": "Product", "image": "/x"}], None)]
    result = va.page_validation(payloads(spark, [c for c, _ in cases]))
    got = {r.page_id: (r.stage, r.reason) for r in result.collect()}
    for n, (_, reason) in enumerate(cases):
        stage = None if reason is None else (
            "extraction" if reason == va.fixed.BAD_EXTRACTION else "validator")
        assert got[n] == (stage, reason)
    for row in result.where("stage IS NULL").collect():
        assert row.n_accepted + row.n_rejected == row.n_entities


def test_contracts(spark):
    rows = co.classify(co.entities(payloads(spark, [[e for e, _ in CONTRACTS]]))).collect()
    got = {r.idx: r.contract for r in rows}
    assert [(CONTRACTS[n][0], got[n]) for n in sorted(got)] == CONTRACTS


def test_issue_report(spark):
    issues = [
        {"path": ["schemas", 0, "name"], "message": "m", "expected": "string", "received": "null",
         "code": "c"},
        {"message": "top", "code": "d"},
    ]
    df = spark.createDataFrame([(1, json.dumps(issues))], "page_id long, issues string")
    first, second = co.issue_report(df).orderBy("issue").collect()
    assert (first.field, first.expected, first.received) == ("schemas.0.name", "string", "null")
    assert (second.field, second.expected, second.received, second.total_issues) == (
        "root", "d", "N/A", 2)
    assert second.summary == "  • root: top (expected: N/A, got: N/A)"


@pytest.mark.parametrize("usage, want", [
    ('{"promptTokens":1,"completionTokens":2,"totalTokens":3}', (1, 2, 3)),
    ('{"inputTokens":4,"outputTokens":5}', (4, 5, 0)), ("{}", (0, 0, 0)), (None, (0, 0, 0)),
])
def test_token_usage(spark, usage, want):
    df = spark.createDataFrame([(1, usage)], "page_id long, usage string")
    assert tuple(va.token_usage(df).head())[1:] == want


def test_outcomes(spark):
    pages = spark.createDataFrame(
        [(0, URL, "h", 200), (1, "bad url", "h", 200), (2, URL, "h", 404), (3, URL, None, 200),
         (4, URL, "h", 200), (5, "", "h", 200)],
        "page_id long, url string, html string, status int")
    validation = va.page_validation(payloads(spark, [[{"@type": "X"}]]))
    rows = va.outcome_code(va.page_outcomes(pages, validation)).orderBy("page_id").collect()
    assert [(r.stage, r.reason, r.code) for r in rows] == [
        (None, None, 200), ("ingestion", "Invalid URL format", 400),
        ("ingestion", "HTTP error: 404", 422), ("cleaning", "No HTML", 422),
        ("extraction", "No extraction result", 422), ("ingestion", "URL is required", 400)]


# Entity as JSON text, and the JSON-LD behind @context and @type as text: keys stay as they were written.
ORDERED = [
    ('{"@type":"Product","name":"n","brand":{"z":{"b":1,"a":[{"d":1,"c":2}]},"name":"b","@type":"X"}}',
     '"name":"n","brand":{"@type":"X","z":{"b":1,"a":[{"d":1,"c":2}]},"name":"b"}'),
    ('{"@type":"Product", "name":"n", "brand": { "zip" : "1",\n "a" : null } }',
     '"name":"n","brand":{"@type":"Brand","zip":"1","a":null}'),
    ('{"@type":"Product","name":"n","brand":{"y":"{\\"q\\":1}","x":"[1]"}}',
     '"name":"n","brand":{"@type":"Brand","y":"{\\"q\\":1}","x":"[1]"}'),
    ('{"@type":"WebSite","name":{"y":1,"x":"{"},"potentialAction":{"target":{"b":1,"a":{"d":"x","c":2}},"queryInput":{"2":1,"1":2}}}',
     '"name":{"y":1,"x":"{"},"potentialAction":{"@type":"SearchAction","target":{"b":1,"a":{"d":"x","c":2}},"query-input":{"2":1,"1":2}}'),
    ('{"@type":"WebSite","name":"n","potentialAction":"none"}', '"name":"n"'),
    ('{"@type":"Organization","name":"n","sameAs":[{"b":1,"a":2},"u"]}', '"name":"n"'),
    ('{"@type":"Article","headline":"h","author":{"name":{"last":"l","first":"f"}},"publisher":"p"}',
     '"headline":"h","author":{"@type":"Person","name":{"last":"l","first":"f"},"url":null},'
     '"publisher":{"@type":"Organization"}'),
    ('{"@type":"Event","name":"[1]","description":["b",{"b":1,"a":2}]}', '"name":"[1]","description":["b",{"b":1,"a":2}]'),
]


def test_keys_of_passed_through_values_keep_their_order(spark):
    rows = [(n, URL, f'{{"usage": 1, "schemas": [null, {text}]}}', None) for n, (text, _) in enumerate(ORDERED)]
    extractions = spark.createDataFrame(rows, "page_id long, page_url string, payload string, usage string")
    found = va.validate(co.entities(extractions)).where("idx = 1").collect()
    got = {r.page_id: r.json_ld.split(",", 2)[2][:-1] for r in found}
    for n, (text, expected) in enumerate(ORDERED):
        if "sameAs" in text:
            expected += ',"sameAs":[{"b":1,"a":2},"u"]'
        assert got[n] == expected, text


def test_log_metadata_keeps_its_order(spark):
    from pagetables.operators.runlog import log_lines

    schema = "ts timestamp, page_id long, level string, stage string, message string, metadata string"
    at = datetime(2026, 1, 2, 3, 4, 5)
    texts = ['{"b": 1, "a": {"d": "x y", "c": [1, 2]}}', None, "[]", '"t"']
    log = spark.createDataFrame([(at, n, "INFO", "S", "m", t) for n, t in enumerate(texts)], schema)
    ends = [r.line.partition("] m")[2] for r in log_lines(log).orderBy("page_id").collect()]
    assert ends == [' | {"b":1,"a":{"d":"x y","c":[1,2]}}', "", " | []", ' | "t"']
