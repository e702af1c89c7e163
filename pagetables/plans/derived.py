"""Tables derived row by row from the given ones: richer pages, extraction results, a log.

The given pages hold no tables, images, buttons or model output, so these stand in for
them.  Every expression is plain SQL and reads one row, so building them needs no shuffle.
"""

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_K = "CAST(p_partkey AS STRING)"
_PRICE = "CAST(p_retailprice AS STRING)"

# One shop page per part, with every kind of element and of thing to remove.
PRODUCT_PAGE = {
    "page_id": "p_partkey",
    "url": f"'https://shop.example.com/p/' || {_K}",
    "html": f"""
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Shop | ' || p_name
    || '</title><meta name="description" content="' || p_type || ' &amp; more">'
    || '<meta property="og:title" content="' || p_name || '"><meta name="empty" content="">'
    || '<meta name="brand" property="og:brand" content="' || p_brand || '">'
    || '<link rel="stylesheet" href="/s.css"><style>.hidden{{display:none}}</style>'
    || '<script type="application/ld+json"> {{"@type":"Product","sku":"' || {_K} || '"}} </script>'
    || '<script type="application/ld+json">not json</script>'
    || '<script>var a = "</p>";</script></head><body>'
    || '<header class="header"><h1>Site name</h1></header>'
    || '<nav class="navbar"><ul><li><a href="/home">Home</a></li></ul></nav>'
    || '<noscript><img src="/pixel.gif"></noscript>'
    || '<div class="hidden">secret<span hidden>inner</span></div>'
    || '<main aria-label="Product ' || {_K} || '"><h2>' || p_brand || '</h2><h1>' || p_name
    || '</h1><p>A short one.<p>This ' || p_type || ' part is number ' || {_K} || ' and costs '
    || {_PRICE} || ' dollars.<div class="lead-text">Dropped</div>'
    || '<div style="DISPLAY:NONE">Kept</div><div style="display: none">Gone</div>'
    || '<img src="/img/' || {_K} || '.jpg" alt="' || p_name || ' picture">'
    || '<img src="data:image/png;base64,x" alt="inline"><img alt="no source">'
    || '<img src="/img/' || {_K} || '-b.jpg"><table><thead><tr><th>Field<th>Value</thead>'
    || '<tbody><tr><td>Brand<td>' || p_brand || '<tr><td>Type<td>' || p_type
    || '<tr><td>Size<td>' || CAST(p_size AS STRING) || '<tr><td></td><td> </td></tr></table>'
    || '<ul><li>One<ol><li>First</li><li>' || p_type || '</li></ol></li><li>' || p_name
    || '</ul><ul></ul><button>Add to cart</button><input type="submit" value="Buy ' || p_name
    || '"><input type="text" value="not"><a class="btn" href="/buy/' || {_K} || '">Buy now</a>'
    || '<div role="button"> </div><a href="#top">Top</a><a href="javascript:void(0)">Run</a>'
    || '<a href="mailto:shop@example.com">Mail</a><a href="/empty"></a><a href="/p/' || {_K}
    || '?x=1&amp;y=2"> ' || p_brand || '&nbsp;page </a>'
    || repeat('<a href="/r/' || {_K} || '">Related</a>', CAST(p_partkey % 40 AS INT))
    || '</main><div class="thread-list">t</div><aside class="ad">ad</aside>'
    || '<div id="comments">c<div class="comments">cc</div></div><footer>&copy; Shop</footer>'
    || '</body></html>'""",
}


# Small pages whose tags cross: formatting over blocks, over cells and items, text in a table.
MISNESTED_PAGE = f"""'<body>' || CASE p_partkey % 6
    WHEN 0 THEN '<b>a<p>' || p_name || '</b>c</p>'
    WHEN 1 THEN '<p>1<b>2<i>' || p_name || '</b>4</i>5</p>'
    WHEN 2 THEN '<table>' || p_name || '<tr><td>' || {_K} || '</table>z'
    WHEN 3 THEN '<ul><li><em>' || p_name || '<li>' || {_K} || '</em></ul>'
    WHEN 4 THEN '<a href="/' || {_K} || '"><div></a>' || p_name || '</div>'
    ELSE '<table><b><tr><td>' || p_name || '</td></tr>y</table>' || {_K} END || '</body>'"""


#: Rows in a partition at most, on average: some 6 MB of HTML, some 20 MB of payloads.
PAGES_A_PARTITION, PAYLOADS_A_PARTITION = 2000, 20_000


def _partitions(spark: SparkSession, rows: int, limit: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // limit))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html), spread by page_id: clean them with colocated=True.

    The table is one small file, so its rows are spread before pages are made of them, over more
    partitions the more rows there are.
    """
    part = read(spark, sf_dir, "part")
    spread = part.repartition(_partitions(spark, part.count(), PAGES_A_PARTITION), "p_partkey")
    return spread.selectExpr(*[f"{sql} AS {name}" for name, sql in PRODUCT_PAGE.items()])


# Extraction results: one payload per part, supplier, order and page.  The page_id of a
# row is ten times its key plus the number of its source, so no two are the same.

_P_URL = f"'https://shop.example.com/p/' || {_K} || '?ref=list'"
_OFFER = f"""
    '{{"@type":"Offer","price":' || CASE p_partkey % 5
        WHEN 0 THEN {_PRICE}
        WHEN 1 THEN '"$' || {_PRICE} || '"'
        WHEN 2 THEN '"USD 1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.50"'
        WHEN 3 THEN '"' || {_K} || ',5"'
        ELSE '"n/a"' END
    || ',"priceCurrency":"USD","availability":'
    || CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE '"InStock"' END
    || ',"url":"../buy/' || {_K} || '"}}'"""
_PRODUCT = f"""
    '{{"@type":"Product","name":' || CASE
        WHEN p_partkey % 17 = 0 THEN '""' WHEN p_partkey % 19 = 0 THEN 'null'
        ELSE '"' || p_name || '"' END
    || ',"description":' || CASE WHEN p_partkey % 5 = 0 THEN 'null'
        ELSE '"A ' || p_type || ' part"' END
    || ',"url":"/p/' || {_K} || '"'
    || CASE p_partkey % 4
        WHEN 0 THEN ',"image":["/img/' || {_K} || '.png","//cdn.example.com/a.png",""]'
        WHEN 1 THEN ',"image":[]'
        WHEN 2 THEN ',"image":{{"url":"/x.png"}}' ELSE '' END
    || ',"brand":{{' || CASE WHEN p_partkey % 6 = 0 THEN '"@type":"Organization",' ELSE '' END
    || '"name":"' || p_brand || '"}},"sku":"' || {_K} || '","gtin":'
    || CASE WHEN p_partkey % 2 = 0 THEN '"0' || {_K} || '"' ELSE 'null' END
    || ',"mpn":"m"' || CASE WHEN p_partkey % 3 = 0
        THEN ',"aggregateRating":{{"ratingValue":"4.5 out of 5","reviewCount":"1,234","bestRating":0}}'
        ELSE '' END
    || ',"offers":' || CASE WHEN p_partkey % 2 = 0 THEN {_OFFER}
        ELSE '[' || {_OFFER} || ',null]' END || '}}'"""
_WEBSITE = f"""
    '{{"@type":"WebSite","name":"Shop","url":"https://shop.example.com"' || CASE p_partkey % 3
        WHEN 0 THEN ',"potentialAction":{{"target":"https://shop.example.com/s?q={{q}}"}}'
        WHEN 1 THEN ',"potentialAction":{{"target":"/s","queryInput":"required name=q"}}'
        ELSE '' END || '}}'"""
_P_USAGE = """CASE p_partkey % 3
    WHEN 0 THEN '{"promptTokens":' || CAST(p_partkey AS STRING)
        || ',"completionTokens":20,"totalTokens":' || CAST(p_partkey + 20 AS STRING) || '}'
    WHEN 1 THEN '{"inputTokens":7,"outputTokens":8}'
    ELSE '{}' END"""

_S = "CAST(s_suppkey AS STRING)"
_ORGANIZATION = f"""
    '{{"@type":"Organization"' || CASE WHEN s_suppkey % 11 = 0 THEN ''
        ELSE ',"name":"' || s_name || '"' END
    || ',"logo":"' || CASE s_suppkey % 3 WHEN 0 THEN '/logo/' || {_S} || '.png'
        WHEN 1 THEN '//cdn.example.com/' || {_S} || '.png'
        ELSE 'https://img.example.com/' || {_S} || '.png' END
    || '","sameAs":' || CASE WHEN s_suppkey % 2 = 0 THEN '["https://x.example.com/' || {_S} || '"]'
        ELSE '[]' END || '}}'"""
_FAQ = """
    '{"@type":"FAQPage","mainEntity":[{"@type":"' || CASE WHEN s_suppkey % 5 = 0 THEN 'Q'
        ELSE 'Question' END
    || '","name":"q","acceptedAnswer":{"@type":"Answer","text":"t"}}]}'"""
_RECIPE = """
    '{"@type":"Recipe","name":' || CASE WHEN s_suppkey % 6 = 0 THEN '0' ELSE '"Soup"' END
    || ',"recipeIngredient":' || CASE WHEN s_suppkey % 4 = 0 THEN '"salt"' ELSE '["salt"]' END
    || '}'"""
_REVIEW = """
    '{"@type":"Review","reviewBody":"good","author":' || CASE WHEN s_suppkey % 3 = 0 THEN '"Ann"'
        ELSE '{"@type":"Person","name":"Ann"}' END || '}'"""
_CRUMBS = """'{"@type":"BreadcrumbList","itemListElement":[]}'"""

_O = "CAST(o_orderkey AS STRING)"
_MONTHS = "'Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec'"
_ITEM_LIST = f"""
    '{{"@type":"ItemList","name":"Order ' || {_O} || '","numberOfItems":"3 items",'
    || '"itemListElement":[' || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE
        '{{"url":"/o/' || {_O} || '","name":"Order ' || {_O} || '"}},'
        || '{{"@type":"ListItem","position":7,"url":null,"name":"' || o_orderpriority || '"}},'
        || '{{"position":null,"url":"c?k=' || CAST(o_custkey AS STRING) || '"}}' END
    || ']}}'"""
_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DATE_SPELLED = f"""CASE o_orderkey % 4
    WHEN 0 THEN {_DATE}
    WHEN 1 THEN split_part({_MONTHS}, ',', CAST(month(o_orderdate) AS INT)) || ' '
        || CAST(day(o_orderdate) AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING)
    WHEN 2 THEN {_DATE} || 'T23:30:00-05:00'
    ELSE 'around ' || CAST(year(o_orderdate) AS STRING) END"""
_VIDEO = f"""
    '{{"@type":"VideoObject","name":"Video ' || {_O} || '","thumbnailUrl":"/t/' || {_O}
    || '.jpg","uploadDate":"' || {_DATE_SPELLED} || '","duration":"PT1M","contentUrl":"//v.example.com/'
    || {_O} || '","embedUrl":' || CASE WHEN o_orderkey % 5 = 0 THEN '"http://"'
        ELSE '"https://e.example.com/x"' END || '}}'"""
_EVENT = """
    '{"@type":"Event"' || CASE WHEN o_orderstatus = 'P' THEN ''
        ELSE ',"name":"' || o_orderpriority || '","startDate":"2026-01-01"' END || '}'"""

_G = "CAST(page_id AS STRING)"
HEADLINE = (
    "replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), chr(92), chr(92) || chr(92)), "
    "chr(34), chr(92) || chr(34))"
)
_ARTICLE = f"""
    '{{"@type":"Article","headline":"' || {HEADLINE} || '"'
    || CASE WHEN page_id % 23 = 0 THEN ',"image":"/a.png"' ELSE ',"image":["/a.png"]' END
    || CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"author":{{"name":null,"type":"Organization"}}'
        ELSE ',"author":{{"name":"Ann","url":"/ann"}}' END
    || CASE WHEN page_id % 3 = 0 THEN ',"publisher":{{"name":"Press","logoUrl":"/l.png"}}'
        ELSE ',"publisher":{{"name":"Press"}}' END
    || ',"datePublished":"2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0')
    || '","dateModified":""}}'"""
_OTHER = f"""
    '{{' || CASE WHEN page_id % 29 = 0 THEN '' ELSE '"@type":"NewsArticle",' END
    || '"name":"News ' || {_G} || '","headline":"lost"}}'"""


def _payload(*entities: str) -> str:
    return "'{\"schemas\":[' || " + " || ',' || ".join(entities) + " || ']}'"


# table -> (page_id, page_url, payload, usage)
EXTRACTIONS = {
    "part": {
        "page_id": "p_partkey * 10 + 1",
        "page_url": _P_URL,
        "payload": _payload(_PRODUCT, _WEBSITE),
        "usage": _P_USAGE,
    },
    "supplier": {
        "page_id": "s_suppkey * 10 + 2",
        "page_url": f"'https://suppliers.example.com/list/?k=' || {_S}",
        "payload": _payload(_ORGANIZATION, _FAQ, _RECIPE, _REVIEW, _CRUMBS),
        "usage": "'{\"inputTokens\":5}'",
    },
    "orders": {
        "page_id": "o_orderkey * 10 + 3",
        "page_url": f"'https://shop.example.com/orders/' || {_O}",
        "payload": "CASE WHEN o_orderkey % 31 = 0 THEN '{\"schemas\":[]}' ELSE "
        + _payload(_ITEM_LIST, _VIDEO, _EVENT) + " END",
        "usage": "CAST(NULL AS STRING)",
    },
    "pages": {
        "page_id": "page_id * 10 + 4",
        "page_url": "url",
        "payload": "CASE WHEN page_id % 37 = 0 THEN '{\"schemas\":\"none\"}' ELSE "
        + _payload(_ARTICLE, _OTHER) + " END",
        "usage": "'not json'",
    },
}


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page_url, payload, usage) of all sources together, spread by page_id.

    Each source is one small file, which one task would read alone, so its rows are spread
    before payloads are made of them, over more partitions the more rows there are.
    """
    tables = {table: read(spark, sf_dir, table) for table in EXTRACTIONS}
    result = None
    for table, columns in EXTRACTIONS.items():
        rows = tables[table].selectExpr("*", f"{columns['page_id']} AS key", f"'{table}' AS made_from")
        result = rows if result is None else result.unionByName(rows, allowMissingColumns=True)
    n = sum(rows.count() for rows in tables.values())
    made = [
        "CASE made_from " + " ".join(f"WHEN '{t}' THEN {c[name]}" for t, c in EXTRACTIONS.items()) + f" END AS {name}"
        for name in ("page_url", "payload", "usage")
    ]
    return result.repartition(_partitions(spark, n, PAYLOADS_A_PARTITION), "key").selectExpr("key AS page_id", *made)


RUN_LOG = {
    "ts": "ts",
    "page_id": "user_id",
    "level": "CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' "
             "ELSE 'DEBUG' END",
    "stage": "CASE CAST(floor(event_id / 4) AS BIGINT) % 4 WHEN 0 THEN 'Ingestion' "
             "WHEN 1 THEN 'Cleaning' WHEN 2 THEN 'Extraction' ELSE 'Validator' END",
    "message": "event_type",
    "metadata": "props",
}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, page_id, level, stage, message, metadata) from the events."""
    events = read(spark, sf_dir, "events")
    return events.selectExpr(*[f"{sql} AS {name}" for name, sql in RUN_LOG.items()])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, fact): the lines of the document with the page's number."""
    documents = read(spark, sf_dir, "documents")
    return documents.selectExpr(
        "doc_id AS page_id", "posexplode(split(text, '\\n', -1)) AS (ord, fact)"
    )


# One validation problem list per order, as a contract checker reports it.
ISSUES = {
    "page_id": "o_orderkey",
    "issues": f"""
    '[{{"path":["schemas",' || CAST(o_orderkey % 5 AS STRING) || ',"name"],"message":"Bad '
    || o_orderpriority || '","expected":"string","received":"' || o_orderstatus
    || '","code":"invalid_type"}}' || CASE o_orderkey % 3
        WHEN 0 THEN ',{{"message":"No path","code":"custom"}}'
        WHEN 1 THEN ',{{"path":[],"message":"Top","expected":"","code":"other"}}' ELSE '' END
    || ']'""",
}


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.selectExpr(*[f"{sql} AS {name}" for name, sql in ISSUES.items()])
