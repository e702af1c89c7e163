"""Where the work of larger tables goes: rows are spread before pages and payloads are made."""

import re

import pytest
from pyspark.sql import functions as F

from pagetables.functions.html import attributes_of, selector_rank, tag_of
from pagetables.operators import contracts as co, tokens as tk
from pagetables.operators.elements import SORTED_FOLD, clean_pages, headings
from pagetables.plans import derived as de

TABLES = {
    "part": "id AS p_partkey, 'n' AS p_name, 't' AS p_type, 'b' AS p_brand, 1.5D AS p_retailprice, 3 AS p_size",
    "supplier": "id AS s_suppkey, 's' AS s_name",
    "orders": "id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus, timestamp'2024-01-02' AS o_orderdate, '1-URGENT' AS o_orderpriority",
    "pages": "id AS page_id, 'https://h.example/' AS url, '<h1>h</h1>' AS html",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, columns in TABLES.items():
        spark.range(1, 21).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_made_after_rows_are_spread(spark, tables, monkeypatch):
    found = headings(clean_pages(de.product_pages(spark, tables), ["headings"], colocated=True))
    assert len(re.findall(r"\bExchange ", plan(found))) == 1
    assert "DOCTYPE" not in plan(found).split("Exchange ")[-1]
    assert found.count() == 40
    assert de.product_pages(spark, tables).rdd.getNumPartitions() == 4
    monkeypatch.setattr(de, "PAGES_A_PARTITION", 2)
    assert de.product_pages(spark, tables).rdd.getNumPartitions() == 10


def test_payloads_are_made_after_rows_are_spread(spark, tables, monkeypatch):
    rows = de.extractions(spark, tables)
    entities = co.entities(rows)
    below = plan(entities).split("Exchange ", 1)[1]
    assert "parse_json" not in below and "schemas" not in below
    assert "Exchange" not in below
    assert rows.count() == 80
    assert entities.groupBy().agg(F.count("*")).first()[0] == 20 * (2 + 5 + 3 + 2)
    monkeypatch.setattr(de, "PAYLOADS_A_PARTITION", 2)
    assert de.extractions(spark, tables).rdd.getNumPartitions() == 40


def test_entities_of_empty_and_missing_lists(spark):
    payloads = ['{"schemas":[]}', '{"schemas":1}', None, '{"schemas":[{"@type":"A"},{"@type":"B"}]}', '{"schemas":[null]}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "page_id long, payload string").withColumn("page_url", F.lit("u"))
    assert sorted((r.page_id, r.idx, r.type) for r in co.entities(rows).collect()) == [(3, 0, "A"), (3, 1, "B"), (4, 0, None)]


def test_partitions_grow_with_the_html(spark, monkeypatch):
    pages = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 50) AS html")
    assert tk.spread_by_size(pages).rdd.getNumPartitions() == 4
    assert tk.spread_by_size(pages.limit(0)).rdd.getNumPartitions() == 4
    monkeypatch.setattr(tk, "BYTES_A_PARTITION", 100)
    assert tk.spread_by_size(pages).rdd.getNumPartitions() == 10


def folds(df):
    text = plan(df)
    return text.count("ObjectHashAggregate"), text.count("SortAggregate"), text.count("Window [")


def test_sorted_pages_are_folded_once(spark):
    """A hash aggregate of lists would sort all tokens once more and merge partial lists (F5 to F21)."""
    pages = spark.createDataFrame([(1, "u", "<table><td>a</table>"), (2, "u", "b")], "page_id long, url string, html string")
    hashed, sorted_, windows = folds(clean_pages(pages, ["headings", "cleaned_html"]))
    assert (hashed, sorted_) == (0, 1)
    assert windows <= 6  # seven when the frame of a table had a window of its own


def test_session_setting_of_the_fold_is_kept(spark):
    key, kept = SORTED_FOLD[0], spark.conf.get(SORTED_FOLD[0], None)
    try:
        spark.conf.set(key, "false")
        clean_pages(spark.createDataFrame([], "page_id long, url string, html string"), ["headings"])
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.set(key, kept or "true")


def test_tags_of_odd_tokens(spark):
    cases = {
        "a < b": "#text", "< b": "#text", "<": "#text", "": "#text", None: "#text", "<B>": "b", "</Li >": "li",
        "<div": "#unfinished", "</p": "#unfinished", "<script>a": "script", "</style": "style", "<!-- >": "#comment",
        "<!-": "#declaration", "<?x>": "#declaration", "</>": "#declaration", "<a\nb>": "a", "<x-y/>": "x-y",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "tok string").select("tok", tag_of(F.col("tok")).alias("tag"))
    assert {r.tok: r.tag for r in rows.collect()} == cases


def test_repeated_attributes_and_selectors(spark):
    toks = ['<a x="1" X="2" y>', '<div hidden="">', "<script>", '<script type="application/ld+json">', "<p>", "<nav x>", "text <"]
    rows = spark.createDataFrame([(t,) for t in toks], "tok string").withColumn("attrs", attributes_of(F.col("tok")))
    rank = selector_rank(["nav", "[hidden]", 'script:not([type="application/ld+json"])'], tag_of(F.col("tok")), F.col("attrs"))
    found = {r.tok: (r.attrs, r.rank) for r in rows.withColumn("rank", rank).collect()}
    assert found == {
        toks[0]: ({"x": "1", "y": ""}, None), toks[1]: ({"hidden": ""}, 2), toks[2]: (None, 3),
        toks[3]: ({"type": "application/ld+json"}, None), toks[4]: (None, None), toks[5]: ({"x": ""}, 1), toks[6]: (None, None)}
