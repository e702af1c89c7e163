"""The registered queries: name -> f(spark, folder of tables) -> DataFrame.

Each reads whole tables.  Arrays are shown as joined text, so that results can be compared
as plain values.
"""

import uuid

from pyspark.sql import functions as F

from ..functions.repair import price_message, repair_date, repair_price, repair_url
from ..functions.text import decode_entities, js_trim
from ..operators import (
    clean as cl, contracts as co, documents as do, elements as el, jsonld as jl,
    quality as qu, runlog as rl, text as tx, tokens as tk, validate as va,
)
from ..sources import io
from ..streaming.stream import latest, stream_outcomes, stream_pages
from . import derived as de
from .pipeline import documents_of_run, page_text_stats, run_cleaning

SEP = " | "

# SQL that both engines read: inputs for the gates and the single repairs.
GATE_URL = (
    "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN replace(url, '://', ' ') "
    "WHEN 3 THEN NULL ELSE 'http://' END"
)
STATUS = "200 + o_orderkey % 400"
PRICE_TEXT = (
    "CASE p_partkey % 6 WHEN 0 THEN '$1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') "
    "|| '.25' WHEN 1 THEN CAST(p_partkey AS STRING) || ',5' WHEN 2 THEN 'n/a' "
    "WHEN 3 THEN 'Price, $' || CAST(p_partkey AS STRING) WHEN 4 THEN '-' || "
    "CAST(p_partkey AS STRING) || '.' ELSE CAST(p_partkey AS STRING) || '.5 of 10' END"
)
LINK_TEXT = (
    "CASE page_id % 9 WHEN 0 THEN '//cdn.example.com/i.png' WHEN 1 THEN '/p/' || "
    "CAST(page_id AS STRING) WHEN 2 THEN '?y=2' WHEN 3 THEN '#f' WHEN 4 THEN "
    "'mailto:a@b.example' WHEN 5 THEN '' WHEN 6 THEN 'https://z.example' WHEN 7 THEN "
    "'http://' ELSE '/a/./b/../c d' END"
)
SPACED = "' \t ' || p_name || '   ' || p_type || '﻿　'"


def _pages(spark, sf):
    return io.scan_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", "html")


def _clean(spark, sf, *columns):
    return el.clean_pages(_pages(spark, sf), list(columns))


def _products(spark, sf, *columns):
    return el.clean_pages(de.product_pages(spark, sf), list(columns), colocated=True)


def _marked(spark, sf):
    return cl.mark_removed(tk.tree(_pages(spark, sf)))


def _untouched(spark, sf, *columns):
    return el.clean_pages(_pages(spark, sf), list(columns), rules=[])


def _validated(spark, sf):
    return va.validate(co.entities(de.extractions(spark, sf)))


def _reasons(spark, sf):
    """Entities with their reason only: what counts and rates need."""
    rows = va.with_reason(co.entities(de.extractions(spark, sf)))
    return rows.withColumn("accepted", F.col("type").isNotNull() & F.col("reason").isNull())


def _validation(spark, sf):
    return va.page_validation(de.extractions(spark, sf))


def _successful(spark, sf):
    return va.successful_entities(de.extractions(spark, sf))


def _outcomes(spark, sf):
    """Outcomes of the extraction pages; every eighth URL is broken, every ninth status bad."""
    pages = de.extractions(spark, sf).selectExpr(
        "page_id",
        "CASE WHEN page_id % 8 = 0 THEN replace(page_url, '://', ' ') ELSE page_url END AS url",
        "'' AS html",
        "CASE WHEN page_id % 9 = 0 THEN 503 ELSE 200 END AS status",
        "CASE WHEN page_id % 101 = 0 THEN 'Lost connection' END AS error",
    )
    return va.page_outcomes(pages, _validation(spark, sf))


def _json_ld_of(*types):
    def query(spark, sf):
        rows = _validated(spark, sf).where(F.col("accepted") & F.col("type").isin(*types))
        return rows.select("page_id", "idx", "type", "json_ld")

    return query


def _joined(column, alias=None):
    return F.array_join(column, SEP).alias(alias or column)


def _lists(df):
    return df.select("page_id", "ord", "type", _joined("items"))


def token_rows(spark, sf):
    return tk.tokens(_pages(spark, sf))


def node_rows(spark, sf):
    nodes = tk.nodes(tk.tokens(_pages(spark, sf))).where(F.col("end").isNotNull())
    return nodes.select("page_id", F.col("i").alias("start"), "end", "tag")


def attribute_rows(spark, sf):
    nodes = tk.with_attrs(tk.tokens(_pages(spark, sf)))
    return nodes.select("page_id", "i", F.explode("attrs").alias("name", "value"))


def decoded_text(spark, sf):
    rows = tk.tokens(_pages(spark, sf)).where("tag = '#text'")
    return rows.select("page_id", "i", decode_entities("tok").alias("text"))


def trimmed_text(spark, sf):
    part = de.read(spark, sf, "part")
    return part.select("p_partkey", js_trim(F.expr(SPACED)).alias("trimmed"))


def selector_matches(spark, sf):
    tree = tk.with_attrs(tk.nodes(tk.tokens(de.product_pages(spark, sf), colocated=True)))
    rows = cl.removals(tree)
    return rows.groupBy("page_id", "grp", "rank", "tag").agg(F.count("*").alias("n"))


def survivors(spark, sf):
    alive = cl.surviving_tokens(_marked(spark, sf))
    return alive.groupBy("page_id").agg(
        F.count("*").alias("n_tokens"), F.sum(F.length("tok")).alias("n_chars")
    )


def _removal_counts(clean):
    n = [F.get("removed_by_group", F.lit(k)) for k in range(3)]
    return clean.select(
        "page_id", n[0].alias("technical"), n[1].alias("hidden"), n[2].alias("boilerplate"),
        (n[0] + n[1] + n[2]).alias("elements_removed"),
    )


def preview(spark, sf):
    shown = el.preview_elements(_products(spark, sf, *el.COUNTED_COLUMNS))
    return shown.select(
        "page_id", _joined(F.col("images")["src"], "images"),
        _joined(F.col("links")["href"], "links"), F.size("tables").alias("n_tables"),
    )


def table_rows(spark, sf):
    rows = el.table_rows(_products(spark, sf, "tables"))
    return rows.select("page_id", "ord", "pos", _joined("cells"))


def tables(spark, sf):
    rows = el.tables(_products(spark, sf, "tables"))
    lines = F.transform("rows", lambda r: F.array_join(r, ","))
    return rows.select("page_id", "ord", _joined("headers"), _joined(lines, "rows"))


def merged_text(spark, sf):
    return tx.merge_facts(_clean(spark, sf, "visible_text"), de.facts(spark, sf))


def price_repair(spark, sf):
    raw = de.read(spark, sf, "part").selectExpr("p_partkey", f"{PRICE_TEXT} AS raw")
    priced = raw.withColumn("price", repair_price("raw"))
    return priced.withColumn("message", price_message(F.col("raw"), F.col("price")))


def url_repair(spark, sf):
    raw = _pages(spark, sf).selectExpr("page_id", "url", f"{LINK_TEXT} AS raw")
    return raw.select("page_id", "raw", repair_url("raw", "url").alias("repaired"))


def misnested_html(spark, sf):
    """Pages of six kinds of misnested tags around the name of a part, written out from their trees."""
    part = de.read(spark, sf, "part")
    pages = part.selectExpr("p_partkey AS page_id", "'u' AS url", f"{de.MISNESTED_PAGE} AS html")
    clean = el.clean_pages(pages, ["cleaned_html", "visible_text"], rules=[], in_tree_order=True)
    return clean.select("page_id", "cleaned_html", F.replace("visible_text", F.lit("\n"), F.lit(SEP)).alias("visible_text"))


def host_repair(spark, sf):
    """A relative link on bases whose host is spelled as a number, in another script, or wrongly."""
    number = "(page_id * 7919 % 4294967296)"
    base = (
        f"CASE page_id % 5 WHEN 0 THEN 'http://0x' || hex({number}) || '/' "
        f"WHEN 1 THEN 'http://' || CAST({number} AS STRING) || '/x/y' "
        f"WHEN 2 THEN 'http://0' || conv({number}, 10, 8) "
        "WHEN 3 THEN 'http://B%C3%BCcher.H' || CAST(page_id AS STRING) || 'a.example:80/q' "
        "ELSE 'http://1.2.3.' || CAST(256 + page_id % 10 AS STRING) END"
    )
    rows = _pages(spark, sf).selectExpr("page_id", f"{base} AS base")
    return rows.select("page_id", repair_url(F.lit("p"), "base").alias("repaired"))


def date_repair(spark, sf):
    raw = de.read(spark, sf, "orders").selectExpr("o_orderkey", f"{de._DATE_SPELLED} AS raw")
    return raw.select("o_orderkey", "raw", repair_date("raw").alias("repaired"))


def entity_contracts(spark, sf):
    rows = co.classify(co.entities(de.extractions(spark, sf)))
    return rows.select("page_id", "idx", "type", "contract")


def required_rule(spark, sf):
    rows = co.entities(de.extractions(spark, sf))
    return rows.select(
        "page_id", "idx", "type", _joined(va.required_fields(F.col("type")), "required")
    )


def page_results(spark, sf):
    rows = va.page_result(de.extractions(spark, sf))
    return rows.select(
        "page_id", _joined("entity_types"), F.size("json_ld").alias("n_accepted"),
        _joined("repairs"),
    )


def script_tags(spark, sf):
    rows = va.accepted_entities(_validated(spark, sf))
    return jl.script_blocks(rows).select("page_id", "idx", "script")


def stage_round_trip(spark, sf):
    out = f"{io.shared_dir(spark)}/stages-{_unique()}"
    raw = _pages(spark, sf)
    io.write_stage(raw.limit(0), "raw", "before", out)
    io.write_stage(raw, "raw", "run1", out)
    io.write_stage(raw, "raw", "run1", out)
    return io.load_stage(spark, "raw", "run1", out).select("page_id", "url", "html")


def reloaded_documents(spark, sf):
    out = f"{io.shared_dir(spark)}/run-{_unique()}"
    run_cleaning(de.product_pages(spark, sf), "run1", out, colocated=True)
    return documents_of_run(spark, "run1", out)


def extractions_from_json(spark, sf):
    out = f"{io.shared_dir(spark)}/extractions-{_unique()}"
    lines = de.extractions(spark, sf).selectExpr(
        "concat('{\"page_id\":', page_id, ',\"page_url\":\"', page_url, '\",\"payload\":', "
        "payload, '}') AS value"
    )
    lines.write.text(out)
    rows = co.parse_extractions(io.read_extractions(spark, out))
    return rows.select("page_id", "page_url", F.size("schemas").alias("n_entities"))


LATE_PAYLOAD = (
    "CASE WHEN page_id % 8 = 1 THEN '{\"schemas\":[]}' "
    "ELSE '{\"schemas\":[{\"@type\":\"Article\",\"headline\":\"h\"}]}' END"
)


def streamed_pages(spark, sf):
    base = f"{io.shared_dir(spark)}/stream-{_unique()}"
    de.product_pages(spark, sf).repartition(4).write.parquet(f"{base}/in")
    stream = stream_pages(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", max_files=2)
    stream.awaitTermination()
    return latest(spark, f"{base}/out").select("page_id", "visible_text", "document")


def late_results(spark, sf):
    """Results that come with their page, after it, before it and never, by page_id modulo 4."""
    base = f"{io.shared_dir(spark)}/late-{_unique()}"
    pages = _pages(spark, sf).selectExpr("page_id", "url", "html", "timestamp'2026-01-01 10:00:00' AS fetched")
    results = pages.selectExpr("page_id", "url AS page_url", f"{LATE_PAYLOAD} AS payload",
                               "CAST(NULL AS STRING) AS usage", "timestamp'2026-01-01 10:30:00' AS made")
    waves = [("page_id % 4 <> 2", "page_id % 4 IN (0, 2)"), ("page_id % 4 = 2", "page_id % 4 = 1")]
    # the last page and its result come a day later, so that nothing else is waited for
    last = [spark.range(1).selectExpr(
        "-1L AS page_id", "'http://h.example/' AS url", "'' AS html", "timestamp'2026-01-02 10:00:00' AS fetched")]
    last.append(last[0].selectExpr("page_id", "url AS page_url", f"{LATE_PAYLOAD} AS payload",
                                   "CAST(NULL AS STRING) AS usage", "fetched AS made"))
    for new_pages, new_results in [*((pages.where(p), results.where(r)) for p, r in waves), last]:
        new_pages.write.mode("append").parquet(f"{base}/pages")
        new_results.write.mode("append").parquet(f"{base}/results")
        stream_outcomes(spark, f"{base}/pages", f"{base}/results", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return latest(spark, f"{base}/out").select("page_id", "success", "stage", "reason", "code")


def _unique() -> str:
    return uuid.uuid4().hex


def stage_time_rows(spark, sf):
    return rl.stage_times(de.run_log(spark, sf))


def time_view(spark, sf):
    usage = va.token_usage(de.extractions(spark, sf))
    return qu.stats_view(stage_time_rows(spark, sf), usage)


QUERIES = {
    # sources, gates, sinks
    "scan_pages": lambda s, d: io.scan_pages(s, f"{d}/pages.parquet"),
    "html_size": lambda s, d: io.with_html_size(_pages(s, d)).select("page_id", "html_size"),
    "url_gate": lambda s, d: va.gate_urls(
        _pages(s, d).selectExpr("page_id", f"{GATE_URL} AS url")),
    "status_gate": lambda s, d: va.gate_status(
        de.read(s, d, "orders").selectExpr("o_orderkey AS page_id", f"{STATUS} AS status")),
    "stage_round_trip": stage_round_trip,
    "reloaded_documents": reloaded_documents,
    "extractions_from_json": extractions_from_json,
    "element_preview": preview,
    "script_tags": script_tags,
    # tokens, nodes, attributes, selectors
    "tokens": token_rows,
    "nodes": node_rows,
    "attributes": attribute_rows,
    "selector_matches": selector_matches,
    "decoded_text": decoded_text,
    "trimmed_text": trimmed_text,
    # cleaning
    "page_text_stats": lambda s, d: page_text_stats(_pages(s, d)),
    "surviving_tokens": survivors,
    "removal_counts": lambda s, d: cl.removal_counts(_marked(s, d)),
    "product_removal_counts": lambda s, d: _removal_counts(_products(s, d, "removed_by_group")),
    "cleaned_html": lambda s, d: _clean(s, d, "cleaned_html").drop("url"),
    "clean_stats": lambda s, d: el.clean_stats(_clean(s, d, *el.STATS_COLUMNS)),
    "element_counts": lambda s, d: el.element_counts(_clean(s, d, *el.COUNTED_COLUMNS)),
    "product_element_counts": lambda s, d: el.element_counts(_products(s, d, *el.COUNTED_COLUMNS)),
    # elements
    "headings": lambda s, d: el.headings(_clean(s, d, "headings")),
    "product_headings": lambda s, d: el.headings(_products(s, d, "headings")),
    "lists_before_removal": lambda s, d: _lists(el.lists(_untouched(s, d, "lists"))),
    "product_lists": lambda s, d: _lists(el.lists(_products(s, d, "lists"))),
    "table_headers": lambda s, d: el.table_headers(_products(s, d, "tables")),
    "table_rows": table_rows,
    "tables": tables,
    "images": lambda s, d: el.images(_products(s, d, "images")),
    "links_before_removal": lambda s, d: el.links(_untouched(s, d, "links")),
    "product_links": lambda s, d: el.links(_products(s, d, "links")),
    "buttons": lambda s, d: el.buttons(_products(s, d, "buttons")),
    "meta_tags": lambda s, d: el.meta_tags(_products(s, d, "meta")),
    "existing_json_ld": lambda s, d: el.existing_json_ld(_products(s, d, "json_ld")),
    # text
    "text_parts": lambda s, d: tx.text_parts(_marked(s, d)),
    "deduped_parts": lambda s, d: tx.dedupe_adjacent(tx.text_parts(_marked(s, d))),
    "visible_text": lambda s, d: tx.visible_text(_clean(s, d, "visible_text")),
    "product_visible_text": lambda s, d: tx.visible_text(_products(s, d, "visible_text")),
    "paragraph_text": lambda s, d: tx.paragraph_text(
        _products(s, d, "headings", "paragraphs", "lists")),
    "flat_text": lambda s, d: tx.flatten_text(_marked(s, d)),
    "merged_text": merged_text,
    # documents
    "document_sections": lambda s, d: do.doc_sections(_products(s, d, *el.DOCUMENT_COLUMNS)),
    "documents": lambda s, d: do.documents(_clean(s, d, *el.DOCUMENT_COLUMNS)),
    "product_documents": lambda s, d: do.documents(_products(s, d, *el.DOCUMENT_COLUMNS)),
    "documents_with_json_ld": lambda s, d: do.documents(_products(s, d, *el.DOCUMENT_COLUMNS), with_json_ld=True),
    "document_stats": lambda s, d: do.doc_stats(do.documents(_products(s, d, *el.DOCUMENT_COLUMNS))),
    # contracts
    "entities": lambda s, d: co.entities(de.extractions(s, d)).select("page_id", "idx", "type"),
    "contracts": entity_contracts,
    "extraction_failures": lambda s, d: va.extraction_failures(de.extractions(s, d)),
    "issue_report": lambda s, d: co.issue_report(de.issues(s, d)),
    # repairs
    "price_repair": price_repair,
    "url_repair": url_repair,
    "host_repair": host_repair,
    "misnested_html": misnested_html,
    "date_repair": date_repair,
    # required fields and JSON-LD
    "required_fields": required_rule,
    "rejected_entities": lambda s, d: va.rejected_entities(_reasons(s, d)),
    "product_json_ld": _json_ld_of("Product"),
    "organization_json_ld": _json_ld_of("Organization"),
    "website_json_ld": _json_ld_of("WebSite"),
    "itemlist_json_ld": _json_ld_of("ItemList"),
    "article_json_ld": _json_ld_of("Article", "BlogPosting"),
    "video_json_ld": _json_ld_of("VideoObject"),
    "other_json_ld": _json_ld_of(
        "Event", "Recipe", "Review", "FAQPage", "BreadcrumbList", "NewsArticle"),
    # validation and outcomes
    "page_validation": _validation,
    "page_results": page_results,
    "page_outcomes": _outcomes,
    "outcome_codes": lambda s, d: va.outcome_code(_outcomes(s, d)).groupBy(
        "stage", "code").agg(F.count("*").alias("n")),
    "token_usage": lambda s, d: va.token_usage(de.extractions(s, d)),
    # quality
    "acceptance_by_page": lambda s, d: qu.acceptance_rate(_successful(s, d), ["page_id"]),
    "acceptance_by_type": lambda s, d: qu.acceptance_rate(_successful(s, d), ["type"]),
    "acceptance_overall": lambda s, d: qu.acceptance_rate(_successful(s, d), []),
    "rejection_reasons": lambda s, d: qu.rejection_reasons(_successful(s, d)),
    "rejection_details": lambda s, d: qu.rejection_details(_successful(s, d)),
    "quality_metrics": lambda s, d: qu.quality_metrics(_validation(s, d)),
    "type_summary": lambda s, d: qu.type_summary(_successful(s, d)),
    # run log
    "stage_times": stage_time_rows,
    "stats_view": time_view,
    "log_filter": lambda s, d: rl.log_filter(de.run_log(s, d)),
    "log_lines": lambda s, d: rl.log_lines(rl.log_filter(de.run_log(s, d))).select(
        "page_id", "line"),
    "log_summary": lambda s, d: rl.log_summary(de.run_log(s, d)),
    # stream
    "streamed_pages": streamed_pages,
    "late_results": late_results,
}
