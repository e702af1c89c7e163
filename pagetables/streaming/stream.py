"""Pages that arrive over time: micro-batches through the same operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import document
from ..operators.elements import DOCUMENT_COLUMNS, clean_pages
from ..operators.quality import quality_metrics
from ..operators.tokens import spread_by_size
from ..operators.validate import (
    gate_status, gate_urls, outcome_code, page_outcomes, page_validation,
)
from ..sources import store
from ..sources.io import EXTRACTION_SCHEMA

NO_PAGE = "No page for this result"
PAGE_SCHEMA = "page_id long, url string, html string"
TIMED_PAGE_SCHEMA = f"{PAGE_SCHEMA}, fetched timestamp"
RESULT_SCHEMA = f"{EXTRACTION_SCHEMA}, made timestamp"


def process(pages: DataFrame, extractions: DataFrame | None = None, colocated: bool = False) -> DataFrame:
    """One row per page: text, document, and with extraction results outcome and quality.

    Pages that a gate refuses are not cleaned. With extraction results they come with their
    outcome and without text; else they are left out.
    """
    gated = gate_urls(pages)
    if "status" in pages.columns:
        gated = gated.where("reason IS NULL").transform(gate_status)
    clean = clean_pages(gated.where("reason IS NULL").drop("reason"), DOCUMENT_COLUMNS, colocated=colocated)
    result = clean.select("page_id", "visible_text", document().alias("document"))
    if extractions is None:
        return result
    wanted = extractions.join(pages.select("page_id"), "page_id", "left_semi")
    validation = page_validation(wanted)
    outcomes = outcome_code(page_outcomes(pages, validation))
    quality = quality_metrics(validation)
    added = [c for part in (outcomes, quality) for c in part.columns if c != "page_id"]
    return (
        outcomes.join(result, "page_id", "left").join(quality, "page_id", "left")
        .select(*result.columns, *added)
    )


def newest(batch: DataFrame, version: str | None = None) -> DataFrame:
    """One row per page: that of the greatest `version`; without one, or among equals, that of
    the greatest html, then url, so that a replay takes the same."""
    first = [c for c in (version, "html", "url") if c]
    rest = [c for c in batch.columns if c not in (*first, "page_id")]
    row = F.max(F.struct(*first, *rest)).alias("row")
    return batch.groupBy("page_id").agg(row).select("page_id", "row.*").select(*batch.columns)


def stream_pages(
    spark: SparkSession, source: str, out: str, checkpoint: str,
    extractions: DataFrame | None = None, max_files: int = 1000, schema: str = PAGE_SCHEMA,
    version: str | None = None, buckets: int = 64,
):
    """Run the pages of a folder that are new since the last call through `process`.

    Each micro-batch is put into a store by page, where it writes only the buckets again that its
    pages fall into; a batch that is replayed after a failure changes nothing. `latest` reads one row
    per page. `version` names the column that tells which row of a page is the newest
    within a batch, see `newest`. Results that come after their page: see `stream_outcomes`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        done = process(newest(spread_by_size(batch), version), extractions, colocated=True)
        store.upsert(spark, out, done, batch=batch_id, buckets=buckets)

    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    )
    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each page."""
    return store.read(spark, out)


def _outcomes(batch: DataFrame) -> DataFrame:
    """Outcome and quality of pages with the newest of their results, if any; results without a page are failures of their own."""
    pages = batch.where("page_id IS NOT NULL").groupBy("page_id").agg(
        F.max_by(F.struct("url", "has_html"), "fetched").alias("page"),
        F.max(F.when(F.col("made").isNotNull(), F.struct("made", "payload", "usage", "page_url"))).alias("result"),
    )
    html = F.when(F.col("page.has_html"), F.lit(""))
    results = pages.where("result IS NOT NULL").select("page_id", "result.page_url", "result.payload", "result.usage")
    validation = page_validation(results)
    outcomes = outcome_code(page_outcomes(pages.select("page_id", "page.url", html.alias("html")), validation))
    quality = quality_metrics(validation)
    known = outcomes.join(quality, "page_id", "left")
    lost = batch.where("page_id IS NULL").select(F.col("of_page").alias("page_id")).distinct()
    columns = {"success": F.lit(False), "stage": F.lit("ingestion"), "reason": F.lit(NO_PAGE)}
    return known.unionByName(outcome_code(lost.withColumns(columns)), allowMissingColumns=True)


def stream_outcomes(
    spark: SparkSession, page_source: str, result_source: str, out: str, checkpoint: str,
    wait: str = "1 hour", max_files: int = 1000, buckets: int = 64,
):
    """Join pages with extraction results that come before or after them, up to `wait` apart.

    Both are streams of files (TIMED_PAGE_SCHEMA, RESULT_SCHEMA) that keep only keys and results as state. A
    pair gets its outcome when the second of the two comes; a page without a result, and a result without
    a page, when both streams have passed its time by `wait`, the time after which nothing is kept for it. The
    outcomes are put into a store by page; read them with `latest`.
    """
    def arriving(path: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)

    pages = arriving(page_source, TIMED_PAGE_SCHEMA).select(
        "page_id", "url", F.col("html").isNotNull().alias("has_html"), "fetched"
    ).withWatermark("fetched", wait)
    results = arriving(result_source, RESULT_SCHEMA).withColumnRenamed("page_id", "of_page").withWatermark("made", wait)
    near = F.expr(f"page_id = of_page AND made BETWEEN fetched - INTERVAL {wait} AND fetched + INTERVAL {wait}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read several times; a lost part is joined again from the state
        try:
            store.upsert(spark, out, _outcomes(batch), batch=batch_id, buckets=buckets)
        finally:
            batch.unpersist()

    return (
        pages.join(results, near, "full_outer").writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
