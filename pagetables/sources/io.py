"""Reading pages and extraction results, writing and reloading what each stage made."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

# What each stage keeps, as columns beside page_id.
STAGES = {
    "raw": "url string, html string",
    "cleaned": "cleaned_html string",
    "text": "visible_text string",
    "structured": (
        "headings array<struct<level: int, text: string>>, "
        "lists array<struct<type: string, items: array<string>>>, "
        "tables array<struct<headers: array<string>, rows: array<array<string>>>>, "
        "images array<struct<src: string, alt: string>>, "
        "links array<struct<text: string, href: string>>, "
        "buttons array<struct<text: string>>, "
        "meta array<struct<name: string, property: string, content: string>>, "
        "json_ld array<string>"
    ),
    "extraction": "page_url string, payload string, usage string",
    "jsonld": "entity_types array<string>, json_ld array<string>, repairs array<string>",
}

EXTRACTION_SCHEMA = "page_id long, page_url string, payload string, usage string"


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, final_url[, status]); final_url is url where it is not given.

    page_id must be unique.
    """
    pages = spark.read.parquet(path)
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    status = ["status"] if "status" in pages.columns else []
    return pages.select("page_id", "url", "html", final.alias("final_url"), *status)


def with_html_size(pages: DataFrame) -> DataFrame:
    """+ html_size, in bytes of UTF-8."""
    return pages.withColumn("html_size", F.octet_length("html"))


def write_bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Pages as a table bucketed by page_id: cleaning it with colocated=True needs no
    Exchange."""
    pages.write.bucketBy(buckets, "page_id").mode("overwrite").saveAsTable(table)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of {page_id, page_url, payload: {schemas: [...]}, usage: {...}}; payload
    and usage stay JSON text."""
    return spark.read.schema(EXTRACTION_SCHEMA).json(path)


def write_stage(
    df: DataFrame, stage: str, run_id: str, path: str, fmt: str = "parquet"
) -> None:
    """Write what a stage made under its run; a rerun replaces its own run alone, in one step, also
    with nothing. Until then, and if it fails, readers see the old output."""
    store.replace(df.sparkSession, f"{path}/{stage}/run_id={run_id}", df, fmt)


def load_stage(spark: SparkSession, stage: str, run_id: str, path: str) -> DataFrame:
    """What a stage made in a run; an output that is not there counts as empty."""
    schema = f"page_id long, {STAGES[stage]}"
    saved = store.read(spark, f"{path}/{stage}/run_id={run_id}", schema)
    return spark.createDataFrame([], schema) if saved is None else saved


def save_clean(clean: DataFrame, run_id: str, path: str) -> None:
    """Write the cleaned, text and structured outputs of a cleaning result."""
    for stage in ["cleaned", "text", "structured"]:
        names = [part.split(" ")[0] for part in _split_fields(STAGES[stage])]
        write_stage(clean.select("page_id", *names), stage, run_id, path)


def load_clean(spark: SparkSession, run_id: str, path: str) -> DataFrame:
    """A cleaning result put together again from its saved outputs, missing ones empty."""
    result = load_stage(spark, "raw", run_id, path).select("page_id", "url")
    for stage in ["cleaned", "text", "structured"]:
        result = result.join(load_stage(spark, stage, run_id, path), "page_id", "left")
    empty = {
        name: F.coalesce(name, F.array().cast(kind) if kind.startswith("array") else F.lit(""))
        for stage in ["cleaned", "text", "structured"]
        for name, kind in (part.split(" ", 1) for part in _split_fields(STAGES[stage]))
    }
    return result.withColumns(empty)


def _split_fields(ddl: str) -> list[str]:
    """Fields of a DDL string, split at the commas outside angle brackets."""
    fields, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append("")
        else:
            fields[-1] += ch
    return [f.strip() for f in fields]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local session without
    the setting gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pagetables-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Save a result that several outputs are made from, so that it is computed once and
    outlives a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
