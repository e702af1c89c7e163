"""Sources, sinks, streams and the shape of plans."""

import os
import re
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagetables.operators.elements import clean_pages, headings
from pagetables.plans.pipeline import documents_of_run, run_cleaning
from pagetables.sources import io, store
from pagetables.streaming.stream import RESULT_SCHEMA, TIMED_PAGE_SCHEMA, latest, stream_outcomes, stream_pages

SCHEMA = "page_id long, url string, html string"
PAGES = [(n, f"https://h.example/{n}", f"<body><h1>t{n}</h1><a href='/{n}'>l</a>") for n in range(6)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


@pytest.fixture
def out():
    return tempfile.mkdtemp(prefix="run-")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange ", plan))


def test_one_exchange(pages):
    assert exchanges(clean_pages(pages)) == 1
    assert exchanges(headings(clean_pages(pages, ["headings"]))) == 1


def test_no_exchange_on_bucketed_pages(spark, pages):
    io.write_bucketed_pages(pages, "bucketed_pages", 4)
    table = spark.table("bucketed_pages")
    result = clean_pages(table, ["visible_text"], colocated=True)
    assert exchanges(result) == 0
    assert sorted(r.visible_text for r in result.collect()) == [f"t{n}\nl" for n in range(6)]


def test_only_needed_columns_are_read(spark, pages, out):
    pages.write.parquet(f"{out}/p")
    plan = clean_pages(spark.read.parquet(f"{out}/p"), ["visible_text"], keep=())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_stages(spark, pages, out):
    io.write_stage(pages, "raw", "a", out)
    io.write_stage(pages.limit(2), "raw", "b", out)
    io.write_stage(pages.limit(3), "raw", "b", out)
    assert io.load_stage(spark, "raw", "a", out).count() == 6
    assert io.load_stage(spark, "raw", "b", out).count() == 3
    assert io.load_stage(spark, "text", "a", out).count() == 0


def test_documents_of_a_saved_run(spark, pages, out):
    run_cleaning(pages, "a", out)
    docs = {r.page_id: r.document for r in documents_of_run(spark, "a", out).collect()}
    assert len(docs) == 6 and "# t3" in docs[3] and "l → /3" in docs[3]
    # Without saved outputs the sections are empty, but the document is there.
    io.write_stage(pages.limit(1), "raw", "b", out)
    row = documents_of_run(spark, "b", out).head()
    assert "## HEADINGS" not in row.document and "## MAIN CONTENT\n\n" in row.document


def test_read_extractions(spark, out):
    spark.createDataFrame(
        [('{"page_id":1,"page_url":"u","payload":{"schemas":[{"@type":"X","n":1}]}}',)], "value string"
    ).write.text(f"{out}/e")
    row = io.read_extractions(spark, f"{out}/e").head()
    assert row.payload == '{"schemas":[{"@type":"X","n":1}]}' and row.usage is None


def test_stream(spark, pages, out):
    args = (spark, f"{out}/in", f"{out}/out", f"{out}/checkpoint")
    pages.write.parquet(f"{out}/in")
    stream_pages(*args).awaitTermination()
    assert latest(spark, f"{out}/out").count() == 6
    # A page that comes again replaces its row; nothing new changes nothing.
    again = spark.createDataFrame([(3, "http://u.example/", "<body>new")], SCHEMA)
    again.write.mode("append").parquet(f"{out}/in")
    stream_pages(*args).awaitTermination()
    stream_pages(*args).awaitTermination()
    rows = {r.page_id: r.visible_text for r in latest(spark, f"{out}/out").collect()}
    assert len(rows) == 6 and rows[3] == "new" and rows[2] == "t2\nl"


def test_stage_outputs_are_replaced_also_with_nothing(spark, pages, out):
    io.write_stage(pages, "raw", "a", out)
    io.write_stage(pages, "raw", "b", out)
    io.write_stage(pages.limit(0), "raw", "a", out)
    assert io.load_stage(spark, "raw", "a", out).count() == 0
    assert io.load_stage(spark, "raw", "b", out).count() == 6


def test_a_failed_write_leaves_the_old_rows(spark, pages, out):
    io.write_stage(pages, "raw", "a", out)
    reader = io.load_stage(spark, "raw", "a", out)
    broken = pages.withColumn("html", F.when(F.col("page_id") == 3, F.raise_error(F.lit("killed"))).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        io.write_stage(broken.repartition(4), "raw", "a", out)
    assert io.load_stage(spark, "raw", "a", out).where("html <> 'new'").count() == 6
    io.write_stage(pages.limit(2), "raw", "a", out)
    # who began to read before the change can go on; what failed is gone
    assert reader.count() == 6 and io.load_stage(spark, "raw", "a", out).count() == 2
    root = f"{out}/raw/run_id=a"
    named = set(store.current(spark, root)["parts"].values())
    assert len([n for n in os.listdir(root) if n.startswith("data-")]) == 2 and len(named) == 1


def test_a_draft_that_was_never_renamed_is_no_manifest(spark, pages, out):
    store.replace(spark, f"{out}/s", pages)
    with open(f"{out}/s/_manifests/.draft-x", "w") as draft:
        draft.write('{"parts": {')
    assert store.read(spark, f"{out}/s").count() == 6
    assert store.read(spark, f"{out}/nothing") is None


def test_upsert_writes_only_touched_buckets(spark, pages, out):
    root = f"{out}/s"
    rows = spark.range(200).select(F.col("id").alias("page_id"), F.lit(0).alias("n"))
    store.upsert(spark, root, rows, batch=0, buckets=16)
    first = store.current(spark, root)["parts"]
    assert len(first) == 16
    one = rows.where("page_id = 7").withColumn("n", F.lit(1))
    for batch in range(1, 6):
        store.upsert(spark, root, one.withColumn("n", F.lit(batch)), batch=batch)
        now = store.current(spark, root)["parts"]
        assert sum(now[b] != first[b] for b in first) == 1
    store.upsert(spark, root, rows.limit(0), batch=6)
    found = {r.page_id: r.n for r in store.read(spark, root).collect()}
    assert len(found) == store.read(spark, root).count() == 200 and found[7] == 5 and found[8] == 0
    # a replay changes nothing, and few folders stay
    store.upsert(spark, root, one.withColumn("n", F.lit(99)), batch=4)
    assert store.read(spark, root).where("n = 99").count() == 0
    assert len([n for n in os.listdir(root) if n.startswith("data-")]) <= 4


def test_an_empty_first_batch(spark, pages, out):
    store.upsert(spark, f"{out}/s", pages.limit(0), batch=0)
    assert store.read(spark, f"{out}/s").count() == 0 and store.read(spark, f"{out}/s").columns == pages.columns
    store.upsert(spark, f"{out}/s", pages, batch=1)
    assert store.read(spark, f"{out}/s").count() == 6


def test_results_before_after_and_never(spark, out):
    def arrive(pages, results):
        rows = [(p, f"http://h.example/{p}", "<p>", datetime(2026, 1, 1, *t)) for p, t in pages]
        spark.createDataFrame(rows, TIMED_PAGE_SCHEMA).write.mode("append").parquet(f"{out}/pages")
        rows = [(p, "http://h.example/", payload, None, datetime(2026, 1, 1, *t)) for p, payload, t in results]
        spark.createDataFrame(rows, RESULT_SCHEMA).write.mode("append").parquet(f"{out}/results")
        stream_outcomes(spark, f"{out}/pages", f"{out}/results", f"{out}/out", f"{out}/checkpoint").awaitTermination()
        return {r.page_id: (r.success, r.reason) for r in latest(spark, f"{out}/out").collect()}

    good = '{"schemas":[{"@type":"Article","headline":"h"}]}'
    found = arrive([(1, (10, 0)), (3, (10, 0)), (5, (10, 0))], [(2, good, (10, 0)), (4, good, (10, 0)), (5, good, (10, 1))])
    assert found == {5: (True, None)}
    found = arrive([(2, (10, 20))], [(1, good, (10, 30)), (5, '{"schemas":[]}', (10, 31))])
    assert found == {1: (True, None), 2: (True, None), 5: (False, "No valid entities after validation")}
    # both streams have passed 10:00 by more than the wait: what has no partner is given up
    found = arrive([(8, (15, 0))], [(8, good, (15, 0))])
    assert found[3] == (False, "No extraction result") and found[4] == (False, "No page for this result")
    assert found[1] == found[2] == found[8] == (True, None) and len(found) == 6


def test_a_page_twice_in_one_batch_and_gates(spark, out):
    rows = [(1, "http://a.example/", "<body>old", 1), (1, "http://a.example/", "<body>and new", 2),
            (2, "no url", "<body>x", 1)]
    schema = f"{SCHEMA}, fetched long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/in")
    stream_pages(spark, f"{out}/in", f"{out}/out", f"{out}/checkpoint", schema=schema,
                 version="fetched").awaitTermination()
    assert {r.page_id: r.visible_text for r in latest(spark, f"{out}/out").collect()} == {1: "and new"}


class _Session:
    """A cluster session, as far as shared_dir looks at it."""

    def __init__(self, settings):
        self.settings = settings
        self.conf = self
        self.sparkContext = self
        self.master = "spark://cluster"

    def get(self, key, default):
        return self.settings.get(key, default)


def test_shared_dir_is_the_configured_one():
    assert io.shared_dir(_Session({"spark.checkpoint.dir": "/shared"})) == "/shared"
    with pytest.raises(ValueError):
        io.shared_dir(_Session({}))
