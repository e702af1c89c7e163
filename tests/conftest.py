import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clean(spark):
    """Clean many inline pages in one job: {name: html} -> {name: row}."""
    from pagetables.operators.elements import clean_pages, element_counts, stats_columns

    def run(cases):
        names = list(cases)
        rows = [(n, f"https://h.example/{n}", cases[name]) for n, name in enumerate(names)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        result = clean_pages(pages).select(
            "*", *[c.alias(n) for n, c in stats_columns() if n != "original_length"]
        )
        return {names[r.page_id]: r.asDict(recursive=True) for r in result.collect()}

    return run
