"""Repairs of prices, URLs and dates."""

import json
import random
import time

from pyspark.sql import functions as F

from pagetables.functions.hosts import punycode
from pagetables.functions.repair import price_message, repair_date, repair_price, repair_url
from pagetables.functions.urls import is_url
from pagetables.functions.variants import pretty_json
from pagetables.operators.quality import seconds_text

PRICES = [
    ("$1,299.99", 1299.99), ("24,99", 24.99), ("1.299,99", 1.299), ("1,2345", 12345.0),
    ("1,23,456", 1.23456), ("-5", 5.0), (",5", 0.5), ("24.", 24.0), ("4.7 out of 5", 4.7),
    ("Price, $5", None), ("n/a", None), ("", None), (None, None), ("1,2.5", 1.2),
]
BASE = "https://h.example/a/b?x=1"
URLS = [
    ("//c.example/i.png", BASE, "https://c.example/i.png"),
    ("http://z.example", BASE, "http://z.example"), ("/p", BASE, "https://h.example/p"),
    ("c", BASE, "https://h.example/a/c"), ("../c", BASE, "https://h.example/c"),
    ("?y=2", BASE, "https://h.example/a/b?y=2"), ("#f", BASE, "https://h.example/a/b?x=1#f"),
    ("mailto:a@b.example", BASE, "mailto:a@b.example"), ("", BASE, None), (None, BASE, None),
    ("/p", None, None), ("/p", "not a url", None), ("http://", BASE, None), ("//", BASE, None),
    ("/a b/é?q=ü#x y", BASE, "https://h.example/a%20b/%C3%A9?q=%C3%BC#x%20y"),
    ("x/../../y/.", BASE, "https://h.example/y/"), ("HTTP://X.com", BASE, "http://x.com/"),
    ("z", "http://H.com:80", "http://h.com/z"), ("../../..", BASE, "https://h.example/"),
    ("z", "http://bücher.de/", "http://xn--bcher-kva.de/z"), ("z", "http://EX%41MPLE.com", "http://example.com/z"),
    ("HTTP://日本語.JP:8080/a", BASE, "http://xn--wgv71a119e.jp:8080/a"), ("z", "http://ＥＸ。com/", "http://ex.com/z"),
    ("z", "http://0x7f.1/", "http://127.0.0.1/z"), ("z", "http://0300.0250.257/", "http://192.168.1.1/z"),
    ("z", "http://4294967295", "http://255.255.255.255/z"), ("z", "http://[::1]:80/", "http://[::1]/z"),
    ("http://1.2.3.256", BASE, None), ("http://1.2.3.4.5/", BASE, None), ("http://08.1/", BASE, None),
    ("http://a%00b/", BASE, None), ("http://a%zz/", BASE, None), ("http://4294967296", BASE, None),
    ("http://1.2.3.4", BASE, "http://1.2.3.4"), ("http://a.b.3c/", BASE, "http://a.b.3c/"), ("z", "http://u@%C3%BC.de", "http://u@xn--tda.de/z"),
]
DATES = [
    ("2026/01/21", "2026-01-21"), ("Jan 21 2026", "2026-01-21"), ("2026-1-5", "2026-01-05"),
    ("January 21, 2026 10:00", "2026-01-21"), ("01/21/2026 10:00", "2026-01-21"),
    ("2026-01-21", "2026-01-21"), ("Jan 21, 2026", "2026-01-21"),
    ("2026-01-21T23:30:00-05:00", "2026-01-22"), ("soon", "soon"), ("", None), (None, None),
    ("21 Jan 2026", "2026-01-21"), ("January 2, 2026", "2026-01-02"),
    ("01/21/2026", "2026-01-21"), ("Wed, 21 Jan 2026 07:28:00 GMT", "2026-01-21"),
    ("Jan 21, 2026 1:30 PM", "2026-01-21"), ("1/21/26", "2026-01-21"), ("1-5-2026", "2026-01-05"),
    ("5-Jan-2026", "2026-01-05"), ("21 january 99", "1999-01-21"), ("Sept 5 2026", "2026-09-05"),
    ("Wed Jan 21 2026 23:30:00 GMT-0500 (Eastern Standard Time)", "2026-01-22"),
    ("Wed Jan 21 2026 00:30:00 GMT+0200", "2026-01-20"), ("Jan 21 2026 00:30 +02:00", "2026-01-20"),
    ("Jan 21 2026 11:30 PM EST", "2026-01-22"), ("Jan 21 2026 12:30 AM", "2026-01-21"),
    ("Jan 21 2026 23:59:59.999Z", "2026-01-21"), ("Jan 21 2026 24:00", "2026-01-22"),
    ("(posted) Jan 21 (Wed) 2026", "2026-01-21"), ("January 2026", "2026-01-01"), ("Jan 21", "2001-01-21"),
    ("2/30/2026", "2026-03-02"), ("Published: Jan 21, 2026", "2026-01-21"), ("around 2026", "2026-01-01"),
    ("Jan 21, 2026 at 10:00", "Jan 21, 2026 at 10:00"), ("21st Jan 2026", "21st Jan 2026"),
    ("13/40/2026", "13/40/2026"), ("Jan 21 2026 25:00", "Jan 21 2026 25:00"), ("1 - 5 - 2026", "1 - 5 - 2026"),
    ("Jan 21 2026 13:00 PM", "Jan 21 2026 13:00 PM"), ("1 2 3 4", "1 2 3 4"), ("v2", "v2"),
    ("12345678901234", "12345678901234"), ("2026/1/5 10:00", "2026-01-05"), ("10:00", "10:00"),
    ("2026", "2026-01-01"), ("2026-05", "2026-05-01"), ("2026-01-21T10:00", "2026-01-21"),
]


def check(df, column):
    rows = df.withColumn("got", column).collect()
    assert [(r["raw"], r["got"]) for r in rows] == [(r["raw"], r["want"]) for r in rows]


def test_prices(spark):
    df = spark.createDataFrame(PRICES, "raw string, want double")
    check(df, repair_price("raw"))
    again = df.where("want IS NOT NULL").select(F.col("want").cast("string").alias("raw"), "want")
    check(again, repair_price("raw"))


def test_price_messages(spark):
    rows = [("$5.50", "Cleaned price: $5.50 → 5.5"), ("5", None), ("n/a", None),
            ("about 12,345,678", "Cleaned price: about 12,345,678 → 12345678")]
    df = spark.createDataFrame(rows, "raw string, want string")
    check(df, price_message(F.col("raw"), repair_price("raw")))


def test_urls(spark):
    df = spark.createDataFrame(URLS, "raw string, base string, want string")
    check(df, repair_url("raw", "base"))
    again = df.where("want IS NOT NULL").select(F.col("want").alias("raw"), "base", "want")
    check(again.where("raw LIKE 'http%'"), repair_url("raw", "base"))


def test_labels_of_other_scripts(spark):
    rng = random.Random(4)
    letters = "abz09-éüßñжяλωיםあ漢語한😀"
    labels = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rows = [(x, x.encode("punycode").decode()) for x in labels if not x.isascii()]
    check(spark.createDataFrame(rows, "raw string, want string"), punycode(F.col("raw")))


def test_url_gate(spark):
    rows = [("https://a.com", True), ("foo", False), ("http://", False), ("mailto:x", True),
            ("http://a b.com", False), ("https://a.com:99/x y", True), ("1http://x", False)]
    check(spark.createDataFrame(rows, "raw string, want boolean"), is_url("raw"))


def test_dates(spark):
    df = spark.createDataFrame(DATES, "raw string, want string")
    check(df, repair_date("raw"))
    check(df.select(F.col("want").alias("raw"), "want"), repair_date("raw"))


def test_pretty_json(spark):
    rows = [('{"b":[1,{"a":"x, {y} \\"q\\""}],"e":{},"f":[ ]}',
             '{\n  "b": [\n    1,\n    {\n      "a": "x, {y} \\"q\\""\n    }\n  ],\n'
             '  "e": {},\n  "f": []\n}')]
    check(spark.createDataFrame(rows, "raw string, want string"), pretty_json("raw"))


def test_pretty_json_is_linear(spark):
    def seconds(n):
        text = json.dumps([{"key": i, "list": [1, 2]} for i in range(n)])
        df = spark.createDataFrame([(text,)], "raw string").select(pretty_json("raw").alias("p"))
        start = time.perf_counter()
        got = df.head().p
        assert got == json.dumps(json.loads(text), indent=2)
        return time.perf_counter() - start
    seconds(100)
    assert seconds(24_000) < 6 * seconds(8_000) + 1


def test_seconds(spark):
    rows = [(0, "0.0s"), (5550, "5.5s"), (250, "0.3s"), (49, "0.0s"), (2122978550, "2122978.5s"),
            (9960, "10.0s")]
    df = spark.createDataFrame(rows, "raw long, want string")
    check(df, seconds_text(F.col("raw")))
