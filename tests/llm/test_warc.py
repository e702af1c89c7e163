import gzip
import hashlib
import io
import zlib

from pagetables.llm import warc
from pagetables.llm.common import shared_dir

PAGES = "page_id long, url string, html string, digest string, salt int"


def trip(spark, rows, **how):
    pages = warc.with_revisits(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES))
    archives = warc.write_warc(pages, shared_dir(spark, "warc"), **how)
    return archives, warc.read_warc(archives, 3).collect()


def test_round_trip_and_revisits(spark):
    big = "é" * 50
    rows = [(i, f"http://h.example/{i}", big) for i in range(40, 20, -1)]
    rows += [(1, None, None), (2, "u\n v", ""), (3, "u", "short"), (4, "u", "short"), (5, "u", "z" * 99), (6, "u", "z" * 99),
             (7, "u", "long <p>\r\n\r\nWARC/1.1 " * 100_000), (8, "u", "y" * 100), (8, "u", "y" * 100)]
    archives, got = trip(spark, rows, archive_bytes=2_000)
    assert archives.count() > 1 and not any(r.error for r in got)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if h == html) if len(data) >= 100 else page
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit",
                     None if first == page else first, data if first == page else None))

    def number(urn):
        return urn and int(urn[len("<urn:page:"):-1])
    assert sorted((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to), r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in got) == sorted(want)
    assert {r.target_uri for r in got if r.record_id == "<urn:page:2>"} == {"u%0A%20v"}


def test_each_record_is_a_gzip_member():
    a = warc.record(1, "u", b"a" * 300_000, hashlib.sha256(b"a" * 300_000).hexdigest(), None, "d")
    b = warc.record(2, "u", b"b", hashlib.sha256(b"b").hexdigest(), None, "d")
    assert gzip.decompress(a + b).count(b"WARC/1.1") == 2
    assert [(o, len(c)) for o, c in warc.members(io.BytesIO(a + b))] == [(0, len(zlib.decompress(a, 31))), (len(a), len(zlib.decompress(b, 31)))]
    assert list(warc.members(io.BytesIO(b""))) == []


def test_damage_is_reported():
    def content(**change):
        raw = zlib.decompress(warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d"), 31)
        for old, new in change.values():
            raw = raw.replace(old, new)
        return warc.parse(raw).get("error")
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d")
    assert content() is None
    assert content(x=(b"payload\r\n", b"payloaD\r\n")) == "block digest"
    assert content(x=(b"payload\r\n\r\n", b"pay")) == "content length"
    assert content(x=(b"WARC/1.1", b"nothing")) == "no WARC header"
    assert [c is None for _, c in warc.members(io.BytesIO(good + good[:-9]))] == [False, True]
    assert [c is None for _, c in warc.members(io.BytesIO(good + b"rubbish"))] == [False, True]
    assert warc.parse(None)["error"] == "damaged gzip member"


def test_empty_table_and_null_ids(spark):
    archives, got = trip(spark, [(None, None, "n" * 200), (9, "u", "n" * 200)])
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got) == [
        ("<urn:page:9>", "response", None), ("<urn:page:>", "revisit", "<urn:page:9>")]
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_warc(warc.write_warc(warc.with_revisits(empty), shared_dir(spark, "warc")), 2).count() == 0
