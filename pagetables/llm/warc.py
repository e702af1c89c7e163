"""WARC archives: one gzip member per record, written and read back record by record.

Files are reached with pyarrow.fs, which takes plain paths and the URIs it knows (file, hdfs,
s3, gs); the folder must be one that all executors share.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import cut, only

SALTS = 32
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("file string, offset long, record_type string, record_id string, refers_to string, target_uri string, "
          "payload_digest string, payload_bytes long, payload binary, error string")


def with_revisits(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to of each row.

    Of rows with equal payloads of min_bytes or more, those with another id than the smallest
    refer to the smallest. Equal payloads are counted before they are shuffled, and
    each group's row is joined to SALTS parts of the pages, so a payload that a third of all
    pages have is spread over that many tasks.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = only(pages, [id_col, url_col, html_col]).select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(groups, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes rows of with_revisits into folder; returns file, records and bytes of each archive.

    A task writes archives of its own under new names and closes one once it holds
    archive_bytes. Only the archives of tasks that ended well are in the result, which is
    checkpointed: a task that is run again leaves files that nothing refers to. Null urls
    leave out the target; control characters in a url are percent-encoded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        out, name, records = None, "", 0
        done: list[tuple[str, int, int]] = []
        try:
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"{base.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.gz"
                        out, records = system.open_output_stream(name, compression=None), 0
                    out.write(record(page_id, url, payload, digest, refers_to, date))
                    records += 1
                    if out.tell() >= archive_bytes:
                        done.append((name, records, out.tell()))
                        out.close()
                        out = None
            if out is not None:
                done.append((name, records, out.tell()))
        finally:
            if out is not None:
                out.close()
        prefix = folder.rstrip("/")
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{prefix}/{n.rsplit('/', 1)[1]}" for n, _, _ in done], pa.string()),
             pa.array([r for _, r, _ in done], pa.int64()), pa.array([b for _, _, b in done], pa.int64())],
            names=["file", "records", "bytes"])

    return cut(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, records long, bytes long"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member: header, HTTP header, and the payload unless it is a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def members(stream: pa.NativeFile) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of each gzip member; content is None for one that is damaged or cut off,
    where reading ends."""
    start, at, left = 0, 0, b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or stream.read(READ_BYTES)
            if not left:
                if at > start:
                    yield start, None
                return
            try:
                parts.append(unpack.decompress(left))
            except zlib.error:
                yield start, None
                return
            at += len(left) - len(unpack.unused_data)
            left = unpack.unused_data
        yield start, b"".join(parts)
        start = at


def parse(content: bytes | None) -> dict[str, object]:
    """Fields of one record. error names the first thing that is not as its header says."""
    if content is None:
        return {"error": "damaged gzip member"}
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out: dict[str, object] = {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None}
    length = fields.get("content-length", "")
    if not lines[0].startswith("WARC/") or not length.isdigit():
        return out | {"error": "no WARC header"}
    block, tail = rest[:int(length)], rest[int(length):]
    if len(block) < int(length) or tail != b"\r\n\r\n":
        return out | {"error": "content length"}
    if fields.get("warc-block-digest", f"sha256:{hashlib.sha256(block).hexdigest()}") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return out | {"error": "block digest"}
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    out["payload_bytes"] = int(said[1]) if said else len(payload)
    if out["record_type"] != "revisit":
        out["payload"] = payload
        if out["payload_bytes"] != len(payload):
            return out | {"error": "payload length"}
        if out["payload_digest"] not in (None, hashlib.sha256(payload).hexdigest()):
            return out | {"error": "payload digest"}
    return out


def read_warc(archives: DataFrame, tasks: int, payloads: bool = True) -> DataFrame:
    """Rows of RECORD from the archives that column `file` of the table names.

    Each file is read from its start to its end, one record in memory at a time. A record that
    fails its digest, length or gzip check comes with its error; after a damaged
    gzip member the rest of that file cannot be framed and is not read. A revisit has no
    payload; its length and digest are those of the payload it stands for.
    """
    shape = [x.split(" ") for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in shape])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
                with system.open_input_stream(path, compression=None, buffer_size=0) as stream:
                    rows, held = [], 0
                    for offset, content in members(stream):
                        row = {"file": name, "offset": offset} | parse(content)
                        if not payloads:
                            row.pop("payload", None)
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("file").repartition(tasks).mapInArrow(run, RECORD)
