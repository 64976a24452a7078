"""WARC archives: one gzip member a record, written from a table and read back in sequence.

The reader inflates member by member in small steps, frames each record by its Content-Length, and verifies block and payload
digests. Equal payloads are stored once: the row of the largest id is a response, others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import durable, shared_dir, small_batches, table, tidy

STEP = 1 << 16
#: Of uncompressed record bytes, after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
EPOCH = "1970-01-01T00:00:00Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str):
    """The pyarrow filesystem of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w[\w+.-]+:/", uri) else (fs.LocalFileSystem(), uri)


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None = None, date: str = EPOCH) -> bytes:
    """One record as a gzip member. A revisit's block has the HTTP head only; size is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1(block)}"}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    fields["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(text.encode()) + made.compress(block) + made.compress(b"\r\n\r\n") + made.flush()


def members(stream):
    """The bytes of each gzip member of a file object, inflated in steps; only one member is held."""
    rest = b""
    while True:
        inflate, out = zlib.decompressobj(31), io.BytesIO()
        if not rest and not (rest := stream.read(STEP)):
            return
        while not inflate.eof:
            out.write(inflate.decompress(rest))
            rest = inflate.unused_data
            if not inflate.eof and not (rest := stream.read(STEP)):
                raise ValueError("archive ends within a gzip member")
        yield out.getvalue()


def records(stream):
    """(headers, HTTP head, payload) of every record in sequence; wrong framing or a wrong digest raises ValueError."""
    for data in members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("record is not as long as its Content-Length says")
        if fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
            raise ValueError("wrong block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{sha1(payload)}":
            raise ValueError("wrong payload digest")
        yield fields, http, payload


def clean_uri(url: str | None, page_id) -> str:
    """A header-safe target: control characters and white space are percent-encoded; no URL gives a URN of the id."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def write(pages: DataFrame, folder: str, least: int = 0, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Writes a record for each row into archives of `folder`; returns (path, records) of the archives, already written.

    Of rows with equal payloads of at least `least` bytes those of the largest page_id are responses and the others revisit it; rows
    with smaller payloads and rows of null page_id are responses. An archive is written under a name of its own attempt, so a task
    that runs again, or twice, leaves files that the returned table doesn't list.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    marks = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(f"page_id is not null and size >= {int(least)}").drop("size")
    last = marks.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("low")).where("first_id > low").drop("low")
    # only repeats need a row here; a page_id that comes twice with the same payload gets one
    revisits = marks.join(last, "digest").where("page_id < first_id").select("page_id", F.unhex("digest").alias("same"), "first_id").distinct()
    # a page_id with several payloads has a row for each: the digest tells them apart
    told = rows.withColumn("same", F.unhex(F.sha1("payload"))).join(revisits, ["page_id", "same"], "left").select("page_id", "url", "payload", "first_id")

    def put(batches):
        import uuid

        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, size, count, path, made = None, 0, 0, None, []
        for b in batches:
            for i, uri, data, ref in zip(*(b.column(k) for k in range(4)), strict=True):
                i, data, ref = i.as_py(), data.as_py(), ref.as_py()
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                kind = "response" if ref is None else "revisit"
                out.write(record(kind, "urn:page:null" if i is None else f"urn:page:{i}", clean_uri(uri.as_py(), i), data, sha1(data), len(data), None if ref is None else f"urn:page:{ref}"))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((path, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{os.path.basename(m[0])}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return durable(told.mapInArrow(tidy(put), "path string, records long"))


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all records of the listed archives (path)."""

    def get(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: None if x is None or x.endswith(":null>") else int(x[1:-1].rpartition(":")[2])
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = filesystem(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=STEP) as stream:
                    for fields, http, payload in records(stream):
                        full = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((number(fields["WARC-Record-ID"]), full, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload if fields["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.mapInArrow(tidy(get), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written to archives in the shared folder and read back from them.

    Null html is an empty payload; null or odd URLs get a header-safe target; repeated rows get a record each: like rows of the
    largest page_id are all responses. A null page_id makes a response that nothing refers to, with a null page_id. Other columns are
    ignored, whatever their names. An empty table writes no archive and gives no rows. A payload is held whole, one at a time.
    """
    return read(write(pages, f"{shared_dir(pages.sparkSession)}/warc", least))


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def _base32_sql(hexadecimal: str) -> str:
    """SQL for the base32 text of a 40-digit hexadecimal column: every five digits are four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr({h}, {at}, 5) AS BIGINT) >> {by}) & 31) + 1 AS BIGINT), 1)"
    return " || ".join(letter.format(h=hexadecimal, at=at, by=by) for at in range(1, 41, 5) for by in (15, 10, 5, 0))


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, payload_bytes, {_base32_sql('h')} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM q
"""
