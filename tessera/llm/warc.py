"""WARC archives with revisit resolution.

``write_archives`` shuffles only headers (page id, payload digest, length) by digest, finds the original response of each
payload by partial aggregation, joins the revisits to it, and writes fresh records: a payload of ``min_bytes`` or more is
stored once, its other pages become ``revisit`` records that refer to the original.  The archives are gzipped text files
of Spark's own writer, whose line separator is the end of a record (CRLF CRLF), so they lie on any file system and a
lost task is simply written again.  ``read_archives`` reads them as a byte stream, one task per file, a batch at a time,
and cuts records by their Content-Length; payloads may hold any bytes, record ends included.
"""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty

END = "\r\n\r\n"
MIN_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, digest, origin) for every revisit: pages whose payload of ``min_bytes`` or more is also that of a page with a
    larger id, ``origin`` the largest one.  Null ids are never an origin, unless no page of the payload has an id."""
    body = text_or_empty(html_col)
    headers = pages.select(F.col(id_col).cast("bigint").alias("page"), F.sha1(F.encode(body, "UTF-8")).alias("digest"),
                           F.octet_length(body).alias("size")).where(F.col("size") >= min_bytes).drop("size")
    first = headers.groupBy("digest").agg(F.max("page").alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = headers.join(first, "digest").where(~F.col("page").eqNullSafe(F.col("origin")))
    return met.select("page", "digest", "origin").distinct()


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One column ``value``: the text of one WARC record per row of ``pages``, without the record's end."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("body"),
                        F.sha1(F.encode(body, "UTF-8")).alias("sha"), F.octet_length(body).alias("size"))
    again = resolve_revisits(pages, min_bytes, id_col, html_col)
    rows = rows.join(again, rows["id"].eqNullSafe(again["page"]) & (rows["sha"] == again["digest"]), "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("origin").isNull(), F.concat(http, F.col("body"))).otherwise(http)
    name = lambda c: F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    kind = F.when(F.col("origin").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", name("id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.when(F.col("origin").isNull(), F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("origin")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write the records of ``pages`` to gzipped archives under ``path``, one per task of the last shuffle."""
    records(pages, **options).write.option("lineSep", END).option("compression", "gzip").text(path)


def _field(head: str, name: str) -> str | None:
    m = re.search(rf"^{name}: (.*?)\r?$", head, re.M)
    return m and m[1]


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{PAGE}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _parse(buffer: bytearray, with_payload: bool):
    """Cut the complete records off the front of ``buffer``."""
    at = 0
    while True:
        while buffer[at:at + 2] == b"\r\n":  # what a payload's own line end has shifted
            at += 2
        cut = buffer.find(b"\r\n\r\n", at)
        if cut < 0:
            break
        head = buffer[at:cut].decode()
        if not head.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head[:80]!r}")
        start, size = cut + 4, int(_field(head, "Content-Length"))
        if len(buffer) < start + size + 4:
            break
        block = bytes(buffer[start:start + size])
        at = start + size + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = _field(head, "WARC-Type"), (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
        n_bytes = int(_field(http.decode(), "Content-Length"))
        if kind == "response":
            found = hashlib.sha1(payload).hexdigest()
            if found != digest or n_bytes != len(payload):
                raise ValueError(f"payload of {_field(head, 'WARC-Record-ID')} is damaged")
        yield (_page(_field(head, "WARC-Record-ID")), _field(head, "WARC-Target-URI"), kind, _page(_field(head, "WARC-Refers-To")), n_bytes,
               digest, payload.decode() if with_payload and kind == "response" else None)
    del buffer[:at]


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record; the digest of a
    response is checked against its payload; a revisit has no payload of its own (join refers_to for it)."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        buffer = bytearray()
        for b in batches:
            rows = []
            for piece in b.column(0).cast(pa.binary()):
                buffer += piece.as_buffer()
                buffer += b"\r\n\r\n"
                if len(buffer) >= 1 << 20 or len(rows) < 1:
                    rows += _parse(buffer, with_payload)
            rows += _parse(buffer, with_payload)
            if rows:
                yield _batch(rows, names)
        if bytes(buffer).strip(b"\r\n"):
            raise ValueError("an archive ends inside a record")

    small_batches(spark)
    # gzipped files are never split, so a task reads whole files in order
    return spark.read.option("lineSep", END).text(path).mapInArrow(run, FIELDS)


def _batch(rows, names):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
