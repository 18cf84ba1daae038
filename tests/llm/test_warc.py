import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import warc as W

PAGE = "page_id long, url string, html string"


def test_query_equals_sql(spark):
    check_oracle(spark, "op7_warc_revisits", SF_MID)


def test_round_trip_and_edge_cases(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3
    rows = [(1, "http://a", big), (9, "http://b\r\nX: y", big), (5, "c", big), (2, "d", "small"), (3, "e", "small"), (4, None, None), (6, "f", ""),
            (7, "g", "ends\r\n"), (8, "h", "ends\r\n\r\n"), (10, "i", "\r\n\r\n\r\n"), (11, "j", "\n\r\r\n\r\n\r"), (12, "k", "x" * 3_000_000),
            (None, "l", "y" * 2000), (13, "m", "y" * 2000), (9, "http://b\r\nX: y", big)]
    pages = spark.createDataFrame(rows, PAGE).withColumn("digest", F.lit("clash")).withColumn("value", F.lit(1))
    for parts in (1, 4):
        path = str(tmp_path / f"warc{parts}")
        W.write_archives(pages.repartition(parts), path)
        got = W.read_archives(spark, path).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        for i, url, html in rows:
            body = (html or "").encode()
            r = by[i]
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
            want = 9 if html == big and i != 9 else 13 if i is None else None
            assert r.refers_to == want and r.record_type == ("revisit" if want else "response")
            assert r.payload == (None if want else html or "")
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "warc1").glob("part-*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(big.encode()) == 2
    empty = str(tmp_path / "empty")
    W.write_archives(pages.where("false"), empty)
    assert W.read_archives(spark, empty).count() == 0


def test_damage_is_found():
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 23\r\n\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    with pytest.raises(ValueError):
        list(W._parse(bytearray(text), True))
