import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long, refers_to long"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nHTTP\r\n\r\n"


def pages():
    return [
        (5, "http://a/b c\r\nX: y", "<p>é</p>"),
        (3, None, "<p>é</p>"),
        (3, "http://again", "<p>é</p>"),
        (9, "u", None),
        (8, "u", ""),
        (None, "u", "only this"),
        (None, "u", "<p>é</p>"),
        (10, "u", f"before {INNER}{INNER} after WARC/1.1\r\n"),
        (11, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n\r\n\r\n"),
        (12, "u", "x" * 5000 + INNER * 20 + "y" * 5000),
        (13, "u", f"before {INNER}{INNER} after WARC/1.1\r\n"),
    ]


def expected():
    first = {}
    for i, _, h in pages():
        first.setdefault(h or "", set()).add(i)
    rows = []
    for i, _, h in pages():
        known = [x for x in first[h or ""] if x is not None]
        low = min(known, default=None)
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        rows.append((i, len((h or "").encode()), digest, "response" if i == low else "revisit", None if i == low else low, True))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("split", [None, 2000])
def test_round_trip(spark, tmp_path, split):
    data = spark.createDataFrame([(*p, "d", 1, 2) for p in pages()], SCHEMA).coalesce(1)
    path = str(tmp_path / "archives")
    warc.write_archives(data, path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:  # records then begin, end and run over the edges of splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)
        chain = warc.candidates(spark, path)
        assert chain.filter("start >= 0").count() > len(pages())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == expected()


def test_small_payloads_are_all_responses(spark, tmp_path):
    data = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    warc.write_archives(data, str(tmp_path / "a"), min_bytes=3, records_per_file=1)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_no_pages(spark, tmp_path):
    data = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, data, str(tmp_path / "none")).count() == 0


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.col("t"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
