import base64
import hashlib
import random

import pytest

from tessera.llm.warc import archive_pages, assign_records, read_archive, to_chunks

SCHEMA = "page_id long, url string, html string, record string, data int"


def rows():
    r = random.Random(1)
    pool = ["<p>%s</p>" % ("é\r\n\r\nx" * r.randrange(0, 200)) for _ in range(40)] + ["", "a", "WARC/1.1\r\n\r\n"]
    out = [(i, r.choice(["http://a/%d" % i, None, "bad\r\nurl"]), r.choice(pool), None, 1) for i in range(300)]
    return out + [(400, "u", None, None, None), (400, "u", None, None, None), (401, "v", "long " * 90_000, "x", 1), (None, "n", "only null id", None, None), (None, "n", pool[0], None, None)]


def expected(data, least):
    first = {}
    for p, _, h, *_ in data:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h, *_ in data:
        raw = (h or "").encode()
        low = first.get(h or "")
        revisit = low is not None and p != low and len(raw) >= least
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk", [(0, 64 << 10), (5, 100), (0, 7)])
def test_round_trip(spark, least, chunk):
    data = rows() if chunk > 7 else [(1, "u", "ab\r\n\r\nc", None, 1), (2, "u", "ab\r\n\r\nc", None, 1)]
    got = archive_pages(spark.createDataFrame(data, SCHEMA).repartition(3), least=least, chunk=chunk).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(data, least)


def test_chunks_join_to_a_warc_file(spark):
    df = spark.createDataFrame([(1, "http://x", b"hello" * 50), (2, "http://y", b"hello" * 50)], "page_id long, uri string, payload binary")
    chunks = to_chunks(assign_records(df), chunk=64).collect()
    assert max(len(c.data) for c in chunks if c.chunk_no) <= 64 + 4
    file = b"".join(c.data for c in sorted(chunks, key=lambda c: (c.record, c.copy, c.chunk_no)))
    types, at = [], 0
    while at < len(file):
        head, _, _ = file[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        end = at + len(head) + 4 + int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and file[end : end + 4] == b"\r\n\r\n"
        types.append(fields[b"WARC-Type"])
        at = end + 4
    assert sorted(types) == [b"response", b"revisit"]


def test_a_payload_of_fifty_megabytes_passes_in_chunks(spark):
    df = spark.range(1).selectExpr("1L page_id", "'u' uri", "CAST(repeat('0123456789', 5000000) AS BINARY) payload")
    chunks = to_chunks(assign_records(df))
    sizes = chunks.selectExpr("length(data) n", "chunks", "chunk_no").agg({"n": "max", "chunks": "max", "chunk_no": "count"}).first().asDict()
    assert sizes["max(n)"] < (64 << 10) + 1000 and sizes["max(chunks)"] == sizes["count(chunk_no)"] == 763
    got = archive_pages(df.selectExpr("page_id", "uri url", "payload html")).first()
    assert (got.payload_bytes, got.payload_digest) == (50_000_000, base64.b32encode(hashlib.sha1(b"0123456789" * 5_000_000).digest()).decode())


def test_a_lost_chunk_is_found(spark):
    df = spark.createDataFrame([(1, "http://x", b"hello" * 50)], "page_id long, uri string, payload binary")
    chunks = to_chunks(assign_records(df), chunk=64).where("chunk_no <> 1")
    with pytest.raises(Exception, match="damaged or missing|ends early"):
        read_archive(chunks).collect()


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []
