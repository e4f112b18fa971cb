"""WARC archives as a chunked record table: long records travel as rows (record, chunk number, bytes).

An archive is a folder of Parquet rows whose bytes, in order of record and chunk, are WARC/1.1 files: any store that Spark
reaches will do, and writing is atomic by task. Writing cuts a payload where it lies and carries a running checksum from
chunk to chunk; reading goes through the chunks in order with a running digest. Neither puts a record together.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied

CHUNK = 64 << 10
_LINE = "\r\n"


def assign_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, uri, payload) -> and payload_bytes, sha1, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is the response, the others revisit it.
    Equality is by length, SHA-1 and a 64-bit hash. Rows that repeat the smallest id are responses too; null ids come last.
    """
    marked = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "mark": F.xxhash64("payload")})
    first = marked.where(F.col("payload_bytes") >= least).groupBy("sha1", "mark", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(first, ["sha1", "mark", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "uri", "payload", "payload_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


_CHUNK = "record long, copy long, chunk_no int, chunks int, data binary, running long"
BATCH_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"


def _header(page, uri: str, n_bytes: int, sha1: str, kind: str, refers_to, block: int, date: str) -> bytes:
    name = lambda p: f"<urn:page:{'none' if p is None else p}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return _LINE.join([*lines, f"Content-Length: {block}"]).encode() + _END


def _write(date: str, chunk: int):
    """Chunk rows of each record. A payload is cut where the batch holds it; no record is put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            bodies = batch["body"].cast(pa.large_binary())
            fields = batch.select([n for n in batch.schema.names if n != "body"]).to_pylist()
            for i, f in enumerate(fields):
                body = memoryview(bodies[i].as_buffer()) if bodies[i].is_valid else memoryview(b"")
                chunks = max(1, -(-len(body) // chunk))
                head = _header(f["page_id"], f["uri"], f["payload_bytes"], f["sha1"], f["record_type"], f["refers_to"], len(_HTTP) + len(body), date) + _HTTP
                running = 0
                for k in range(chunks):
                    piece = body[k * chunk : (k + 1) * chunk]
                    running = zlib.crc32(piece, running)
                    data = b"".join([head if k == 0 else b"", piece, _END if k == chunks - 1 else b""])
                    out.append((f["record"], f["copy"], k, chunks, data, running))
                    held += len(data)
                    if held > BATCH_BYTES:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    return run


def to_chunks(records: DataFrame, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Rows (record, copy, chunk_no, chunks, data, running): a header, then the payload in pieces of at most ``chunk`` bytes; joined, a WARC/1.1 record.

    running is the CRC-32 of the payload up to the chunk's end, each carried on from the chunk before, so a reader finds
    the first chunk that is damaged or missing. A revisit carries no payload: its header names the payload's digest and
    length and the record it refers to. record is a hash that tells rows apart; rows repeated as a whole share it and
    differ by copy. Write the result before reading it: copy numbers hold for one run.
    """
    rows = records.select(
        F.xxhash64("page_id", "uri", "sha1").alias("record"),
        F.monotonically_increasing_id().alias("copy"),
        "page_id",
        # control characters would end the line
        F.regexp_replace(F.coalesce("uri", F.lit("")), "[\\x00-\\x20\\x7f]", "").alias("uri"),
        "payload_bytes",
        "sha1",
        "record_type",
        "refers_to",
        F.when(F.col("record_type") == "response", F.col("payload")).alias("body"),
    )
    return rows.mapInArrow(tidied(_write(date, chunk)), _CHUNK)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class _Record:
    """One record while its bytes pass: header until the blank line, then the HTTP header, then payload into the digest."""

    def __init__(self):
        self.head, self.http, self.fields, self.left = bytearray(), None, None, 0
        self.sha, self.n, self.crc = hashlib.sha1(), 0, 0

    def feed(self, data: bytes, running: int | None = None) -> bytes:
        """Takes the next bytes; returns the payload bytes among them. running: the checksum that the payload must have after them."""
        payload = self._payload(data)
        self.sha.update(payload)
        self.crc = zlib.crc32(payload, self.crc)
        self.n += len(payload)
        if running is not None and running != self.crc:
            raise ValueError(f"a chunk is damaged or missing: after {self.n} bytes of payload")
        return payload

    def _payload(self, data: bytes) -> bytes:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return b""
            lines = self.head[:end].decode().split(_LINE)
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.http, self.head = bytes(self.head[end + 4 :]), bytearray(), None
        data = data[: self.left]
        self.left -= len(data)
        if self.http is not None:
            self.http += data
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return b""
            data, self.http = bytes(self.http[end + 4 :]), None
        return data

    def row(self) -> tuple:
        if self.fields is None or self.left:
            raise ValueError("a record ends early")
        f = self.fields
        number = lambda name: int(x) if (x := f[name][len("<urn:page:") : -1]) != "none" else None
        digest = base64.b32encode(self.sha.digest()).decode()
        stated = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "revisit":
            return number("warc-record-id"), int(f["x-payload-length"]), stated, "revisit", number("warc-refers-to")
        if digest != stated or self.n != int(f["x-payload-length"]):
            raise ValueError(f"payload of {f['warc-record-id']} is not what its header says")
        return number("warc-record-id"), self.n, digest, "response", None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunk rows that arrive in order of record, copy and chunk."""
    now, record, out = None, None, []
    for batch in batches:
        for rec, copy, data, running in zip(batch["record"].to_pylist(), batch["copy"].to_pylist(), batch["data"], batch["running"].to_pylist(), strict=True):
            if now != (rec, copy):
                if record is not None:
                    out.append(record.row())
                now, record = (rec, copy), _Record()
            record.feed(data.as_py(), running)
        if len(out) > 5_000:
            yield _rows(out)
            out = []
    if record is not None:
        out.append(record.row())
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _READ.split(", ")])


def read_archive(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (checked against the bytes of responses), record_type, refers_to.

    Records of one chunk are read where they lie; the chunks of longer ones are first brought together, in order.
    """
    short, long = chunks.where("chunks = 1"), chunks.where("chunks > 1")
    ordered = long.repartition("record").sortWithinPartitions("record", "copy", "chunk_no")
    return short.mapInArrow(_parse, _READ).unionByName(ordered.mapInArrow(_parse, _READ))


def archive_pages(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a record for each row, read the archive back.

    Null payloads are empty, null uris too; null ids are written as none and read back as null. Rows repeated as a whole
    are records of their own. A very long payload passes in chunks. Other columns are not read; an empty table gives no rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    return read_archive(materialise(to_chunks(assign_records(pages, least), chunk=chunk), "warc"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as an archive, read back: identical payloads of any length are revisits of the smallest page_id."""
    return archive_pages(table(spark, sf_dir, "pages"))
