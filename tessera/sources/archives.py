"""Archives (SNK-04, SNK-06, SRC-09): zip files written as streams of chunks, each entry with its SHA-256, and read back.

Entries come sorted by archive; each is deflated as it comes and leaves the task as a chunk, so that no archive is held whole.
The chunks of an archive, joined in order, are the file. A manifest, where it is asked for, is the last entry.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
CHUNKS = "archive string, chunk long, data binary"
#: Bytes from which on a chunk leaves its task.
CHUNK = 1 << 20
_CHUNK = pa.schema([("archive", pa.string()), ("chunk", pa.int64()), ("data", pa.binary())])
_ENTRY = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("problem", pa.string())])


class _Stream(io.RawIOBase):
    """Takes what zipfile writes, without a way back; its entries then state their sizes after their data."""

    def __init__(self):
        self.parts: list[bytes] = []

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        if len(data):
            self.parts.append(bytes(data))
        return len(data)

    def drain(self) -> bytes:
        out = b"".join(self.parts)
        self.parts.clear()
        return out


class Chunks:
    """One archive being written: its parts, and what has been written so far as a chunk (a batch of one row)."""

    def __init__(self, name: str):
        self._name, self._number, self._stream = name, 0, _Stream()
        self._zip = zipfile.ZipFile(self._stream, "w")

    def part(self, path: str):
        # one moment for all entries: equal contents give equal archives
        info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_DEFLATED
        return self._zip.open(info, "w")

    def put(self, path: str, content: bytes) -> None:
        with self.part(path) as f:
            f.write(content)

    def size(self) -> int:
        return sum(map(len, self._stream.parts))

    def chunk(self) -> pa.RecordBatch:
        self._number += 1
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((self._name, self._number, self._stream.drain()), _CHUNK.types, strict=True)], schema=_CHUNK)

    def close(self) -> pa.RecordBatch:
        self._zip.close()
        return self.chunk()


def _zipped(manifest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, stream, archive, files = object(), 0, None, None, []

        def put(path: str, content: bytes) -> None:
            # one moment for all entries: equal contents give equal archives
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, content)

        def chunk() -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((now, number, stream.drain()), _CHUNK.types, strict=True)], schema=_CHUNK)

        def close() -> pa.RecordBatch:
            if manifest:
                put(MANIFEST, json.dumps({"archive": now, "files": files}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode())
            archive.close()
            return chunk()

        for batch in batches:
            for name, path, content in zip(batch["archive"].to_pylist(), batch["path"].to_pylist(), batch["content"], strict=True):
                if name != now:
                    if archive is not None:
                        yield close()
                    now, number, stream, files = name, 0, _Stream(), []
                    archive = zipfile.ZipFile(stream, "w")
                raw = content.as_py() or b""
                put(path, raw)
                files.append({"path": path, "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)})
                yield chunk()
        if archive is not None:
            yield close()

    return run


def by_archive(df: DataFrame, *order: str) -> DataFrame:
    """Rows of an archive in one task, in order.

    Dealt by a hash, not by the archive itself: Spark takes a union of tables that are grouped by archive as dealt by it already,
    while adaptive execution joins each one's partitions by its own sizes.
    """
    return df.repartition(F.xxhash64("archive")).sortWithinPartitions("archive", *order)


def zip_entries(df: DataFrame, archive: str, path: str, content: str, manifest: bool = True) -> DataFrame:
    """(archive, chunk, data): zip files of the entries (path, content) of each archive, in order of path.

    Text contents are written in UTF-8, NULL as empty. manifest: an entry of that name lists path, sha256 and bytes of the others.
    """
    rows = df.select(F.col(archive).cast("string").alias("archive"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return by_archive(rows, "path").mapInArrow(_zipped(manifest), CHUNKS)


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parts = object(), []

    def entries() -> pa.RecordBatch:
        rows: list[tuple] = []
        try:
            with zipfile.ZipFile(io.BytesIO(b"".join(parts))) as z:
                names = z.namelist()
                told = {f["path"]: f["sha256"] for f in json.loads(z.read(MANIFEST))["files"]} if MANIFEST in names else {}
                for n in names:
                    if n != MANIFEST:
                        raw = z.read(n)
                        digest = hashlib.sha256(raw).hexdigest()
                        rows.append((now, n, raw, digest, None if told.get(n, digest) == digest else "not as the manifest says"))
                rows += [(now, n, None, None, "missing") for n in told if n not in names]
        except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, KeyError, TypeError) as e:
            rows = [(now, None, None, None, f"not readable: {e}")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _ENTRY.types, strict=True)], schema=_ENTRY)

    for batch in batches:
        for name, data in zip(batch["archive"].to_pylist(), batch["data"], strict=True):
            if name != now and parts:
                yield entries()
                parts = []
            now = name
            parts.append(data.as_py() or b"")
    if parts:
        yield entries()


def read_entries(chunks: DataFrame, archive: str = "archive", chunk: str = "chunk", data: str = "data") -> DataFrame:
    """(archive, path, content, sha256, problem): entries of zip files, checked against their manifest where there is one.

    An archive that can't be read is one row with its problem. One archive is held at a time.
    """
    rows = chunks.select(F.col(archive).cast("string").alias("archive"), F.col(chunk).cast("long").alias("chunk"), F.col(data).alias("data"))
    return by_archive(rows, "chunk").mapInArrow(_unzipped, "archive string, path string, content binary, sha256 string, problem string")


def slices(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """SNK-04: (archive, path, content): of each table the rows of one key as JSON lines in one order, as an entry of the key's bundle."""
    lines = [df.select(F.col(key).cast("string").alias("archive"), F.lit(f"{name}.jsonl").alias("path"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line")) for name, df in sorted(tables.items())]
    content = F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary")
    return reduce(DataFrame.unionByName, lines).groupBy("archive", "path").agg(content.alias("content"))
