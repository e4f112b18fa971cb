"""Token ids of a corpus in files: one concatenated array of ids, and document boundaries in Elias-Fano form.

Documents stand in ascending order of doc_id. The array is cut into shards (ranges of doc_id, in order) and shards into
segments of up to 131,072 ids. A segment is a row of Parquet: the ids as little-endian integers of the vocabulary's width,
the ends of its documents and their doc_ids, both as Elias-Fano bytes. A document longer than a segment is a segment of
several rows (chunks). A second, small table has the number of ids before each shard. So a document's offset is the shard's,
plus the segment's within the shard, plus a select.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied
from tessera.llm.elias_fano import EliasFano
from tessera.llm.packing import _Ids
from tessera.llm.pretokens import WordTokens
from tessera.scratch import scratch_path

END_ID = 2
#: Ids of a segment, and of a chunk of a long document.
SEGMENT_IDS = 1 << 17
#: Row groups of segments are small, as a reader holds one at a time. Left alone, the writer looks at their size after 100 rows only.
LAYOUT = {"compression": "none", "parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 2, "parquet.page.size.row.check.min": 2}
#: Bytes of ids that a shard has on the average, at most.
SHARD_BYTES = 256 << 20
_SIGN = np.uint64(1 << 63)

_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("place", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int32()), ("ids", pa.binary())])
_ENCODED_DDL = "doc_id long, n_tokens long, crc long, place long, piece int, n_ids int, ids binary"
_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_nulls", pa.int32()), ("n_ids", pa.int64()),
    ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary()),
])
_SEGMENT_DDL = "shard int, segment int, chunk int, chunks int, start long, n_docs int, n_nulls int, n_ids long, first_id long, last_id long, width int, doc_ids binary, ends binary, ids binary"
_READ = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_FETCHED = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int64()))])
_READ_DDL = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary"


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ _SIGN


def _encode(path: str, end_id: int, limit: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(WordTokens(path))
        kind = _id_type(max(ids.tokens.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id))
        split, get = ids.tokens.split, ids.__getitem__
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = b"".join([*map(get, split(text.as_py() or "")), end])
                whole = np.frombuffer(raw, "<u4").astype(kind)
                crc, place = zlib.crc32(raw), place + 1
                out += [(doc, len(whole), crc, place, at // limit, len(part := whole[at : at + limit]), part.tobytes()) for at in range(0, len(whole), limit)]
                size += len(raw)
                if size > 16 << 20:
                    yield _batch(out, _ENCODED)
                    out, size = [], 0
            yield _batch(out, _ENCODED)

    return run


def _id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _segments(limit: int):
    """Rows of segments from the sorted documents of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        held = 0

        def close(chunk: int = 0, chunks: int = 1) -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            coded = EliasFano.encode(_ordered(np.array(known, np.int64)))
            ends = EliasFano.encode(np.cumsum(np.array(sizes, np.uint64), dtype=np.uint64))
            body = b"".join(parts)
            row = (shard, segment, chunk, chunks, start, len(docs), len(docs) - len(known), sum(sizes), min(known, default=None), max(known, default=None), len(body) // held, coded.to_bytes(), ends.to_bytes(), body)
            return _batch([row], _SEGMENT)

        for batch in batches:
            for doc, n, piece, n_ids, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "piece", "n_ids")), batch["ids"], strict=True):
                if docs and (n > limit or held + n > limit):
                    yield close()
                    segment, start, docs, sizes, parts, held = segment + 1, start + held, [], [], [], 0
                if n <= limit:
                    docs.append(doc)
                    sizes.append(n)
                    parts.append(ids.as_py())
                    held += n
                    continue
                docs, sizes, parts, held = [doc], [n], [ids.as_py()], n_ids
                chunks = -(-n // limit)
                yield close(piece, chunks)
                docs, sizes, parts, held = [], [], [], 0
                if piece == chunks - 1:
                    segment, start = segment + 1, start + n
        if docs:
            yield close()

    return run


def write_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of all texts, each followed by end_id, to the folder path: tables ``segments`` and ``shards``.

    Segments aren't compressed: a split of the files then is what a reading task holds, and an id's place is one in the file.
    Null text is empty: its end id alone is written. Null ids come first. Rows that share an id stand in order of length, then
    of checksum; rows repeated as a whole are documents of their own. A shard boundary may fall between rows of one id, and
    between the chunks of one document never. Other columns are not read; an empty table gives empty files.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialise(docs.mapInArrow(tidied(_encode(tokenizer_path, end_id, segment_ids)), _ENCODED_DDL), "encoded")
    total = encoded.agg(F.sum(F.col("n_ids").cast("long"))).first()[0] or 0
    shards = max(-(-4 * total // shard_bytes), min(spark.sparkContext.defaultParallelism, -(-total // segment_ids)), 1)
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "crc", "place"]
    ranged = encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order, "piece")
    ranged.mapInArrow(tidied(_segments(segment_ids)), _SEGMENT_DDL).write.options(**LAYOUT).parquet(f"{path}/segments")
    sizes = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments").where("chunk = 0").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    # one small row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/shards")


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a batch may hold many segments."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _crc(ids: bytes, width: int, running: int = 0) -> int:
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes(), running)


def _documents(with_ids: bool):
    """Documents of segment rows; the chunks of a long document come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, seen, held = 0, 0, []
        for batch in batches:
            for row in _each(batch):
                ids, width = row["ids"], row["width"]
                ends = EliasFano.from_bytes(row["ends"]).all().astype(np.int64)
                known = (EliasFano.from_bytes(row["doc_ids"]).all() ^ _SIGN).view(np.int64)
                names = [None] * row["n_nulls"] + known.tolist()
                if row["chunks"] > 1:
                    if row["chunk"] != seen:
                        raise ValueError(f"chunk {seen} of segment {row['segment']} of shard {row['shard']} is missing")
                    running, seen = _crc(ids, width, running), seen + 1
                    held += [ids] if with_ids else []
                    if seen == row["chunks"]:
                        yield _batch([(row["shard"], names[0], row["start"], int(ends[0]), running, b"".join(held) if with_ids else None)], _READ)
                        running, seen, held = 0, 0, []
                    continue
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                cut = [ids[width * a : width * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                columns = [np.full(n, row["shard"]), names, begins + row["start"], ends - begins, [_crc(x, width) for x in cut], cut if with_ids else [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.types, strict=True)], schema=_READ)
        if seen:
            raise ValueError("the last chunks of a document are missing")

    return run


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, its ids as stored.

    Segments of one row are read where they lie; the chunks of longer documents are first brought together, in order.
    """
    rows = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments")
    short, long = rows.where("chunks = 1"), rows.where("chunks > 1")
    ordered = long.repartition("shard", "segment").sortWithinPartitions("shard", "segment", "chunk")
    found = short.mapInArrow(tidied(_documents(with_ids)), _READ_DDL).unionByName(ordered.mapInArrow(tidied(_documents(with_ids)), _READ_DDL))
    shards = spark.read.schema("shard int, n_ids long, n_docs long, first long").parquet(f"{path}/shards").select("shard", "first")
    return found.join(shards, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _one(doc_id: int):
    """The ids of one document from segments that may hold it: two selects, no other boundary is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = doc_id + (1 << 63)
        for batch in batches:
            for row in _each(batch):
                names, ends = EliasFano.from_bytes(row["doc_ids"]), EliasFano.from_bytes(row["ends"])
                low, high = 0, len(names)
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if names[mid] < want else (low, mid)
                while low < len(names) and names[low] == want:
                    i = low + row["n_nulls"]
                    begin, end = (ends[i - 1] if i else 0, ends[i]) if row["chunks"] == 1 else (0, len(row["ids"]) // row["width"])
                    yield _batch([(row["shard"], row["segment"], i, row["chunk"], np.frombuffer(row["ids"], f"<u{row['width']}")[begin:end])], _FETCHED)
                    low += 1

    return run


def fetch(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """Ids of the documents with one doc_id: shard, segment, place, chunk, ids. Other segments are skipped by their first and last id."""
    near = spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return near.mapInArrow(_one(doc_id), "shard int, segment int, place int, chunk int, ids array<long>")


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written, and the boundaries, lengths and checksums that the files give back."""
    import public_tokenizers

    path = scratch_path(spark, "token_files")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
