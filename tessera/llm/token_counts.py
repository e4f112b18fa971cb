"""Token counts from pre-token frequencies, without the ids of any document.

1. Runs of documents (blocks) give their distinct pre-tokens, and per-document frequencies by the pre-token's number.
2. The pre-tokens are dealt out by content, so the pieces of each distinct one are counted once, and the counts go back
   to the blocks that asked.
3. Each block multiplies counts into its frequencies and sums by document. A frequent pre-token has one row for each
   block, not one for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied
from tessera.llm.pretokens import WordTokens

LIMIT = 2048
BLOCK_BYTES = 24 << 20
BLOCK_DOCS = 1 << 16
#: Parts that pre-tokens are dealt into by hash; more than a cluster has cores.
DEALS = 4096
_FREQ = "block long, deal int, pieces array<string>, places binary, docs binary, times binary, ends binary, doc_ids array<long>, sizes array<long>"
_NAMES = [c.split()[0] for c in _FREQ.split(", ")]


def _steps(docs: np.ndarray, ends: np.ndarray) -> bytes:
    """Sorted numbers of each part as steps, low bytes before high ones, deflated."""
    step = np.diff(docs, prepend=docs[:1])
    first = ends[:-1][ends[:-1] < ends[1:]]
    step[first] = docs[first]
    return zlib.compress(np.concatenate([(step & 0xFF).astype(np.uint8), (step >> 8).astype(np.uint8)]).tobytes(), 1)


def _unstepped(raw: bytes, ends: np.ndarray) -> np.ndarray:
    both = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.int64)
    step = both[: len(both) // 2] | both[len(both) // 2 :] << 8
    lens = np.diff(ends, prepend=0)
    total = np.cumsum(step)
    begin = ends - lens
    before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0) if len(total) else begin
    return total - np.repeat(before, lens)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _frequencies(path: str):
    """For each block: its pre-tokens with their places, in DEALS parts by hash, and a row of frequencies.

    Frequencies stand in order of pre-tokens: documents (steps within a pre-token), counts (uint8) and where each
    pre-token's part ends (uint32); documents and counts are deflated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        block = TaskContext.get().partitionId() << 24
        numbers, words, ids, sizes, size = _Numbers(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lens = np.fromiter(map(len, words), np.int64, len(words))
            pair = np.concatenate([*words, np.empty(0, np.int64)]).astype(np.int64) << 16 | np.repeat(np.arange(len(words)), lens)
            pair, times = np.unique(pair, return_counts=True)
            while (times > 255).any():  # split what doesn't fit a byte
                big = times > 255
                pair, times = np.concatenate([pair, pair[big]]), np.concatenate([np.where(big, 255, times), times[big] - 255])
                by = np.argsort(pair, kind="stable")
                pair, times = pair[by], times[by]
            ends = np.searchsorted(pair >> 16, np.arange(len(numbers) + 1))
            docs = (pair & 0xFFFF).astype(np.uint16)
            names = list(numbers)
            deal = np.fromiter((xxhash.xxh3_64_intdigest(n) % DEALS for n in names), np.int32, len(names))
            by = np.argsort(deal, kind="stable")
            parts, first = np.unique(deal[by], return_index=True)
            ends_ = np.append(first, len(names)).astype(np.int32)
            n = len(parts)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block)),
                        pa.array(parts, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends_), pa.array([names[i] for i in by], pa.string())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends_ * 4), pa.py_buffer(by.astype(np.uint32))]),
                        *(pa.nulls(n, pa.binary()) for _ in range(3)),
                        *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(2)),
                    ],
                    names=_NAMES,
                )
            body = [_steps(docs, ends), zlib.compress(times.astype(np.uint8).tobytes(), 1), ends[1:].astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.binary()), *(pa.array([x], pa.binary()) for x in body), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, sizes))],
                names=_NAMES,
            )

        for batch in batches:
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = raw.as_py() or ""
                found = tokens.split(text)
                words.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc)
                sizes.append(len(text.encode()))
                size += sizes[-1]
                if size > BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield from flush()
                    block += 1
                    numbers, words, ids, sizes, size = _Numbers(), [], [], [], 0
        if ids:
            yield from flush()

    return run


_COUNTED = "block long, places binary, pieces binary"


def _count_pieces(path: str):
    """For each block, the places of this task's pre-tokens in it and their numbers of pieces (both uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        known: dict[str, int] = {}
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            block, place, n = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.argsort(block, kind="stable")
            block, place, n = block[by], place[by].astype(np.uint32), n[by].astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            cut = [*zip(first, [*first[1:], len(block)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (place, n))], names=["block", "places", "pieces"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch["pieces"].flatten().to_pylist()
            if len(known) > 300_000:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(tokens.ids(p))
            places = np.frombuffer(b"".join(batch["places"].to_pylist()), np.uint32)
            block = np.repeat(batch["block"].to_numpy(), pa.compute.list_value_length(batch["pieces"]).to_numpy(zero_copy_only=False))
            held.append((block, places, np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))))
            size += len(pieces)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _sum(group: pa.Table) -> pa.Table:
    """Counts into the frequencies of one block."""
    body = group.filter(group["docs"].is_valid()).to_pylist()[0]
    ends = np.frombuffer(body["ends"], np.uint32).astype(np.int64)
    pieces = np.zeros(len(ends), np.int64)
    counted = group.filter(group["places"].is_valid())
    for at, n in zip(counted["places"].to_pylist(), counted["pieces"].to_pylist(), strict=True):
        pieces[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
    each = np.repeat(pieces, np.diff(ends, prepend=0)) * np.frombuffer(zlib.decompress(body["times"]), np.uint8)
    sums = np.bincount(_unstepped(body["docs"], ends), weights=each, minlength=len(body["doc_ids"])).astype(np.int64)
    return pa.table({"doc_id": pa.array(body["doc_ids"], pa.int64()), "n_bytes": pa.array(body["sizes"], pa.int64()), "n_tokens": pa.array(sums)})


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. Null text counts as empty; repeated rows and ids stay rows of their own.

    A very long text is a block of its own. Blocks are written before they are used, so their names hold. Other columns are
    not read; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    freq = materialise(docs.mapInArrow(tidied(_frequencies(tokenizer_path)), _FREQ), "frequencies")
    words = freq.where("deal is not null").select("block", "deal", "pieces", "places").repartition("deal")
    counted = words.mapInArrow(tidied(_count_pieces(tokenizer_path)), _COUNTED)
    bodies = freq.where("docs is not null").select("block", "docs", "times", "ends", "doc_ids", "sizes")
    sums = bodies.unionByName(counted, allowMissingColumns=True).groupBy("block").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether there are more than 2048."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
