"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in random groups of documents.

A document is cut into full sequences and one rest. Rests are packed within groups that a seeded hash makes; the groups are
independent, so no task sees more than a bounded share of the documents. The tree holds the largest free room of each
half of the open bins, so the first bin with room is found in a logarithmic number of steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied
from tessera.llm.pretokens import WordTokens

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Ids(dict):
    """Little-endian ids of each pre-token that a task has met; emptied when it has grown large."""

    def __init__(self, tokens: WordTokens, keep: int = 300_000):
        super().__init__()
        self.tokens, self.keep = tokens, keep

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        self[piece] = out = b"".join(i.to_bytes(4, "little") for i in self.tokens.ids(piece))
        return out


def _pieces(path: str, length: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(WordTokens(path))
        split, get, step = ids.tokens.split, ids.__getitem__, 4 * length
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = b"".join([*map(get, split(text.as_py() or "")), end])
                n = len(raw) // 4
                out += [(doc, at // 4, min(length, n - at // 4), zlib.crc32(raw[at : at + step]), n) for at in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item. Items go from long to short, each to the first bin that has room for it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    width = 1
    while width < max(1, len(lengths)):
        width *= 2
    tree = [room] * (2 * width)  # node i: the most room in a bin below it; bins are leaves
    out = [(0, 0)] * len(lengths)
    for i in order:
        need, at = lengths[i], 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        out[i] = (at - width, room - tree[at])
        tree[at] -= need
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return out


def _pack(length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        placed = first_fit_decreasing(pdf["length"].tolist(), length)
        return pdf.drop(columns="group").assign(sequence_id=[(int(key[0]) << 24) + b for b, _ in placed], offset=[o for _, o in placed])

    return run


def pack(df: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, seed: int = 29) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null text is empty: its end id alone is packed.

    Rows repeated as a whole are packed as documents of their own, null ids too. A very long text is cut into full sequences
    and one rest, in one task. Other columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(docs.mapInArrow(tidied(_pieces(tokenizer_path, length, end_id)), _PIECE), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # equal rows would share a group if only their content were hashed: the place in the table takes part
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))), F.lit(groups))
    return pieces.withColumn("group", group).groupBy("group").applyInPandas(_pack(length), f"{_PIECE}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
