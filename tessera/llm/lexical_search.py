"""Ranked lexical search as a blocked sparse matrix product: items x terms times terms x documents.

1. The items (queries) are cut into blocks of bounded size. A block's vocabulary numbers the terms; its matrix says which
   terms each item has, and how often.
2. Documents are gone through in blocks. Each gives the postings of the vocabulary's terms, in order of terms (the
   term-document matrix in compressed rows), and is written to the scratch folder. Counts over all documents follow.
3. Postings become int64 impacts. For each item the rows of its terms are merged into one row of scores (Gustavson), and the
   best k of each block of documents are merged into the task's best k.
4. The tasks' best k are reduced per item in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_chunks, materialise, table, tidied

TOP = 50
#: Bytes of item texts in a block, on the average: what is broadcast at a time. One item alone may be longer.
ITEM_BYTES = 2 << 20
#: A block of documents: bytes of text, and rows.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 15
#: Parts that an item's rows are first reduced in.
SALTS = 64

#: Terms are runs of ASCII letters, digits and anything above ASCII; A-Z become small. In UTF-8 that holds byte by byte.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_ITEMS = "block int, item_ids array<long>, ends array<long>, cols array<long>, times array<long>, terms array<binary>"
_POSTINGS = "doc_ids array<long>, sizes array<long>, terms binary, ends binary, docs binary, times binary, with_terms long, all_terms long"
_FOUND = "item int, item_id long, doc_id long, score long, part int"


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _item_blocks(limit: int):
    """Rows of items x terms in compressed rows, each of about limit bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 12
        for batch in batches:
            ids = batch["item_id"].to_pylist()
            for first, raws in byte_chunks(batch["text"], limit):
                numbers: dict[bytes, int] = {}
                ends, cols, times = [], [], []
                for raw in raws:
                    row: dict[int, int] = {}
                    for t in terms(raw):
                        n = numbers.setdefault(t, len(numbers))
                        row[n] = row.get(n, 0) + 1
                    cols += row
                    times += row.values()
                    ends.append(len(cols))
                row = (block, ids[first : first + len(raws)], ends, cols, times, list(numbers))
                kinds = (pa.int32(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _ITEMS.split(", ")])
                block += 1

    return run


def _postings(words):
    """For each block of documents: ids, numbers of terms, and postings of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(words.value)}.get
        ids, sizes, found, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in found])
            pair, times = np.unique(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64) << 32 | doc, return_counts=True)
            held, ends = np.unique(pair >> 32, return_counts=True)
            row = (ids, sizes, held.astype(np.uint32).tobytes(), np.cumsum(ends).astype(np.uint32).tobytes(), (pair & 0xFFFFFFFF).astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes(), sum(n > 0 for n in sizes), sum(sizes))
            kinds = (*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 4, *[pa.int64()] * 2)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _POSTINGS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = text.as_py() or b""
                all_terms = terms(raw)
                ids.append(doc)
                sizes.append(len(all_terms))
                known = [n for n in map(number, all_terms) if n is not None]
                found.append(np.array(known, np.int64))
                size += len(raw)
                if size > BLOCK_BYTES or len(ids) == BLOCK_DOCS:
                    yield flush()
                    ids, sizes, found, size = [], [], [], 0
        if ids:
            yield flush()

    return run


def _document_counts(n_terms: int):
    """Documents of this task that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for held, ends in zip(batch["terms"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                df[np.frombuffer(held, np.uint32)] += np.diff(np.frombuffer(ends, np.uint32).astype(np.int64), prepend=0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _impacts(block: dict, weights: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's postings in order of terms: terms, ends, documents, impacts."""
    held, ends = np.frombuffer(block["terms"], np.uint32), np.frombuffer(block["ends"], np.uint32).astype(np.int64)
    docs, tf = np.frombuffer(block["docs"], np.uint16), np.frombuffer(block["times"], np.uint32).astype(np.int64)
    m = np.array([50 + 50 * size * n // max(total, 1) for size in block["sizes"]], np.int64)
    w = np.repeat(weights[held], np.diff(ends, prepend=0))
    return held, ends, docs, w * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))


class _Best:
    """The best k of an item: high scores first, then small ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(c) for c in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        by = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[by], ids[by], nulls[by]

    @property
    def least(self) -> int:
        """A score below this one can't be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


def _product(shared, k: int, multiplicity: bool):
    """Best k documents of this task's blocks for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n, total = shared.value
        ends = [0, *items["ends"]]
        cols, times = np.array(items["cols"], np.int64), np.array(items["times"], np.int64)
        rows = [(cols[a:b], times[a:b]) for a, b in zip(ends, ends[1:])]
        best = [_Best(k) for _ in rows]
        for batch in batches:
            for block in batch.to_pylist():
                held, stop, docs, impacts = _impacts(block, weights, n, total)
                first = np.zeros(len(weights) + 1, np.int64)
                first[held + 1] = np.diff(stop, prepend=0)
                first = np.cumsum(first)
                ids = np.array([0 if d is None else d for d in block["doc_ids"]], np.int64)
                nulls = np.array([d is None for d in block["doc_ids"]], bool)
                for mine, (terms_, times_) in zip(best, rows, strict=True):
                    scores = np.zeros(len(ids), np.int64)
                    begin, end = first[terms_], first[terms_ + 1]
                    some = np.flatnonzero(end > begin)
                    for a, b, t in zip(begin[some].tolist(), end[some].tolist(), times_[some].tolist(), strict=True):
                        # a document stands once in a term's row
                        scores[docs[a:b]] += impacts[a:b] * t if multiplicity else impacts[a:b]
                    at = np.flatnonzero(scores >= mine.least)
                    if len(at) > k:  # all that reach the k-th score, ties too
                        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
                        at = at[scores[at] >= kth]
                    if len(at):
                        mine.add(scores[at], ids[at], nulls[at])
        part = TaskContext.get().partitionId() % SALTS
        for i, mine in enumerate(best):
            if len(mine.ids):
                size = len(mine.ids)
                item_id = pa.array([items["item_ids"][i]] * size, pa.int64())
                columns = [pa.array([items["block"] << 20 | i] * size, pa.int32()), item_id, pa.array(mine.ids, mask=mine.nulls), pa.array(mine.scores), pa.array([part] * size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def search(df: DataFrame, items: DataFrame, k: int = TOP, multiplicity: bool = False, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per item the k documents of highest score above 0: item_id, rank (from 1), doc_id, score.

    N and L are counted over all documents; a term weighs floor(1000 ln((2N + 2) / (2df + 1))). multiplicity: a term counts as
    often as the item has it, else once. Equal scores stand by ascending id, null ids last. Null and empty texts have no terms,
    and items without any have no rows. Each item row is an item of its own, and each document row a document, also where they
    are repeated. Other columns are not read; empty tables give no rows. Documents are read once for each block of items.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    blocks = materialise(asked.repartition(parts).mapInArrow(_item_blocks(2 * item_bytes), _ITEMS), "items")
    out = None
    for block, row in enumerate(blocks.toLocalIterator()):
        matrix = row.asDict() | {"block": block}
        words = spark.sparkContext.broadcast([bytes(t) for t in matrix.pop("terms")])
        n_terms = len(words.value)
        postings = materialise(docs.mapInArrow(tidied(_postings(words)), _POSTINGS), "postings")
        n, total = (x or 0 for x in postings.agg(F.sum("with_terms"), F.sum("all_terms")).first())
        weights = np.zeros(n_terms, np.int64)
        # a row for each term of the block at most
        for r in postings.select("terms", "ends").mapInArrow(_document_counts(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            weights[r.term] = weight(n, r.df)
        shared = spark.sparkContext.broadcast((matrix, weights, n, total))
        found = postings.drop("with_terms", "all_terms").mapInArrow(tidied(_product(shared, k, multiplicity)), _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], _FOUND)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = out.withColumn("n", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("n") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
