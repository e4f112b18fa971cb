"""Removal of repeated passages whose length is counted in words: the suffix-array operator on words instead of bytes.

Each word becomes five bytes of its hash (digits to base 255, so the separator byte never occurs), and a passage of w words a
string of 5w bytes: what repeats from there on is found as in texts. Whatever its letters, a passage is met by its words;
blanks between them don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, row_key, tidied
from tessera.llm.suffix_dedup import _merged, _with, repeated_spans

#: A passage of 51 words, the outermost of which may be joined to what stands beside them.
LEAST_WORDS = 49
CODE = 5
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


class _Codes(dict):
    def __init__(self, keep: int = 300_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = out = bytes((h := h // 255) % 255 for _ in range(CODE))
        return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = _Codes().__getitem__
    for batch in batches:
        # bytes.split() takes the same six characters as blanks
        texts = [b"".join(map(code, (raw.as_py() or b"").split())) for raw in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(texts, pa.binary())], names=["doc_id", "rid", "text"])


def word_spans(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans of coded bytes as ranges of whole words; a chance match at the edges makes no passage longer."""
    found = [(-(-lo // CODE), hi // CODE) for lo, hi in _merged(spans)]
    return [(a, b) for a, b in found if b - a >= least]


def _strip(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words = [], []
            for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                cut = word_spans([(s["lo"], s["hi"]) for s in spans], least) if spans else []
                words.append(sum(b - a for a, b in cut))
                if not cut:
                    texts.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                places = [m.span() for m in _WORD.finditer(raw)]
                kept, at = [], 0
                for a, b in cut:
                    kept.append(raw[at : places[a][0]])
                    at = places[b - 1][1]
                texts.append(b"".join([*kept, raw[at:]]).decode())
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(texts, pa.string()), pa.array(words, pa.int64())], names=[*names, "kept_text", "words_removed"])

    return run


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns named in keep, kept_text and words_removed: words in a string of at least ``least`` words that repeats.

    Strings are judged on the input. Words are runs of anything but blanks, compared as they are. Rows repeated as a whole count
    as further occurrences. Null texts stay null. A very long text is worked on whole, in one task. An empty table gives no rows.
    """
    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(df, id_col, text_col).alias("rid"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    # written, as the operator goes over it several times; a task then has one Python worker
    docs = materialise(whole.select("doc_id", "rid", F.col("text").cast("binary").alias("text")).mapInArrow(tidied(_coded), "doc_id long, rid long, text binary"), "words")
    size = CODE * least
    joined = _with(whole, repeated_spans(docs, size, (size // 3, size * 4 // 5, size)), "left").drop("rid")
    schema = T.StructType([f for f in joined.schema.fields if f.name not in ("text", "spans")]).add("kept_text", "string").add("words_removed", "long")
    return joined.mapInArrow(tidied(_strip(least)), schema).withColumnsRenamed({f"keep_{c}": c for c in keep})
