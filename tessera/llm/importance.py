"""Quality by importance resampling: hashed n-gram generative models for target and raw text, sampled by Gumbel top-k.

Words and word pairs are hashed to ``BUCKETS``. The raw model counts all documents, the target model a bounded sample of
clean labelled text (quality 1, toxic 0). The log weight of a document is the log ratio of both models over its words and
pairs; as those of one text depend on each other, a text of n of them counts as ``LOOKS * sqrt(n)``, from ``FULL`` on as
one of FULL. Documents are drawn without replacement in proportion to their weights: those with the k largest log weights
plus Gumbel noise. k is the number of documents whose log weight is not below what nearly all held-out clean rows reach.

Toxic text is told apart on its own and is never drawn: markers, words and beginnings by their whole hash, are what enough
more toxic than clean rows of the sample hold, each as strong as the log ratio of its occurrences in both. The strongest
occurrences in each window of words are summed; the worst window counts, and the mean of all. Neither depends on a text's
length: the cut-off of the worst window rises with the number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied

BITS = 18
BUCKETS = 1 << BITS
LABELLED = 20_000
BEGINNING = 5
STRONGEST = 4
WINDOW = 128  # words
FULL, LOOKS = 1024, 8  # words and pairs
SUPPORT, SURE = 5, 4.0  # toxic rows that hold a marker; standard deviations above what clean rows lead to expect
PSEUDO_RAW, PSEUDO_TOXIC = 5.0, 2.0
LOSS = 0.005  # share of held-out clean rows that each cut-off may turn down
TEMPERATURE = 1.0
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of words, with the hashes of each and of its beginning; emptied between texts when it has grown large."""

    def __init__(self):
        super().__init__()
        self.hashes = np.empty((1 << 12, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word[:BEGINNING].lower(), seed=7)
        self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.__init__()
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at]


def ngrams(raw: bytes, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of words and pairs with repeats, hashes of the words, hashes of their beginnings)."""
    words = raw.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h, start = known.of(words).T
    own = h * _M1
    pairs = (own[:-1] + h[1:] * _M2) * _M1
    return (np.concatenate([own, pairs]) >> _U(64 - BITS)).astype(np.int64), h, start


_COUNTS = "bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task by bucket."""
    known = _Words()
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        held, size = [], 0
        for text in batch["text"].cast(pa.large_binary()):
            held.append(ngrams(text.as_py() or b"", known)[0])
            size += len(held[-1])
            if size > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """Counts of all texts by bucket; BUCKETS rows at most reach the driver."""
    found = texts.select("text").mapInArrow(tidied(_count), _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def log_ratios(clean: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket: log of its probability in the target model over that in the raw one, both smoothed by the raw one."""
    return np.log((clean + PSEUDO_RAW) / (raw * (clean.sum() / max(1.0, raw.sum())) + PSEUDO_RAW))


_HELD_BY = "gram long, clean_docs long, toxic_docs long, clean_n long, toxic_n long"


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many clean (kind 1) and toxic (kind 2) rows hold each word and each beginning, by hash, and how often they occur."""
    known = _Words()

    def summed(grams: list[tuple], kinds: list[int]) -> pa.RecordBatch:
        found, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
        n = np.concatenate([n for _, n in grams])
        toxic = np.repeat(np.array(kinds) == 2, [len(g) for g, _ in grams])
        counts = (np.bincount(at[of], weights=None if w is None else w[of], minlength=len(found)).astype(np.int64) for w in (None, n) for of in (~toxic, toxic))
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, counts)], names=[c.split()[0] for c in _HELD_BY.split(", ")])

    grams, kinds, size = [], [], 0
    for batch in batches:
        for text, kind in zip(batch["text"].cast(pa.large_binary()), batch["kind"].to_pylist(), strict=True):
            grams.append(np.unique(np.concatenate(ngrams(text.as_py() or b"", known)[1:]), return_counts=True))
            kinds.append(kind)
            size += len(grams[-1][0])
            if size > 1 << 20:
                yield summed(grams, kinds)
                grams, kinds, size = [], [], 0
    if grams:
        yield summed(grams, kinds)


@dataclass
class Model:
    """Log ratios by bucket (fixed size), markers (sorted hashes) with their log ratios, and the cut-offs."""

    ratios: np.ndarray
    markers: np.ndarray
    toxicity: np.ndarray
    low: float = 0.0  # of the log weight
    high: float = 0.0  # of the worst window; and how far clean ones go beyond it
    tail: float = 0.0

    def __post_init__(self):
        self.maybe = np.zeros(BUCKETS, bool)  # most words are no marker and need no search
        self.maybe[(self.markers >> _U(64 - BITS)).astype(np.int64)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of markers, and which."""
        at = np.flatnonzero(self.maybe[(h >> _U(64 - BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.markers, h[at]), len(self.markers) - 1)
        same = self.markers[which] == h[at]
        return at[same], which[same]

    def against(self, words: np.ndarray, beginnings: np.ndarray) -> tuple[float, float]:
        """The strongest occurrences of the worst window, and of all on average; for the worst, windows overlap by half."""
        (a, x), (b, y) = self.found(words), self.found(beginnings)
        place, strength = np.concatenate([a, b]), self.toxicity[np.concatenate([x, y])]
        if not len(place):
            return 0.0, 0.0
        sums = []
        for ahead in (0, WINDOW // 2):
            window = (place + ahead) // WINDOW
            by = np.lexsort((-strength, window))
            first = np.flatnonzero(np.diff(window[by], prepend=-1))
            rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
            sums.append(np.add.reduceat(np.where(rank < STRONGEST, strength[by], 0.0), first))
        return float(max(s.max() for s in sums)), float(sums[0].sum()) / -(-len(words) // WINDOW)

    def log_weight(self, grams: np.ndarray) -> float:
        n = min(len(grams), FULL)
        return float(self.ratios[grams].mean() * min(n, LOOKS * np.sqrt(n))) if n else 0.0

    def parts(self, grams: np.ndarray, words: np.ndarray, beginnings: np.ndarray) -> tuple[float, float, float, int]:
        """Log weight, the worst and the mean window, and the number of windows."""
        if not len(grams):
            return 0.0, 0.0, 0.0, 1
        return self.log_weight(grams), *self.against(words, beginnings), -(-len(words) // WINDOW)


_PARTS = "log_weight double, against double, usual double, windows long"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            parts = [model.parts(*ngrams(t.as_py() or b"", known)) for t in batch["text"].cast(pa.large_binary())]
            cols = (pa.array([p[k] for p in parts], kind) for k, kind in enumerate((*(pa.float64(),) * 3, pa.int64())))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), *cols], names=[*rest, *(c.split()[0] for c in _PARTS.split(", "))])

    return run


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, by hash: (doc_id, kind): 1 clean, 2 toxic, 0 neither; 3 more for the held-out fifth.

    Rows with a null id, quality or toxic are left out; an id with several rows takes its worst label.
    """
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    held = F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0, 3).otherwise(0)
    return usable.select("doc_id", (kind + held).alias("kind")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(limit)


def fit(rows: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Models from (doc_id, rid, text) and labels; the sample of at most ``limit`` ids is broadcast, raw counts cover all rows."""
    known = materialise(labelled_sample(labels, limit), "labelled")
    shown = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # one text for each id of the sample, however many rows have it
    of_sample = rows.join(F.broadcast(known.where("kind in (1, 2, 4)")), "doc_id")
    texts = materialise(of_sample.groupBy("doc_id", "kind").agg(F.min(F.struct("rid", "text")).alias("first")).select("kind", "first.text"), "labelled-texts")
    ratios = log_ratios(counts(texts.where("kind = 1")), counts(rows))
    held_by = texts.where("kind < 3").mapInArrow(tidied(_held_by), _HELD_BY).groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("clean_docs", "toxic_docs", "clean_n", "toxic_n")))
    held_by = materialise(held_by, "held-by")
    total = held_by.agg(F.sum("clean_n").alias("clean"), F.sum("toxic_n").alias("toxic")).first()
    expected = F.col("clean_docs") * F.lit(shown.get(2, 0) / max(1, shown.get(1, 0)))
    expected_n = F.col("clean_n") * F.lit(float((total.toxic or 0) / max(1, total.clean or 0)))
    # a text holds as many grams as it has words, so rows of SUPPORT and more are few beside the sample's texts
    solid = held_by.where((F.col("toxic_docs") >= SUPPORT) & (F.col("toxic_docs") - expected >= SURE * F.sqrt(expected + 1))).select("gram", F.log((F.col("toxic_n") + PSEUDO_TOXIC) / (expected_n + PSEUDO_TOXIC)).alias("ratio")).toArrow()
    markers, strength = solid["gram"].to_numpy().view(_U), solid["ratio"].to_numpy()
    by = np.argsort(markers)
    model = Model(ratios, markers[by], strength[by])
    held = texts.where("kind = 4").select("text").mapInArrow(tidied(_score(model)), _PARTS).toPandas()  # at most ``limit`` rows
    if len(held):
        model.low, model.high = float(held["log_weight"].quantile(LOSS)), float(held["against"].quantile(1 - LOSS))
        model.tail = float((held["against"] - model.high).clip(lower=0).sum() / max(1, (held["against"] > model.high).sum()))
    # one marker is a word and its beginning: clean texts hold it by chance if they are long enough
    model.high = max(model.high, float(strength.max(initial=1.0)))
    return model


def gumbel(*key: Column) -> Column:
    """Gumbel noise from a hash of the row: reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(scored: DataFrame, key: str, k: int, bins: int = 1024, few: int = 1000) -> float:
    """The k-th largest key, minus infinity if there are no more than k: found by counting in ever finer bins, never by a sort."""
    lo, hi, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    inside, above = scored.select(key), 0
    while lo < hi and n > few:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).cast("int")
        found = {r.bin: r for r in inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b].n >= k:
                break
            above += found[b].n
        if len(found) == 1:
            break  # keys as close as numbers can be
        lo, hi, n = found[b].lo, found[b].hi, found[b].n
        inside = scored.select(key).where(F.col(key).between(F.lit(lo), F.lit(hi)))
    if lo == hi:
        return lo
    return sorted((r[0] for r in inside.collect()), reverse=True)[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED, temperature: float = TEMPERATURE, k: int | None = None, seed: int = 23) -> DataFrame:
    """Per row: id, rid, log_weight, toxicity (how far beyond what clean text reaches; above 0 a row is never drawn), kept.

    seed, temperature: of the draw; by default its noise is small beside the spread of weights, so that rows far from the k-th
    weight have a sure fate. k: how many rows to draw; by default as many as are not toxic and reach the level of held-out clean rows. Rows that tie
    with the last one drawn are drawn too: those are rows equal as a whole, which share rid, noise and fate. Texts without
    words (null, empty) have a log weight of 0. Null ids have no label. Without labelled rows every text has log weight 0. A
    very long text is scored whole, in one task. Other columns are not read; an empty table gives no rows.
    """
    rows = df_rows(docs, id_col, text_col)
    model = fit(rows, labels, limit)
    scored = rows.mapInArrow(tidied(_score(model)), f"doc_id long, rid long, {_PARTS}")
    spare = F.least(model.high + model.tail * F.log(F.col("windows").cast("double")) - F.col("against"), model.high - F.col("usual"))
    noisy = F.col("log_weight") + temperature * gumbel("doc_id", "rid", F.lit(seed))
    scored = materialise(scored.select("doc_id", "rid", "log_weight", (-spare).alias("toxicity"), F.when(spare >= 0, noisy).alias("key")), "scored")
    if k is None:
        k = scored.where(F.col("key").isNotNull() & (F.col("log_weight") >= F.lit(model.low))).count()
    least = kth_largest(scored.where("key is not null"), "key", k)
    return scored.select("doc_id", "rid", "log_weight", "toxicity", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)).alias("kept"))


def df_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))


def op5_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, log_weight and toxicity (rounded to 6 digits) and kept, for every document."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("toxicity", 6).alias("toxicity"), "kept")
