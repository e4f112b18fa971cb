"""Near-duplicate classes by one-permutation MinHash, banded buckets, star-shaped candidates and exact confirmation.

1. Each text becomes a set of 64-bit hashes of its five-word shingles. One permutation hashing keeps the smallest hash of
   each of ``BINS`` ranges; empty ranges copy another range's value, chosen by hashing (range, attempt) until a full one
   is met (optimal densification). Equal word sequences, told by 128 bits, are one class from here on.
2. ``BANDS`` groups of ``ROWS`` values are bucket keys: a pair of similarity 0.75 misses every bucket with probability
   (1 - 0.75**3)**21 = 1e-5. Buckets of one class are dropped; buckets with many classes are dealt out by a salt.
3. In a bucket the class that is closest to the others by 128-bit sketches leads, those close to it are its star, and the
   rest goes on in the same way: candidate pairs form stars, so there are fewer of them than classes. Leaders of a
   dealt-out bucket meet again among themselves, dealt out anew while they are many.
4. Candidates are confirmed on the full shingle sets; confirmed pairs give components.
5. Buckets that still hold several components are gone through once more: first by signatures alone, for the classes that
   are close to one of another component, then with the full sets of those classes at hand. All their pairs across
   components are compared, each in its first common bucket, so a star whose middle is too far from one member loses
   nothing. Only links leave the task, and those between components that it has joined already are left out, so what is
   written stays below the number of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialise, row_key, table, tidied

WORDS = 5
BINS = 128
ROWS = 3
BANDS = 21
HOT_BUCKET = 4096
HOT_STAR = 2048
#: How often the leaders of dealt-out buckets meet again at most; what is open then is left to the last pass.
LEADER_TURNS = 4
#: Rows of a block in the last pass, where rows carry their sets.
BLOCK = 1024
#: A pair counts as close when its estimate is at most so many standard deviations below the similarity asked for.
DEVIATIONS = 4.5
SAMPLE = 32
_U = np.uint64


class _WordHashes(dict):
    """Hash of each word, kept for the next time; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(raw: bytes, words_of: _WordHashes, n: int = WORDS) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct hashes of the n-word shingles, and the words; a shorter text is one shingle, an empty one none."""
    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64), words
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return _mixed(np.array([(h * _PLACES[: len(h)]).sum() + _U(len(h))], np.uint64)), words
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += h[j : j + m] * _PLACES[j]
    return np.unique(_mixed(total)), words


_ATTEMPTS = [np.array([xxhash.xxh3_64_intdigest(b"%d/%d" % (a, i)) % BINS for i in range(BINS)]) for a in range(64)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of BINS equal ranges; ranges without one are densified."""
    where = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << _U(57))
    ends = np.append(where[1:], len(hashes))
    full = where < ends
    sig = hashes[np.minimum(where, len(hashes) - 1)]
    open_ = np.flatnonzero(~full)
    attempt = 0
    while len(open_):
        if attempt == len(_ATTEMPTS):  # nearly all ranges empty: take the next full one clockwise
            seats = np.flatnonzero(full)
            sig[open_] = sig[seats[np.searchsorted(seats, open_) % len(seats)]]
            break
        to = _ATTEMPTS[attempt][open_]
        ok = full[to]
        sig[open_[ok]] = sig[to[ok]]
        open_ = open_[~ok]
        attempt += 1
    return sig


_MULT = _mixed(np.arange(1, BINS + 1, dtype=np.uint64))


def bands(sig: np.ndarray) -> np.ndarray:
    picked = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        keys = _mixed(keys + picked[:, j] * _PLACES[j])
    return keys.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    bits = np.packbits((_mixed(sig ^ _MULT) >> _U(63)).astype(np.uint8))
    return bits.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = _WordHashes()
    for batch in batches:
        node, mark, count, keys, low, high, values = [], [], [], [], [], [], []
        for text in batch["text"].cast(pa.large_binary()):
            hashes, words = shingles(text.as_py() or b"", words_of)
            count.append(len(hashes))
            if len(hashes):
                sig = signature(hashes)
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                node.append((whole >> 64) - (1 << 63))
                mark.append((whole & ((1 << 64) - 1)) - (1 << 63))
                keys.append(bands(sig))
                a, b = sketch(sig).tolist()
                values.append((sig & _U(0xFF)).astype(np.uint8).tobytes())
            else:
                node.append(None)
                mark.append(None)
                keys.append(None)
                values.append(None)
                a = b = 0
            low.append(a)
            high.append(b)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["rid"], pa.array(node, pa.int64()), pa.array(mark, pa.int64()), pa.array(count, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(values, pa.binary())],
            names=["doc_id", "rid", "node", "mark", "n_shingles", "bands", "low", "high", "sig"],
        )


def least_agreement(similarity: float, estimate_noise: float) -> np.ndarray:
    """By the smaller set's size (up to BINS): the share of agreeing values that a pair of this similarity reaches."""
    n = np.arange(BINS + 1)
    spread = np.sqrt(similarity * (1 - similarity) / np.maximum(n, 1) + estimate_noise**2)
    return np.maximum(0, similarity - DEVIATIONS * spread)


def _agree(low: np.ndarray, high: np.ndarray, a: int, b: int) -> np.ndarray:
    differ = np.bitwise_count((low ^ a).view(np.uint64)).astype(np.int16)  # of signed numbers it would count the absolute value
    return 128 - differ - np.bitwise_count((high ^ b).view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Runs of equal keys in rows that arrive sorted by them, as columns."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        cols = {n: batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for k in keys:
            cut[1:] |= cols[k][1:] != cols[k][:-1]
        if held and any(held[-1][k][-1] != cols[k][0] for k in keys):
            yield _joined(held)
            held = []
        at = 0
        for stop in [*np.flatnonzero(cut).tolist(), None]:
            piece = {n: c[at:stop] for n, c in cols.items()}
            held.append(piece)
            if stop is None:
                break
            yield _joined(held)
            held, at = [], stop
    if held:
        yield _joined(held)


def _joined(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return held[0] if len(held) == 1 else {n: np.concatenate([x[n] for x in held]) for n in held[0]}


_STAR = "key long, a long, b long, low long, high long, grams long"


def _stars(similarity: float):
    """Star edges (a: leader, b) of each run, and its leaders with their sketches (b null)."""
    # a bit agrees with probability (1 + similarity) / 2; the noise of 128 bits is that of their mean
    close = 64 + 64 * least_agreement(similarity, np.sqrt((1 - similarity**2) / BINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for x in _runs(batches, ["key", "salt"]):
            left = np.argsort(x["node"], kind="stable")
            key = int(x["key"][0])
            nodes, low, high, grams = x["node"], x["low"], x["high"], np.minimum(x["grams"], BINS)
            while len(left):
                lead = left[0]
                if len(left) > 2:
                    some = left[:: -(-len(left) // SAMPLE)]
                    lead = left[np.argmax(sum(_agree(low[left], high[left], low[i], high[i]).astype(np.int64) for i in some))]
                rest = left[left != lead]
                out.append((key, int(nodes[lead]), None, int(low[lead]), int(high[lead]), int(grams[lead])))
                near = _agree(low[rest], high[rest], low[lead], high[lead]) >= close[np.minimum(grams[rest], grams[lead])]
                out += [(key, int(nodes[lead]), int(v), 0, 0, 0) for v in nodes[rest[near]] if v != nodes[lead]]
                left = rest[~near]
            if len(out) > 20_000:
                yield _batch(out, _STAR)
                out = []
        if out:
            yield _batch(out, _STAR)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the similarity (numerator, denominator)."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    numerator, denominator = similarity
    if denominator * len(small) < numerator * len(large):
        return False
    found = np.searchsorted(large, small)
    both = int((large[np.minimum(found, len(large) - 1)] == small).sum())
    return denominator * both >= numerator * (len(a) + len(b) - both)


def _close_pairs(x: dict[str, np.ndarray], share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, those after i whose signatures are close to its own, the components), for one run of _across's rows.

    The components may be changed while the pairs are gone through. A pair that meets in several buckets is seen in the
    first of its common bands only; in a tile of two blocks only pairs of both.
    """
    close = 64 + 64 * least_agreement(share, np.sqrt((1 - share**2) / BINS))
    closer = BINS * least_agreement(share, 0)
    low, high, block, comp = x["low"], x["high"], x["block"], x["component"].copy()
    key, grams = x["key"][0], np.minimum(x["grams"], BINS)
    sig = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(low), BINS)
    keys = np.stack(x["bands"])
    tile = x["lo"][0] != x["hi"][0]
    for i in range(len(low) - 1):
        least = np.minimum(grams[i + 1 :], grams[i])
        near = (comp[i + 1 :] != comp[i]) & (_agree(low[i + 1 :], high[i + 1 :], low[i], high[i]) >= close[least])
        if tile:
            near &= block[i + 1 :] != block[i]
        at = np.flatnonzero(near)
        at = at[(sig[i + 1 + at] == sig[i]).sum(axis=1) >= closer[least[at]]] + i + 1
        if len(at):
            at = at[keys[i][(keys[at] == keys[i]).argmax(axis=1)] == key]
        yield i, at, comp


def _close(share: float):
    """Classes (key, node) with a close signature in another component of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, ["key", "lo", "hi"]):
            met = np.zeros(len(x["node"]), bool)
            for i, at, _ in _close_pairs(x, share):
                met[at] = True
                met[i] |= len(at) > 0
            if met.any():
                found = x["node"][met]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x["key"][0])), pa.array(found)], names=["key", "node"])

    return run


def _across(similarity: tuple[int, int]):
    """Links (u, v) between different components in each run; tiles of a large bucket hold two blocks each."""
    share = similarity[0] / similarity[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for x in _runs(batches, ["key", "lo", "hi"]):
            nodes = x["node"]
            sets = [np.frombuffer(m, np.uint64) for m in x["members"]]
            for i, at, comp in _close_pairs(x, share):
                for j in at.tolist():
                    if comp[i] != comp[j] and similar(sets[i], sets[j], similarity):
                        out.append((int(nodes[i]), int(nodes[j])))
                        comp[comp == comp[j]] = comp[i]
            if len(out) > 20_000:
                yield _batch(out, "u long, v long")
                out = []
        if out:
            yield _batch(out, "u long, v long")

    return run


def _tiles(rows: DataFrame, block: int, nodes: DataFrame) -> DataFrame:
    """Rows (key, node, component) of buckets as pairs of blocks of about ``block`` classes, with their signatures."""
    counted = rows.join(rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "key")
    return (
        counted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component")
        .join(nodes.select("node", "bands", "sig", "low", "high", "grams"), "node")
    )


def _by_tile(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = _WordHashes()
    for batch in batches:
        sets = [shingles(t.as_py() or b"", words_of)[0].tobytes() for t in batch["text"].cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "members"])


def _confirm(similarity: tuple[int, int]):
    """Rows sorted by star; each star's middle comes first. Keeps the pairs that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, at = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, members in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["members"], strict=True):
                own = np.frombuffer(members.as_buffer(), np.uint64)
                if b is None:
                    middle, at = own, a
                    continue
                assert at == a
                if similar(own, middle, similarity):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["u", "v"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, as (u, v). The set of a travels once for each HOT_STAR pairs of it."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT_STAR).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("node"))
    middles = sizes.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"))
    rows = members.unionByName(middles).join(sets, "node").select("a", "b", "salt", "members")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(tidied(_confirm(similarity)), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (75, 100), hot: int = HOT_BUCKET, with_keys: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept; with_keys adds rid, which tells
    rows of one id apart, and component, which tells components apart and is null where there are no shingles.

    Null and empty texts have no shingles and link with nothing. Rows of equal word sequences are linked at once. A null
    id is never the smallest; a row without another id in its class has component_id null and is kept. Rows that share an
    id but not a text are told apart. A very long text is a set like others, made in one task. Other columns are not read;
    an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(df, id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    signed = materialise(docs.mapInArrow(tidied(_signatures), "doc_id long, rid long, node long, mark long, n_shingles long, bands array<long>, low long, high long, sig binary"), "signatures")
    wanted_share = similarity[0] / similarity[1]
    while True:
        nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("sig").alias("sig"), F.first("n_shingles").alias("grams"), F.first(F.struct("doc_id", "rid")).alias("row"), F.min("mark").alias("mark"), F.max("mark").alias("other"))
        nodes = materialise(nodes, "classes")
        if nodes.where("mark <> other").isEmpty():
            break
        # two word sequences have met in the first 64 bits: all nodes are named anew from 128
        signed = materialise(signed.withColumn("node", F.when(F.col("node").isNotNull(), F.xxhash64("node", "mark"))), "signatures")
    nodes = nodes.drop("mark", "other")
    banded = nodes.select(F.explode("bands").alias("key"), "node", "low", "high", "grams")
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(banded.join(crowded, "key"), "buckets")

    many = members.withColumn("salts", F.ceil(F.col("n") / hot))
    stars = []
    for turn in range(LEADER_TURNS):
        salted = many.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("salts")).cast("int"))
        found = materialise(salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_stars(wanted_share), _STAR), "stars")
        stars.append(found)
        # leaders of dealt-out buckets, where they have become fewer; the last pass goes through all of them anyway
        dealt = many.where("salts > 1").groupBy("key").agg(F.count("*").alias("before"))
        leaders = found.where("b is null").join(dealt, "key").select("key", F.col("a").alias("node"), "low", "high", "grams", "before")
        left = leaders.groupBy("key").agg(F.count("*").alias("n"), F.first("before").alias("before")).where("2 * n <= before").select("key", F.ceil(F.col("n") / hot).alias("salts"))
        many = leaders.drop("before").join(left, "key")
        if many.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, stars).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")

    # any row of a class will do for its set
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("row.doc_id").alias("_id"), F.col("row.rid").alias("_rid")), "node")
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid"))).select("node", "text")
    if not signed.groupBy("doc_id", "rid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    sets = materialise(texts.mapInArrow(tidied(_sets), "node long, members binary"), "sets")
    links = materialise(_confirmed(pairs, sets, similarity), "links")
    parts = materialise(connected_components(links), "parts")

    labelled = members.select("key", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    mixed = labelled.join(mixed, "key").select("key", "node", "component")
    close = _by_tile(_tiles(mixed, min(hot, BLOCK), nodes)).mapInArrow(tidied(_close(wanted_share)), "key long, node long").distinct()
    close = materialise(close.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "close")
    more = _by_tile(_tiles(close, min(hot, BLOCK), nodes).join(sets, "node")).mapInArrow(tidied(_across(similarity)), "u long, v long")
    more = materialise(more, "across")
    if not more.isEmpty():
        parts = materialise(connected_components(links.unionByName(more)), "parts")

    classes = nodes.select("node", "doc_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # a component of rows without ids has no smallest one
    named = classes.join(smallest, "component").select("node", "component", "component_id")
    return signed.select("doc_id", "rid", "node", "n_shingles").join(named, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        *(["rid", "component"] if with_keys else []),
    )


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.75 of five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))
