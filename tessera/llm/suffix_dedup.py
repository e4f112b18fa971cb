"""Removal of repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes when some string of ``min_len`` bytes that covers it starts at two or more places of the corpus. Bytes of
shorter strings (``passage``) that repeat can be counted in the same pass.

1. Every start of a string of the asked length is keyed by the smallest hash among the pieces of ``k`` bytes inside the
   string. Equal strings have equal keys, so a repeat never crosses keys. Consecutive starts with one key form a run.
2. Runs whose key occurs once are done. The texts of the other runs are dealt to buckets by key. Keys with very many runs
   are first keyed anew with longer pieces (``levels``); at the last level the piece is the string itself, told apart by
   128 bits more.
3. Each bucket sorts the suffixes of its distinct run texts, takes the Burrows-Wheeler transform and expands intervals
   breadth first by backward extension: length l finds all common prefixes of value l. It stops at the asked length; the
   boundaries not found by then lie inside classes of equal strings. A class with two occurrences repeats. Of two lengths
   the shorter one is read off when the expansion passes it.
4. Each document gets the union of its covered spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import byte_chunks, materialise, row_key, table, tidied

MIN_LEN = 400
LEVELS = (128, 320, 400)
#: Bytes that a passage of 51 words reaches, and the levels scaled to it.
PASSAGE, PASSAGE_LEVELS = 240, (80, 192, 240)
HOT_RUNS = 4096
BUCKET_BYTES = 512 << 10
CHUNK_BYTES = 1 << 20
MAX_RUN = 8192
SEPARATOR = 0xFF  # never part of UTF-8

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _piece_hashes(data: np.ndarray, k: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mixed hash of every k-byte piece, from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers[0][:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * powers[1][: n - k + 1]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    if w == 1:
        return h
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def key_runs(payloads: list[bytes], k: int, min_len: int, powers, only: list | None = None):
    """Runs of starts with one key: arrays of row, first start, number of starts, key, places of the smallest piece, proof.

    only: per row, ranges of starts. A run of one place has no string twice in itself. proof: 16 bytes that tell strings
    apart where the key is that of the whole string, else NULL.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64), pa.nulls(0, pa.binary()))
    lens = np.fromiter(map(len, payloads), np.int64, len(payloads))
    ends = np.cumsum(lens)
    begins = ends - lens
    data = np.frombuffer(b"".join(payloads), np.uint8)
    if len(data) < min_len:
        return none
    hashes = _piece_hashes(data, k, powers)
    low = _U((1 << len(hashes).bit_length()) - 1)
    at = (_sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), min_len - k + 1) & low).astype(np.int64)
    usable = np.zeros(len(at) + 1, np.int64)
    if only is None:
        fit = lens >= min_len
        np.add.at(usable, begins[fit], 1)
        np.add.at(usable, ends[fit] - min_len + 1, -1)
    else:
        for row, ranges in enumerate(only):
            for first, count in ranges:
                count = min(count, lens[row] - min_len + 1 - first)
                if count > 0:
                    usable[begins[row] + first] += 1
                    usable[begins[row] + first + count] -= 1
    starts = np.flatnonzero(np.cumsum(usable[:-1]) > 0)
    if not len(starts):
        return none
    at = at[starts]
    key = hashes[at]
    row = np.searchsorted(ends, starts, side="right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    # very long runs (periodic texts) are cut; their parts share the key
    length = np.diff(np.append(first, len(starts)))
    if (length > MAX_RUN).any():
        first = np.concatenate([np.arange(a, a + n, MAX_RUN) for a, n in zip(first, length, strict=True)])
        length = np.diff(np.append(first, len(starts)))
    moved = np.ones(len(starts), np.int64)
    moved[1:] = at[1:] != at[:-1]
    moved[first] = 1
    proof = pa.array([xxhash.xxh3_128_digest(data[at : at + k]) for at in starts[first].tolist()], pa.binary()) if k == min_len else pa.nulls(len(first), pa.binary())
    return row[first], starts[first] - begins[row[first]], length, key[first], np.add.reduceat(moved, first), proof


_RUN = "doc_id long, rid long, first int, starts int, key long, places long, proof binary"


def _runs_of(k: int, min_len: int, ranged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK_BYTES)
        for batch in batches:
            ids, rids = batch["doc_id"], batch["rid"]
            ranges = batch["ranges"].to_pylist() if ranged else None
            for at, payloads in byte_chunks(batch["text"], CHUNK_BYTES):
                size = sum(map(len, payloads))
                if size > len(powers[0]) - 1:
                    powers = _powers(size)
                only = [[(x["first"], x["starts"]) for x in r] for r in ranges[at : at + len(payloads)]] if ranged else None
                row, first, starts, key, places, proof = key_runs(payloads, k, min_len, powers, only)
                if len(row):
                    take = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), rids.take(take), pa.array(first, pa.int32()), pa.array(starts, pa.int32()), pa.array(key.view(np.int64)), pa.array(places), proof],
                        names=["doc_id", "rid", "first", "starts", "key", "places", "proof"],
                    )

    return run


_BODY = "key long, long_only boolean, starts int, body binary, doc_ids array<long>, rids array<long>, firsts array<int>"


def _cut(reach: int):
    """Texts of runs, once for each task and distinct text, with the places they stand at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool, int, bytes], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            out = pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)),
                    *(pa.array([[x[i] for x in places] for places in held.values()], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))),
                ],
                names=[c.split()[0] for c in _BODY.split(", ")],
            )
            held.clear()
            return out

        for batch in batches:
            for doc, rid, text, runs in zip(batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), batch["text"].cast(pa.large_binary()), batch["runs"].to_pylist(), strict=True):
                raw = text.as_py() or b""
                for r in runs:
                    body = raw[r["first"] : r["first"] + r["starts"] + reach - 1]
                    places = held.setdefault((r["key"], r["long_only"], r["starts"], body), [])
                    size += 80 + (0 if places else len(body))
                    places.append((doc, rid, r["first"]))
                if size > 16 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


WORD, SEED = 8, 128


def seed_length(limit: int) -> int:
    """The largest length of prefix doubling up to SEED and limit: the expansion starts from the strings of that length."""
    h = min(WORD, limit)
    while 2 * h <= min(SEED, limit):
        h *= 2
    return h


def suffix_order(data: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of data (cyclic) sorted by their first ``depth`` bytes, by prefix doubling on the parts still tied.

    Also where, in that order, the first ``seed`` bytes change.
    """
    n = len(data)
    h = min(WORD, depth)
    wrapped = np.resize(data, n + h)
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << _U(8)) | wrapped[j : j + n].astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    words = new.copy()
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    while h < depth:
        step = min(h, depth - h)
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = order[slots]
        nxt = pos + step
        nxt[nxt >= n] -= n
        both = (rank[pos].astype(np.uint64) << _U(32)) | rank[nxt].astype(np.uint64)
        by = np.argsort(both)
        pos, both = pos[by], both[by]
        order[slots] = pos
        apart = np.ones(len(slots), bool)
        apart[1:] = both[1:] != both[:-1]
        new[slots] = apart
        rank[pos] = slots[np.maximum.accumulate(np.where(apart, np.arange(len(slots)), 0))]
        h += step
        if h <= seed:
            words = new.copy()
    return order, words


def bounded_boundaries(data: np.ndarray, order: np.ndarray, limits: list[int], words: np.ndarray | None = None) -> list[np.ndarray]:
    """For each limit (ascending): true at slot i when the suffixes at slots i-1 and i share fewer than ``limit`` bytes.

    Breadth-first interval expansion: the interval of a string w in the order gives, by backward extension with each
    byte c before it, the interval of cw. A right end not met before is a common prefix of value l at length l; only
    such intervals are expanded further. The last limit is not expanded. words: where the first seed_length(limits[0])
    bytes change, to start from the intervals of these strings rather than from the empty one.
    """
    n = len(data)
    before = order - 1
    before[before < 0] += n
    bwt = data[before]
    psi = np.argsort(bwt, kind="stable").astype(np.int32)  # slot of cw -> slot of w
    lf = np.empty(n, np.int32)
    lf[psi] = np.arange(n, dtype=np.int32)
    same_next = np.zeros(n + 1, bool)  # slots i-1 and i of the order start with the same byte
    start_byte = bwt[psi]
    same_next[1:n] = start_byte[1:] == start_byte[:-1]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    left, right = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    length = 0
    if words is not None:
        length = seed_length(limits[0])
        found[:n] |= words
        left = np.flatnonzero(words).astype(np.int32)
        right = np.append(left[1:] - 1, n - 1).astype(np.int32)
    passed = []
    for at in range(length, limits[-1]):
        if at in limits:
            passed.append(found[:n].copy())
        if not len(left):
            continue
        width = right - left + 1
        total = int(width.sum())
        if total == len(left):
            slots, lo, hi = left, left, right
        else:
            ends = np.cumsum(width)
            slots = (np.arange(total, dtype=np.int64) + np.repeat(left - ends + width, width)).astype(np.int32)
            lo, hi = np.repeat(left, width), np.repeat(right, width)
        to = lf[slots]
        after = to + 1
        is_last = ~same_next[after]
        inner = np.flatnonzero(~is_last)
        is_last[inner] = psi[after[inner]] > hi[inner]
        is_first = ~same_next[to]
        inner = np.flatnonzero(~is_first)
        is_first[inner] = psi[to[inner] - 1] < lo[inner]
        l2, r2 = np.sort(to[is_first]), np.sort(to[is_last])
        fresh = ~found[r2 + 1]
        left, right = l2[fresh], r2[fresh]
        found[right + 1] = True
    return [*passed, found[:n]]


def repeated_ranges(bodies: list[bytes], starts: list[int], weights: np.ndarray, lengths: list[int]) -> list[list[np.ndarray]]:
    """For each length (ascending) and distinct body, the covered [from, to) ranges whose string of that length occurs twice or more.

    Only the first ``starts`` places of a body count as starts, those of them where the string fits.
    """
    lens = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"".join(b + bytes([SEPARATOR]) for b in bodies), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    order, words = suffix_order(data, lengths[-1], seed_length(lengths[0]))
    w, most = np.asarray(weights, np.int64), np.asarray(starts, np.int64)
    out = []
    for length, cuts in zip(lengths, bounded_boundaries(data, order, lengths, words), strict=True):
        classes = np.cumsum(cuts) - 1
        change = np.zeros(len(data) + 1, np.int64)
        count = np.minimum(most, lens - length + 1)
        fit = count > 0
        np.add.at(change, begins[fit], w[fit])
        np.add.at(change, (begins + count)[fit], -w[fit])
        weight = np.cumsum(change[:-1])  # occurrences in the corpus of the string at each place; 0 where none fits
        twice = np.bincount(classes, weights=weight[order], minlength=int(classes[-1]) + 1)[classes] >= 2
        hit = np.zeros(len(data), bool)
        hit[order] = twice
        hit &= weight > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        opened, closed = edge[::2], edge[1::2]
        body = np.searchsorted(begins, opened, side="right") - 1
        spans = np.stack([opened - begins[body], closed - begins[body] + length - 1], axis=1)
        by_body = np.searchsorted(body, np.arange(len(bodies) + 1))
        out.append([spans[by_body[i] : by_body[i + 1]] for i in range(len(bodies))])
    return out


_SPAN = "doc_id long, rid long, length int, lo int, hi int"


def _expand_bucket(lengths: list[int]):
    def run(group: pa.Table) -> pa.Table:
        lists = [group[c].combine_chunks() for c in ("doc_ids", "rids", "firsts")]
        each = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        places = [x.flatten() for x in lists]
        row_of = np.repeat(np.arange(len(each)), each)
        only = group["long_only"].to_numpy()
        starts, bodies = group["starts"].to_pylist(), group["body"].to_pylist()
        out = []
        # texts whose shorter strings are settled already are gone through for the longest length alone
        for long_only in (False, True):
            members: dict[tuple[int, bytes], int] = {}
            rows = np.flatnonzero(only == long_only).tolist()
            if not rows:
                continue
            body_of = np.full(len(only), -1, np.int64)
            for i in rows:
                body_of[i] = members.setdefault((starts[i], bodies[i]), len(members))
            own = np.flatnonzero(body_of[row_of] >= 0)  # places of these rows
            body = body_of[row_of[own]]
            weights = np.bincount(body, minlength=len(members))
            wanted = lengths[-1:] if long_only else lengths
            longer = None
            for length, found in reversed([*zip(wanted, repeated_ranges([b for _, b in members], [n for n, _ in members], weights, wanted), strict=True)]):
                if longer is not None:  # what lies inside a longer span says nothing more
                    found = _outside(found, longer)
                longer = found
                counts = np.fromiter(map(len, found), np.int64, len(found))
                begin = np.cumsum(counts) - counts
                # each place with each span of its body
                times = counts[body]
                at = np.repeat(own, times)
                span = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[body], times)
                flat = np.concatenate([*found, np.empty((0, 2), np.int64)])[span]
                where = pa.array(at)
                first = places[2].take(where).to_numpy(zero_copy_only=False)
                cols = [places[0].take(where), places[1].take(where), pa.array(np.full(len(at), length, np.int32)), pa.array((first + flat[:, 0]).astype(np.int32)), pa.array((first + flat[:, 1]).astype(np.int32))]
                out.append(pa.table(cols, names=[c.split()[0] for c in _SPAN.split(", ")]))
        return pa.concat_tables(out)

    return run


def _outside(short: list[np.ndarray], long: list[np.ndarray]) -> list[np.ndarray]:
    """Per body, the short spans that no long one contains; spans of a body are in order."""
    flat = lambda found: (np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([*found, np.empty((0, 2), np.int64)]).astype(np.int64))
    (a, s), (b, g) = flat(short), flat(long)
    at = np.searchsorted(b << 32 | g[:, 0], a << 32 | s[:, 0], side="right") - 1
    near = np.maximum(at, 0)
    inside = (at >= 0) & (b[near] == a) & (g[near, 1] >= s[:, 1]) if len(b) else np.zeros(len(a), bool)
    kept = s[~inside]
    cuts = np.searchsorted(a[~inside], np.arange(len(short) + 1))
    return [kept[cuts[i] : cuts[i + 1]] for i in range(len(short))]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return merged


def _strip(min_len: int, passage: int | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, spans_out, texts, shared, n_shared = [], [], [], [], [], [], [], []
            for text, spans in zip(batch["text"].cast(pa.large_binary()), batch["spans"].to_pylist(), strict=True):
                raw = text.as_py() or b""
                merged = _merged([(s["lo"], s["hi"]) for s in spans or () if s["length"] == min_len])
                if passage:
                    short = _merged([(s["lo"], s["hi"]) for s in spans or ()])
                    shared.append(sum(hi - lo for lo, hi in short))
                    n_shared.append(len(short))
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                spans_out.append(merged)
                if with_text:
                    # a cut inside a character leaves part of it on either side: those bytes go too
                    texts.append(text.as_py() if text.as_py() is None else rest.decode("utf-8", errors="ignore"))
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            cols = [batch[c] for c in names]
            more = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            more += [pa.array(shared, pa.int64()), pa.array(n_shared, pa.int64())] if passage else []
            if with_text:
                more += [pa.array(spans_out, pa.list_(pa.list_(pa.int32()))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*names, *(n for n, _ in _columns(passage, with_text))])

    return run


def _columns(passage: int | None, with_text: bool) -> list[tuple]:
    out: list[tuple] = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    out += [("passage_bytes", "long"), ("n_passages", "long")] if passage else []
    return out + ([("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), ("kept_text", "string")] if with_text else [])


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, levels: tuple[int, ...] = LEVELS, hot: int = HOT_RUNS, passage: int | None = None, passage_levels: tuple[int, ...] = PASSAGE_LEVELS) -> DataFrame:
    """(doc_id, rid, text) -> (doc_id, rid, spans): the covered spans (length, lo, hi) of each row that has any; rid tells rows apart.

    With ``passage`` (shorter than min_len) starts are keyed by strings of that length, which settles both: a string of
    min_len bytes repeats only where its first ``passage`` bytes do. Only keys whose short strings are hot at the last of
    passage_levels go on with those of ``levels`` that are longer.
    """
    spark = docs.sparkSession
    steps = [(k, passage) for k in passage_levels] + [(k, min_len) for k in levels if k > passage] if passage else [(k, min_len) for k in levels]
    lengths = [passage, min_len] if passage else [min_len]
    cold: list[DataFrame] = []
    sure: list[DataFrame] = []
    ranged: DataFrame | None = None
    for step, (k, length) in enumerate(steps):
        if ranged is None:
            source = docs
        else:
            hot_docs = ranged.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("first", "starts")).alias("ranges"))
            source = _with(docs, hot_docs).select("doc_id", "rid", "text", "ranges")
        runs = materialise(source.mapInArrow(tidied(_runs_of(k, length, ranged is not None)), _RUN), "runs")
        counts = runs.groupBy("key", "proof").agg(F.count("*").alias("n"), F.sum("places").alias("p")).where("p > 1").select(F.col("key").alias("_key"), F.col("proof").alias("_proof"), "n")
        long_only = F.lit(length != lengths[0])
        again = materialise(runs.join(counts, (F.col("key") == F.col("_key")) & F.col("proof").eqNullSafe(F.col("_proof"))).select("doc_id", "rid", "first", "starts", "key", long_only.alias("long_only"), "n"), "again")
        cold.append(again.where(F.col("n") <= hot).drop("n"))
        ranged = again.where(F.col("n") > hot)
        if k == length:  # the key is that of the whole string: its many occurrences are equal
            sure.append(ranged.select("doc_id", "rid", F.lit(length).alias("length"), F.col("first").alias("lo"), (F.col("first") + F.col("starts") + F.lit(length - 1)).cast("int").alias("hi")))
        elif step == len(steps) - 1:
            cold.append(ranged.drop("n"))
        if step < len(steps) - 1 and ranged.isEmpty():
            break
    todo = cold[0]
    for more in cold[1:]:
        todo = todo.unionByName(more)
    volume = todo.agg(F.sum(F.col("starts") + min_len)).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET_BYTES))
    per_doc = todo.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("key", "first", "starts", "long_only")).alias("runs"))
    bodies = _with(docs, per_doc).select("doc_id", "rid", "text", "runs").mapInArrow(tidied(_cut(min_len)), _BODY)
    spans = bodies.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_expand_bucket(lengths), _SPAN)
    for more in sure:
        spans = spans.unionByName(more)
    spans = materialise(spans, "spans")
    return spans.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("length", "lo", "hi")).alias("spans"))


def _with(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with what was gathered for them; the gathered side is the smaller one."""
    right = lists.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"})
    return docs.join(right.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid")), how).drop("_id", "_rid")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, with_text: bool = False, keep: tuple[str, ...] = (),
    levels: tuple[int, ...] = LEVELS, hot: int = HOT_RUNS, passage: int | None = None, passage_levels: tuple[int, ...] = PASSAGE_LEVELS,
) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256; with_text adds removed spans and the text that is left.

    passage: a shorter length; adds passage_bytes and n_passages, the bytes and runs covered by strings of that length that
    repeat, which are counted and not removed. Null text counts as empty. Rows repeated as a whole count as further
    occurrences, so long ones lose all their bytes. Texts shorter than ``min_len`` bytes are never cut. A very long text is
    worked on whole, in one task. Of the other columns those named in keep are passed on, the rest is not read. kept_text
    of a null text is null. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(df, id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(df, id_col, text_col).alias("rid"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    joined = _with(whole, repeated_spans(docs, min_len, levels, hot, passage, passage_levels), "left").drop("rid")
    schema = T.StructType([f for f in joined.schema.fields if f.name not in ("text", "spans")])
    for name, kind in _columns(passage, with_text):
        schema.add(name, kind)
    return joined.mapInArrow(tidied(_strip(min_len, passage, with_text)), schema).withColumnsRenamed({f"keep_{c}": c for c in keep})


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that repeat are removed; bytes in passages of 240 bytes (some 51 words) that repeat are counted beside."""
    return remove_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE)
