"""Anchors on each key's time line: a row is one if it lies at least a gap after the anchor before it (or after a reset).

Debouncing (STM-02), rate windows (STM-03) and runs with a deadline (STM-04) are all this. The next anchor depends on the one
before, so one key looks like one task; but a stretch of rows is a step function from the anchor that it is entered with to the
one that it is left with, and few steps remain, as walks soon meet. So rows are dealt out by ranges of (key, time), however hot
a key is. A key that lies within one part is settled there; stretches of keys that cross parts, or are long, are written with
their step functions, which are then run through in order (a row for each stretch, not for each event), and each stretch is
settled with its entry. Moments are whole microseconds, so that nothing depends on rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import materialise

#: Rows of a stretch.
STRETCH = 1 << 16
_CHUNK = "t binary, r binary, f binary, reset boolean, n long, thresholds binary, exits binary, counts binary"


def settle(t: np.ndarray, reset: np.ndarray, gap: int, strict: bool, at: int | None = None, n: int = 0) -> tuple[np.ndarray, int | None, int]:
    """Each row's number since its anchor (1 for the anchor, 0 for a reset), and the last anchor and number.

    at, n: anchor before the first row and rows since. strict: a row exactly at the gap is no anchor.
    """
    since, side = np.zeros(len(t), np.int64), "right" if strict else "left"
    stops = np.append(np.flatnonzero(reset), len(t))
    begin = 0
    for stop in stops.tolist():
        pos = begin
        if at is not None:
            pos = begin + int(np.searchsorted(t[begin:stop], at + gap, side))
            since[begin:pos] = n + np.arange(1, pos - begin + 1)
            n += pos - begin
        while pos < stop:
            at = int(t[pos])
            end = max(pos + 1, pos + int(np.searchsorted(t[pos:stop], at + gap, side)))
            n = end - pos
            since[pos:end] = np.arange(1, n + 1)
            pos = end
        if stop < len(t):
            at, n = None, 0
        begin = stop + 1
    return since, at, n


def steps(t: np.ndarray, reset: np.ndarray, gap: int, strict: bool) -> tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]:
    """What a stretch does to an entry: whether it has a reset, its rows, and for each first anchor that it may have the last one.

    First anchors with one outcome stand together: by the latest moment of theirs, the last anchor and the rows since.
    """
    if reset.any():
        _, at, n = settle(t, reset, gap, strict)
        return True, len(t), np.array([], np.int64), np.array([] if at is None else [at], np.int64), np.array([n], np.int64)
    side = "right" if strict else "left"
    ahead = np.maximum(np.searchsorted(t, t + gap, side), np.arange(len(t)) + 1)
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if ahead[i] < len(t):
            last[i] = last[ahead[i]]
    near = last[: int(np.searchsorted(t, t[0] + gap, side)) + 1]
    keep = np.append(near[1:] != near[:-1], True)
    return False, len(t), t[: len(near)][keep], t[near[keep]], len(t) - near[keep]


def _stretches(key: str, gap: int, strict: bool, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        name, held, first, cut, kind = None, None, True, False, None

        def size(arrays) -> int:
            return sum(len(a[0]) for a in arrays)

        def rows_of(arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate(c) for c in zip(*arrays, strict=True))

        def chunk(arrays) -> pa.RecordBatch:
            nonlocal number
            t, r, f = rows_of(arrays)
            reset, n, *more = steps(t, f, gap, strict)
            body = [t.tobytes(), r.tobytes(), f.tobytes(), reset, n, *(x.astype(np.int64).tobytes() for x in more)]
            number += 1
            kinds = (pa.binary(),) * 3 + (pa.bool_(), pa.int64()) + (pa.binary(),) * 3
            return pa.RecordBatch.from_arrays([name, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([part << 32 | number]), *(pa.array([x], k) for x, k in zip(body, kinds, strict=True))], names=_names(key))

        def settled(arrays) -> pa.RecordBatch:
            t, r, f = rows_of(arrays)
            since, *_ = settle(t, f, gap, strict)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(t), np.int32)), name).cast(kind)
            return pa.RecordBatch.from_arrays([names, pa.array(r), pa.array(since), pa.nulls(len(t), pa.int64()), *(pa.nulls(len(t), k) for k in (pa.binary(),) * 3 + (pa.bool_(), pa.int64()) + (pa.binary(),) * 3)], names=_names(key))

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(key).type
            runs = pc.run_end_encode(batch[key])
            t, r, f = (batch[c].to_numpy(zero_copy_only=False) for c in ("t", "r", "f"))
            begin = 0
            for i, end in enumerate(runs.run_ends.to_pylist()):
                mine = runs.values.slice(i, 1)
                if name is None or not (mine.equals(name)):
                    if name is not None and size(held):
                        # the first and the last key of a part may go on in others
                        yield chunk(held) if first or cut else settled(held)
                    first = first and name is None
                    name, held, cut = mine, [], False
                held.append((t[begin:end], r[begin:end], f[begin:end].astype(bool)))
                if size(held) >= stretch:
                    yield chunk(held)
                    held, cut = [(t[:0], r[:0], f[:0].astype(bool))], True
                begin = end
        if name is not None and size(held):
            yield chunk(held)

    return run


def _names(key: str) -> list[str]:
    return [key, "row", "since", "chunk", *(c.split()[0] for c in _CHUNK.split(", "))]


def _walk(key: str, gap: int, strict: bool):
    """The anchor that each of a key's stretches is entered with, from their step functions in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, n, out = None, 0, []
        ints = lambda raw: np.frombuffer(raw, np.int64)
        for c in pdf.sort_values("chunk").itertuples(index=False):
            out.append((c.chunk, at, n))
            exits, since = ints(c.exits), ints(c.counts)
            if c.reset:
                at, n = (int(exits[0]) if len(exits) else None), int(since[0])
                continue
            i = 0 if at is None else int(np.searchsorted(ints(c.thresholds), at + gap, "right" if strict else "left"))
            at, n = (int(exits[i]), int(since[i])) if i < len(exits) else (at, n + c.n)
        return pd.DataFrame({"chunk": [x[0] for x in out], "at": pd.array([x[1] for x in out], "Int64"), "before": [x[2] for x in out]})

    return run


def _entered(key: str, gap: int, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, before, t, r, f = (batch[c][i].as_py() for c in ("at", "before", "t", "r", "f"))
                rows = np.frombuffer(r, np.int64)
                since, *_ = settle(np.frombuffer(t, np.int64), np.frombuffer(f, bool), gap, strict, at, before)
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(rows), np.int32)), batch[key].slice(i, 1)).cast(batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([names, pa.array(rows), pa.array(since)], names=[key, "row", "since"])

    return run


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def since_anchor(df: DataFrame, key: str, time: str, row: str, gap: float, strict: bool = False, reset: Column | None = None, stretch: int = STRETCH) -> DataFrame:
    """(key, row, since): 1 for anchors, then counted on; 0 for rows that reset their key. gap: seconds.

    Rows of one moment stand by row, those that reset last. row is a long that tells rows apart; rows without a moment fall away.
    """
    flag = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    timed = df.select(key, micros(F.col(time)).alias("t"), F.col(row).cast("long").alias("r"), flag.alias("f")).where("t is not null")
    order = [F.col(key), F.col("t"), F.col("r"), F.col("f")]
    width = round(gap * 1_000_000)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(f"row long, since long, chunk long, {_CHUNK}").fields])
    dealt = timed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretches(key, width, strict, stretch), schema)
    made = materialise(dealt, "stretches")
    chunks = made.where("chunk is not null")
    walked = chunks.select(key, "chunk", "reset", "n", "thresholds", "exits", "counts").groupBy(key).applyInPandas(_walk(key, width, strict), "chunk long, at long, before long")
    bodies = chunks.select(key, "chunk", "t", "r", "f").join(walked.hint("shuffle_hash"), "chunk")
    out = T.StructType([T.StructField(key, kind), T.StructField("row", T.LongType()), T.StructField("since", T.LongType())])
    return made.where("chunk is null").select(key, "row", "since").unionByName(bodies.mapInArrow(_entered(key, width, strict), out))
