"""Anchors of hot keys against a plain fold, and the timeout of a change stream against its batch twin."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import greedy, streams


def fold(rows, gap, strict):
    """(key, row, number since its anchor) by one pass over each key."""
    out, state = [], {}
    for k, t, i, reset in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        at, n = state.get(k, (None, 0))
        if reset:
            at, n = None, 0
        elif at is None or (t - at > gap if strict else t - at >= gap):
            at, n = t, 1
        else:
            n += 1
        state[k] = at, n
        out.append((k, i, n))
    return sorted(out, key=str)


def test_step_functions_against_each_entry():
    r = random.Random(1)
    for _ in range(200):
        t = np.sort(np.array([r.randrange(60) for _ in range(r.randrange(1, 25))], np.int64))
        reset = np.array([r.random() < r.choice([0, 0.1]) for _ in t])
        gap, strict = r.randrange(1, 20), r.random() < 0.5
        has_reset, n, thresholds, exits, counts = greedy.steps(t, reset, gap, strict)
        for at in [None, *range(int(t[0]) - 25, int(t[0]) + 1)]:
            _, want_at, want_n = greedy.settle(t, reset, gap, strict, at, 5 if at is not None else 0)
            if has_reset:
                got = (int(exits[0]) if len(exits) else None, int(counts[0]))
            else:
                i = 0 if at is None else int(np.searchsorted(thresholds, at + gap, "right" if strict else "left"))
                got = (int(exits[i]), int(counts[i])) if i < len(exits) else (at, 5 + n)
            assert got == (want_at, want_n)


@pytest.mark.parametrize("strict,stretch,resets", [(False, 11, 0.0), (True, 11, 0.1), (False, 1 << 16, 0.0), (True, 7, 0.0)])
def test_a_key_with_a_third_of_all_rows(spark, strict, stretch, resets):
    """Spread over tasks (small ones would be run together); null, text and repeated moments too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_hot_key(spark, strict, stretch, resets)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_hot_key(spark, strict, stretch, resets):
    r = random.Random(stretch)
    rows = [(r.choice(["hot", r.choice([None, "a", "b"]), f"k{i % 40}"]), r.randrange(3000), i, r.random() < resets) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, s long, i long, reset boolean").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = greedy.since_anchor(df, "k", "ts", "i", 40.0, strict, F.col("reset"), stretch).collect()
    assert sorted(map(tuple, got), key=str) == fold(rows, 40, strict)
    schema = spark.createDataFrame([], f"k string, row long, since long, chunk long, {greedy._CHUNK}").schema
    timed = df.select("k", greedy.micros(F.col("ts")).alias("t"), F.col("i").alias("r"), F.col("reset").alias("f"))
    dealt = timed.repartitionByRange("k", "t", "r", "f").sortWithinPartitions("k", "t", "r", "f").mapInArrow(greedy._stretches("k", 40_000_000, strict, stretch), schema)
    assert dealt.where("k = 'hot'").select((F.col("chunk") / (1 << 32)).cast("int")).distinct().count() > 2


def test_empty(spark):
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, i long")
    assert streams.debounce(none, "k", "ts", "i", 10.0).collect() == []


def test_timeout_tells_a_silent_key_once(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    moment = lambda s: start + pd.Timedelta(seconds=s)
    batches = [
        [(1, 0, 10, "a"), (1, 5, 11, "a"), (1, 100, 12, "b"), (2, 0, 20, "a"), (2, 10, 21, "done"), (2, 20, 22, "c"), (3, 0, 30, "a")],
        [(1, 299, 13, "c"), (3, 250, 31, "a"), (4, 290, 40, "a")],
        [(1, 300, 14, "c"), (3, 650, 32, "a"), (2, 400, 23, "a")],
        [(9, 5000, 90, "done")],
        [(9, 9000, 91, "done")],
    ]
    rows = [(u, moment(s), i, v) for b in batches for u, s, i, v in b]
    frame = lambda rs: spark.createDataFrame(pd.DataFrame(rs, columns=["user", "ts", "id", "kind"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    want = sorted(map(str, map(tuple, streams.changes_until(frame(rows), "user", "ts", "id", "kind", "done", 300.0, "2024-01-01 02:25:00").collect())))
    assert want == sorted(map(str, [(1, 10, "a"), (1, 12, "b"), (1, 13, "c"), (1, None, "timeout"), (1, 14, "c"), (1, None, "timeout"), (2, 20, "a"), (2, 21, "done"), (2, 23, "a"), (2, None, "timeout"), (3, 30, "a"), (3, None, "timeout"), (3, 32, "a"), (3, None, "timeout"), (4, 40, "a"), (4, None, "timeout"), (9, 90, "done"), (9, 91, "done")]))
    for number, b in enumerate(batches):
        frame([(u, moment(s), i, v) for u, s, i, v in b]).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("user long, ts timestamp_ntz, id long, kind string").parquet(folder)
        told = streams.change_stream(source, "user", "ts", "id", "kind", "done", 300.0)
        q = told.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / "out")).select("user", "id", "kind").collect())))
    assert got == want
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 1  # that of the last key; all others are freed
