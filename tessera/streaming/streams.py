"""Streams (STM-01..07) and their batch twins: debounce, failure limiter, change feed, file index, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.relational import top_one
from tessera.streaming.greedy import micros, since_anchor


def debounce(df: DataFrame, key: str, time: str, row: str, gap: float) -> DataFrame:
    """STM-02: rows at least `gap` after the last accepted one of their key (not after the last one)."""
    return since_anchor(df, key, time, row, gap).where("since = 1").select(key, F.col("row").alias(row))


def seconds(moment: Column) -> Column:
    """A zone-less moment as seconds, fractions kept."""
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)


def limiter(df: DataFrame, key: str, time: str, row: str, failed: Column, limit: int, window: float, block: float) -> DataFrame:
    """STM-03: (key, row, blocked) for each failure: a window opens at its first failure, `limit` failures in it block; a success resets.

    A failure is blocked if it is the limit's in its window or comes after that one, as each of them begins the block anew.
    """
    counted = since_anchor(df, key, time, row, window, strict=True, reset=~failed).where("since > 0")
    return counted.select(key, F.col("row").alias(row), ((F.col("since") >= limit) & F.lit(block > 0)).alias("blocked"))


def _sorted(pdfs: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(columns)


def debounce_stream(df: DataFrame, key: str, time: str, row: str, gap: float) -> DataFrame:
    """STM-02 on a stream: the state of a key is its last accepted moment. Rows of one batch are put in order first."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, kept = state.get[0] if state.exists else None, []
        for t, r in _sorted(pdfs, ["t", "r"])[["t", "r"]].itertuples(index=False):
            if at is None or t - at >= gap:
                at = t
                kept.append(r)
        state.update((at,))
        yield pd.DataFrame({key: [k[0]] * len(kept), row: kept})

    timed = df.select(F.col(key).cast("long").alias(key), seconds(F.col(time)).alias("t"), F.col(row).cast("long").alias("r"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, {row} long", "at double", "append", GroupStateTimeout.NoTimeout)


def limiter_stream(df: DataFrame, key: str, time: str, row: str, failed: Column, limit: int, window: float, block: float) -> DataFrame:
    """STM-03 on a stream."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, until = state.get if state.exists else (0, None, 0.0)
        out = []
        for t, r, f in _sorted(pdfs, ["t", "r"])[["t", "r", "f"]].itertuples(index=False):
            if not f:
                n, first, until = 0, None, 0.0
                continue
            if first is None or t - first > window:
                n, first, until = 0, t, 0.0
            n += 1
            if n >= limit:
                until = t + block
            out.append((k[0], r, until > t))
        state.update((n, first, until))
        yield pd.DataFrame(out, columns=[key, row, "blocked"])

    timed = df.select(F.col(key).cast("long").alias(key), seconds(F.col(time)).alias("t"), F.col(row).cast("long").alias("r"), failed.alias("f"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, {row} long, blocked boolean", "n int, first double, until double", "append", GroupStateTimeout.NoTimeout)


TIMEOUT = "timeout"


def changes_until(df: DataFrame, key: str, time: str, row: str, value: str, final: str, timeout: float, now: str) -> DataFrame:
    """STM-04: (key, row, value) where a key's value changes, in runs of `timeout` seconds from the run's first row.

    After the final value a run says nothing more. A run without it ends with one row of its own: value 'timeout', row NULL, once
    its end is not after `now`. The next row of the key begins a new run.
    """
    runs = since_anchor(df, key, time, row, timeout).withColumnsRenamed({"row": row})
    rows = df.select(key, F.col(row).cast("long").alias(row), F.col(value).alias("v"), micros(F.col(time)).alias("t")).join(runs, [key, row])
    by_key = Window.partitionBy(key).orderBy("t", row)
    rows = rows.withColumn("run", F.last(F.when(F.col("since") == 1, F.col("t")), ignorenulls=True).over(by_key))
    in_run = Window.partitionBy(key, "run").orderBy("t", row)
    ended = F.coalesce(F.max(F.col("v") == final).over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"_before": F.lag("v").over(in_run), "_ended": ended})
    told = rows.where(((F.col("since") == 1) | ~F.col("v").eqNullSafe(F.col("_before"))) & ~F.col("_ended")).select(key, row, F.col("v").alias(value))
    silent = rows.groupBy(key, "run").agg(F.max(F.coalesce(F.col("v") == final, F.lit(False))).alias("done")).where(~F.col("done") & (F.col("run") + round(timeout * 1_000_000) <= F.unix_micros(F.lit(now).cast("timestamp"))))
    return told.unionByName(silent.select(key, F.lit(None).cast("long").alias(row), F.lit(TIMEOUT).alias(value)))


def change_stream(df: DataFrame, key: str, time: str, row: str, value: str, final: str | None = None, timeout: float | None = None, late: str = "0 seconds") -> DataFrame:
    """STM-04 on a stream: rows whose value changes; after the final value a key says nothing more.

    With timeout, runs end as in `changes_until`: a timer of event time, `timeout` seconds after a run's first row, tells the end
    of a run that has gone silent, once, and frees its state. Rows may be late by `late`.
    """
    limit = None if timeout is None else round(timeout * 1_000_000)

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since, out = None, None, []
        if state.exists:
            last, since = state.get
        if state.hasTimedOut:
            if last != final:
                out.append((k[0], None, TIMEOUT))
            state.remove()
            yield _told(out, key, row, value)
            return
        for t, r, v in _sorted(pdfs, ["t", "r"])[["t", "r", "v"]].itertuples(index=False):
            if limit is not None and since is not None and t - since >= limit:
                if last != final:
                    out.append((k[0], None, TIMEOUT))
                last, since = None, None
            begins = since is None
            since = t if begins else since
            if (begins or v != last) and (final is None or last != final):
                out.append((k[0], r, v))
                last = v
        state.update((last, since))
        if limit is not None:
            # a deadline that the watermark has passed already is told by the next one
            state.setTimeoutTimestamp(max(-(-(since + limit) // 1000), state.getCurrentWatermarkMs() + 1))
        yield _told(out, key, row, value)

    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if timeout is not None else df
    timed = timed.select(F.col(key).cast("long").alias(key), micros(F.col(time)).alias("t"), F.col(row).cast("long").alias("r"), F.col(value).alias("v"), *([time] if timeout is not None else []))
    kind = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, {row} long, {value} string", "last string, since long", "append", kind)


def _told(out: list[tuple], key: str, row: str, value: str) -> pd.DataFrame:
    return pd.DataFrame({key: [x[0] for x in out], row: pd.array([x[1] for x in out], "Int64"), value: pd.array([x[2] for x in out], "object")})


def file_index(events: DataFrame, path: str, time: str, kind: str, target: str) -> DataFrame:
    """STM-01/05: the files that stand after created, modified, moved and deleted events; a move deletes here and creates there."""
    gone = events.where(F.col(kind).isin("deleted", "moved")).select(F.col(path).alias("file"), F.col(time).alias("at"), F.lit(0).alias("there"))
    made = events.where(F.col(kind).isin("created", "modified", "moved")).select(F.when(F.col(kind) == "moved", F.col(target)).otherwise(F.col(path)).alias("file"), F.col(time).alias("at"), F.lit(1).alias("there"))
    return top_one(gone.unionByName(made), ["file"], [F.desc("at"), F.desc("there")]).where("there = 1").select("file", "at")


BUCKETS = 64


def upsert_batches(stream: DataFrame, table: str, keys: list[str], order: list[Column], checkpoint: str, buckets: int = BUCKETS):
    """STM-01/07: a stream kept as the last row of each key.

    Keys are dealt to buckets; a batch writes anew only those that it touches, and last of all a list of which version
    each bucket stands in. Versions are named by the batch's number, so a batch that is tried again writes the same ones,
    and one that breaks off leaves the list of the batch before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        dealt = top_one(batch, keys, order).withColumn("_b", F.pmod(F.hash(*keys), F.lit(buckets)))
        at = versions(spark, table, number - 1)
        touched = [r[0] for r in dealt.select("_b").distinct().collect()]  # at most ``buckets`` rows
        old = _rows(spark, table, {b: v for b, v in at.items() if b in touched}, schema)
        merged = old.join(dealt.select(*keys), keys, "left_anti").withColumn("_b", F.pmod(F.hash(*keys), F.lit(buckets))).unionByName(dealt)
        merged.write.mode("overwrite").partitionBy("_b").parquet(f"{table}/v{number}")
        now = sorted((at | {b: number for b in touched}).items())
        spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{table}/versions/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark, table: str, number: int | None = None) -> dict[int, int]:
    """The version in which each bucket stands, by the last list, or the last one up to a batch's number."""
    from pyspark.errors import AnalysisException

    try:
        lists = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(f"{table}/versions")
    except AnalysisException:  # no batch yet
        return {}
    numbers = lists.select(F.regexp_extract("path", r"/v(\d+)/[^/]*$", 1).cast("long").alias("v"))
    last = numbers.where(F.lit(number is None) | (F.col("v") <= F.lit(number))).agg(F.max("v")).first()[0]
    return {} if last is None else {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{table}/versions/v{last}").collect()}


def _rows(spark, table: str, at: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/v{v}/_b={b}" for b, v in at.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_last(spark, table: str, schema) -> DataFrame:
    """STM-07: all rows as the last batch left them; no rows before the first one."""
    return _rows(spark, table, versions(spark, table), schema)


def monitor(objects: DataFrame, seen: DataFrame, key: str, content: str) -> DataFrame:
    """STM-06: a log row for each monitored object: new, changed or same."""
    last = seen.select(key, F.col(content).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(content), "changed").otherwise("same")
    return objects.where("monitored = 1").join(last, key, "left").select(key, state.alias("state"))


def windowed(df: DataFrame, time: str, key: str, value: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Extension: counts and sums in tumbling or sliding windows; on a stream, rows later than `late` are left out."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.window(time, length, slide or length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Extension: sessions that end after a gap."""
    return df.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_within(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Extension: one row a key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
