"""Helpers shared by the training-data operators: scratch tables, batches of bytes, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import materialise


def tidied(run):
    """A map over batches that gives freed memory back to the system at its end: workers live on for other stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Split a text or binary column into runs of rows of about ``limit`` bytes: (first row, payloads). Nulls become b''."""
    start, held, size = 0, [], 0
    binary = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for i, value in enumerate(binary):
        raw = value.as_py() or b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """64-bit key of a row's content. With the id it tells rows apart that share an id; equal rows share it on purpose."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(u, v) -> (node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a group-by without a list per
    node (minima by aggregation, then a join that adaptive execution splits when a node is hot), and each round is
    written to the shared folder. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    cur = materialise(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct(), "cc")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots.join(stars, "node", "left_anti"))
