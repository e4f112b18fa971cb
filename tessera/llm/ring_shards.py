"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its text, so equal texts meet. Places are gathered into ``CELLS`` equal arcs; a cell
goes to the shard of the first virtual node clockwise that still has room for it, else on to the next. Texts whose copies
weigh much leave their cell and are placed on their own, whole: a text is cut into parts, by the hash of the row id, only
when its copies weigh more than one shard holds, or when no shard has room left for them. What is placed are cells, fewer
than ``HEAVY`` texts for each shard and their parts, and at most CELLS/8 lanes more: the size of that table follows CELLS
and the number of shards, not the input, so it alone is gathered and broadcast.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

SHARDS = 16
VIRTUAL_NODES = 256
CELLS = 1 << 14
#: A shard takes at most this many times the mean load.
SLACK = 1.001
#: A text is placed on its own if it weighs more than 1/HEAVY of a shard's mean load; one that exceeds a shard is cut into pieces of 1/PIECES of it.
HEAVY, PIECES = 64, 8


def place(loads: list[tuple[int, int]], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> list[int | None]:
    """Shards of units (ring position, load): clockwise from the position, past full shards; None where none has room.

    Units are placed from heavy to light by powers of two, those of one power in the order of the ring.
    """
    import xxhash

    ring = sorted((xxhash.xxh3_64_intdigest(b"node/%d/%d" % (s, v)), s) for s in range(shards) for v in range(virtual_nodes))
    spots = [p for p, _ in ring]
    room = -(-sum(load for _, load in loads) * slack // shards)
    held = [0] * shards
    out: list[int | None] = [None] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][1].bit_length(), loads[i])):
        position, load = loads[i]
        at, seen = bisect.bisect_left(spots, position), set()
        while len(seen) < shards:
            shard = ring[at % len(ring)][1]
            if shard not in seen and held[shard] + load <= room:
                held[shard] += load
                out[i] = shard
                break
            seen.add(shard)
            at += 1
    return out


def _spread(spot: int, part: int) -> int:
    """Ring position of a part: parts of a text are spread, else they fill their neighbours one after the other."""
    return (spot + part * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def shard_rows(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """Per row: id, size (UTF-8 bytes and 1), text_crc32, law 'bytes', shard, slot (gapless in a shard), grown_shard (null).

    Null text has size 1 and the checksum of no bytes; it is a text of its own, equal to the empty one. Rows with equal
    texts share a shard unless they weigh more than one, or more than any has left. Rows repeated as a whole take slots of
    their own. A single row larger than what any shard has left, such as a very long text, goes to the emptiest shard. Null
    ids are hashed like others. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("spot"),
        F.xxhash64(F.col(id_col), raw).alias("own"),
    ).withColumn("cell", F.shiftrightunsigned("spot", 64 - (CELLS.bit_length() - 1)).cast("int"))
    rows = materialise(rows, "sizes")
    cells = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = cells.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    heavy_load = (whole.bytes or 0) / (HEAVY * shards)
    # fewer than HEAVY * shards cells weigh so much, and fewer texts
    heavy_cells = cells.where(F.col("bytes") > heavy_load).select("cell")
    in_heavy = rows.join(F.broadcast(heavy_cells), "cell", "left_semi")
    heavy = in_heavy.groupBy("spot").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > heavy_load)
    parts = {r.spot: -(-r.bytes * PIECES * shards // whole.bytes) if r.bytes * shards > whole.bytes else 1 for r in heavy.collect()}

    for _ in range(3):
        cut = spark.createDataFrame(list(parts.items()), "spot long, parts long")
        # lanes keep the sorted runs that number the slots short, whatever the number of copies
        lanes = cells.select("cell", F.ceil(F.col("n") * F.lit(CELLS) / F.lit(8 * (whole.n or 1))).cast("long").alias("lanes"))
        dealt = (
            rows.join(F.broadcast(cut), "spot", "left")
            .join(F.broadcast(lanes), "cell")
            .select(
                "doc_id",
                "size",
                "text_crc32",
                "cell",
                F.when(F.col("parts").isNotNull(), F.col("spot")).alias("heavy"),
                F.when(F.col("parts") > 1, F.pmod("own", "parts")).otherwise(F.lit(0)).alias("part"),
                F.pmod(F.shiftrightunsigned("own", 24), F.ceil(F.col("lanes") / F.coalesce("parts", F.lit(1)))).cast("long").alias("lane"),
            )
        )
        found = dealt.groupBy("cell", "heavy", "part", "lane").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        units: dict[tuple, list] = {}
        for u in sorted(found, key=lambda u: (u.cell, u.heavy is not None, u.heavy or 0, u.part, u.lane)):
            units.setdefault((u.cell, u.heavy, u.part), []).append(u)
        keys = list(units)
        loads = [(_spread(h & ((1 << 64) - 1) if h is not None else c << 50, p), sum(u.bytes for u in units[c, h, p])) for c, h, p in keys]
        chosen = place(loads, shards, slack=slack)
        left = {h for (_, h, _), shard in zip(keys, chosen, strict=True) if shard is None and h is not None}
        copies = dict.fromkeys(left, 0)
        for key in keys:
            if key[1] in left:
                copies[key[1]] += sum(u.n for u in units[key])
        again = {h: parts[h] * PIECES for h in left if copies[h] > parts[h]}
        if not again:
            break
        parts |= again

    held = [0] * shards
    for (_, load), shard in zip(loads, chosen, strict=True):
        if shard is not None:
            held[shard] += load
    start = [0] * shards
    plan = []
    for key, (_, load), shard in zip(keys, loads, chosen, strict=True):
        if shard is None:  # a single row, or a cell of light texts: the emptiest shard takes it
            shard = min(range(shards), key=held.__getitem__)
            held[shard] += load
        for u in units[key]:
            plan.append((*key, u.lane, shard, start[shard]))
            start[shard] += u.n
    placed = dealt.join(
        F.broadcast(spark.createDataFrame(plan, "_cell int, _heavy long, _part long, _lane long, shard int, start long")),
        (F.col("cell") == F.col("_cell")) & F.col("heavy").eqNullSafe(F.col("_heavy")) & (F.col("part") == F.col("_part")) & (F.col("lane") == F.col("_lane")),
    )
    order = Window.partitionBy("cell", "heavy", "part", "lane").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_ring_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law `bytes`, see shard_rows."""
    return shard_rows(table(spark, sf_dir, "documents"))
