"""Near-duplicate vectors by tiles of int8 products with error bounds, recomputed in double precision only near the threshold.

Equal vectors are one class. Classes are dealt to cells around pivots and cells to tiles of about ``TILE`` classes. Two tiles
meet unless the angle between their pivots, less both cells' radii, proves that no pair can reach the threshold. In a pair
of tiles, unit vectors u, v stand as s*q + error with integers q of one byte: |u.v - s_u s_v q_u.q_v| <= e_u + e_v + e_u e_v,
where e is the length of a vector's own error. Only q, s and e travel to the pairs of tiles. Pairs surely above or below
are settled by them; the vectors of other pairs come in double precision to a second pass, which computes those pairs.
A pair of tiles returns sums of links and a spanning forest of its links, at most one edge for each class, never all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialise, table, tidied

THRESHOLD = 0.95
TILE = 4096
#: Pivots follow the number of tiles up to this bound, so that they fit every task.
PIVOTS = 1024
ROWS_AT_ONCE = 256


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes (doubles) of each usable vector; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for v in batch["embedding"]:
            items = v.values if v.is_valid else None
            if items is None or items.null_count or not len(items):
                out.append(None)
                continue
            a = items.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
            out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], names=["vec_id", "raw"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(pivots: dict[int, bytes]):
    """The nearest pivot of each class and the angle to it, among pivots of its dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = {n: _unit([r for _, r in own]) for n in {len(r) for r in pivots.values()} if (own := [(i, r) for i, r in pivots.items() if len(r) == n])}
        names = {n: np.array([i for i, r in pivots.items() if len(r) == n]) for n in units}
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            raws = batch["raw"].to_pylist()
            lens = np.fromiter(map(len, raws), np.int64, len(raws))
            for n in np.unique(lens).tolist():
                at = np.flatnonzero(lens == n)
                if n not in units:
                    cell[at] = -1 - n  # a dimension without a pivot is a cell of its own
                    angle[at] = np.pi
                    continue
                cos = _unit([raws[i] for i in at]) @ units[n].T
                best = cos.argmax(axis=1)
                cell[at], angle[at] = names[n][best], np.arccos(np.clip(cos[np.arange(len(at)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return run


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e): whole numbers of one byte, the scale, and a bound on the length of u - s*q."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - q * s[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q.astype(np.int8), s, e


def rough_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of the pairs of rows that may reach the threshold; sure where the error bound leaves no doubt."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # products of one-byte numbers add up exactly in float32 below 2**24, in float64 for longer vectors
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rough = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + 1e-9
    i, j = np.nonzero(rough + bound >= threshold)
    return i, j, (rough[i, j] - bound[i, j]) >= threshold


def open_links(u: np.ndarray, v: np.ndarray, a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the error bound leaves open and whose cosine in double precision is >= threshold."""
    i, j, sure = rough_pairs(a, b, threshold)
    i, j = i[~sure], j[~sure]
    linked = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        some = slice(at, at + 100_000)
        linked[some] = (u[i[some]] * v[j[some]]).sum(axis=1) >= threshold
    return i[linked], j[linked]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (label[label] != label).any():
            label = label[label]


_TILE = "cell long, tile string, nodes array<long>, weights array<long>, q binary, s binary, e binary"


def _tile(key: tuple, group: pa.Table) -> pa.Table:
    cell, part = (k.as_py() for k in key)
    q, s, e = quantised(_unit(group["raw"].to_pylist()))
    row = {"cell": cell, "tile": f"{cell}/{part}", "nodes": group["node"].to_pylist(), "weights": group["weight"].to_pylist(), "q": q.tobytes(), "s": s.tobytes(), "e": e.tobytes()}
    kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *(pa.binary(),) * 3)
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


class _Forest:
    """Sums of links and a spanning forest over the classes of one pair of tiles (or of one with itself)."""

    def __init__(self, left: np.ndarray, right: np.ndarray | None, wx: np.ndarray, wy: np.ndarray):
        self.itself = right is None
        self.nodes = left if self.itself else np.concatenate([left, right])
        self.shift = 0 if self.itself else len(left)
        self.wx, self.wy = wx, wx if self.itself else wy
        self.links, self.label = np.zeros(len(self.nodes)), np.arange(len(self.nodes))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.nodes)
        if self.itself:
            i, j = i[i != j], j[i != j]
        self.links += np.bincount(i, weights=self.wy[j], minlength=n)
        if not self.itself:
            self.links += np.bincount(j + self.shift, weights=self.wx[i], minlength=n)
        self.label = _join_labels(self.label, i, j + self.shift)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.flatnonzero(self.links)
        return self.nodes[out], self.links[out].astype(np.int64), self.nodes[self.label[out]]


_LINK = "node long, links long, root long, a string, b string, right boolean"
_LINK_NAMES = [c.split()[0] for c in _LINK.split(", ")]


def _sure_links(threshold: float):
    """For each row (a pair of tiles): links of each class in it by the other side's weights, its root, and the classes of open pairs."""

    def side(row: dict, name: str) -> tuple:
        nodes = np.array(row[f"nodes_{name}"], np.int64)
        s, e = (np.frombuffer(row[f"{c}_{name}"], np.float64) for c in "se")
        return nodes, np.array(row[f"weights_{name}"], np.int64), (np.frombuffer(row[f"q_{name}"], np.int8).reshape(len(nodes), -1), s, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                itself = row["a"] == row["b"]
                nx, wx, x = side(row, "a")
                ny, wy, y = (nx, wx, x) if itself else side(row, "b")
                if x[0].shape[1] != y[0].shape[1]:
                    continue
                forest = _Forest(nx, None if itself else ny, wx, wy)
                open_x, open_y = np.zeros(len(nx), bool), np.zeros(len(ny), bool)
                for lo in range(0, len(nx), ROWS_AT_ONCE):
                    i, j, sure = rough_pairs(tuple(c[lo : lo + ROWS_AT_ONCE] for c in x), y, threshold)
                    i = i + lo
                    forest.add(i[sure], j[sure])
                    doubt = ~sure & ((i != j) if itself else True)
                    open_x[i[doubt]] = True
                    open_y[j[doubt]] = True
                node, links, root = forest.rows()
                out = [(pa.array(node), pa.array(links), pa.array(root), pa.nulls(len(node), pa.string()), pa.nulls(len(node), pa.string()), pa.nulls(len(node), pa.bool_()))]
                for right, nodes, some in ((False, nx, open_x | open_y if itself else open_x), *(() if itself else ((True, ny, open_y),))):
                    n = int(some.sum())
                    out.append((pa.array(nodes[some]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array([row[c]] * n, pa.string()) for c in "ab"), pa.array(np.full(n, right))))
                for cols in out:
                    if len(cols[0]):
                        yield pa.RecordBatch.from_arrays(list(cols), names=_LINK_NAMES)

    return run


def _open_links(threshold: float):
    """The same for the open pairs: rows (a, b, right, node, weight, raw) that arrive sorted by pair of tiles."""

    def settle(held: pa.Table) -> pa.RecordBatch | None:
        right = held["right"].to_numpy()
        itself = held["a"][0].as_py() == held["b"][0].as_py()
        nodes, weights, raws = held["node"].to_numpy(), held["weight"].to_numpy(), held["raw"].to_pylist()
        u = _unit([r for r, on in zip(raws, right, strict=True) if not on])
        v = u if itself else _unit([r for r, on in zip(raws, right, strict=True) if on])
        qu = quantised(u)
        qv = qu if itself else quantised(v)
        forest = _Forest(nodes[~right], None if itself else nodes[right], weights[~right], weights[right])
        for lo in range(0, len(u), ROWS_AT_ONCE):
            part = slice(lo, lo + ROWS_AT_ONCE)
            i, j = open_links(u[part], v, tuple(c[part] for c in qu), qv, threshold)
            forest.add(i + lo, j)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest.rows()], names=_LINK_NAMES[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = [f"{a} {b}" for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                piece = batch.slice(lo, hi - lo)
                if held and (held[-1]["a"][0], held[-1]["b"][0]) != (piece["a"][0], piece["b"][0]):
                    yield settle(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if hi > lo:
                    held.append(piece)
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _near_cells(met: list, chosen: dict[int, bytes], threshold: float) -> list[tuple[int, int]]:
    """Pairs of cells that may hold a pair of vectors above the threshold, either way round."""
    out = [(x.cell, x.cell) for x in met if x.cell < 0]
    for size in {len(r) for r in chosen.values()}:
        own = [x for x in met if x.cell >= 0 and len(chosen[x.cell]) == size]
        if own:
            units = _unit([chosen[x.cell] for x in own])
            radius = np.array([x.radius for x in own])
            gap = np.arccos(np.clip(units @ units.T, -1, 1)) - radius[:, None] - radius[None, :]
            np.fill_diagonal(gap, -1)
            out += [(own[i].cell, own[j].cell) for i, j in zip(*np.nonzero(gap <= np.arccos(threshold) + 1e-6), strict=True)]
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    dimensions link. Equal vectors link with each other. A null id is never the smallest. Other columns are not read; an
    empty table gives no rows.
    """
    spark = df.sparkSession
    raws = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(tidied(_raw), "vec_id long, raw binary")
    for seed in range(8):
        rows = materialise(raws.withColumn("node", F.when(F.col("raw").isNotNull(), F.xxhash64("raw", F.lit(seed)))), "vectors")
        classes = rows.where("raw is not null").groupBy("node", "raw").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
        classes = materialise(classes, "classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            break  # else two vectors share a hash and all are named anew
    else:
        raise RuntimeError("vectors share hashes")
    # as many pivots as tiles are wanted, from classes in order of their hash: a sample of at most PIVOTS vectors
    k = min(pivots, classes.count() // tile + 1)
    chosen = {i: bytes(r.raw) for i, r in enumerate(classes.select("node", "raw").orderBy("node").limit(k).collect())}
    celled = materialise(classes.select("node", "raw", "weight").mapInArrow(_cells(chosen), "node long, raw binary, weight long, cell long, angle double"), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"), F.max("angle").alias("radius"))
    met = sizes.collect()  # a row for each pivot
    tiled = celled.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    tiles = materialise(tiled.select("cell", "part", "node", "weight", "raw").groupBy("cell", "part").applyInArrow(_tile, _TILE), "tiles")
    near = spark.createDataFrame(_near_cells(met, chosen, threshold), "cell long, other long")
    names = tiles.select("cell", "tile")
    pairs = names.join(near, "cell").join(names.select(F.col("cell").alias("other"), F.col("tile").alias("b")), "other").where("tile <= b").select(F.col("tile").alias("a"), "b")
    for side in "ab":
        body = tiles.select(F.col("tile").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("nodes", "weights", "q", "s", "e")))
        # a tile with itself needs its other side only once
        pairs = pairs.join(body, side) if side == "a" else pairs.where("a = b").unionByName(pairs.where("a <> b").join(body, side), allowMissingColumns=True)
    found = materialise(pairs.repartition(F.col("a"), F.col("b")).mapInArrow(tidied(_sure_links(threshold)), _LINK), "links")
    open_ = found.where("a is not null").select("a", "b", "right", "node").join(classes.select("node", "weight", "raw"), "node")
    more = open_.repartition("a", "b").sortWithinPartitions("a", "b", "right", "node").mapInArrow(tidied(_open_links(threshold)), "node long, links long, root long")
    found = materialise(found.where("a is null").select("node", "links", "root").unionByName(more), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = classes.select("node", "weight", "vec_id").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = classes.join(smallest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def op6_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Links, components and kept rows of all vectors at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
