"""Nodes, edges and chains (GRF-01..12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_hash
from tessera.operators.relational import top_one
from tessera.scratch import materialise

#: Levels of kinds and kinds of relations.
LEVELS = {"land": 0, "building": 1, "structure": 1, "ons": 1, "bu": 1, "room": 2, "accessory": 2, "equipment": 2, "device": 2, "level": 2}
EDGE_KINDS = {"OWNS": "owns", "LEASES": "leases", "CONTAINS": "contains", "CONTROLS": "controls", "INSIDE": "contains", "LOCATED_ON": "contains", "MORTGAGED_BY": "encumbrance", "ARRESTED_BY": "encumbrance", "RESTRICTED_BY": "restriction"}
RELATIONS = {"ownership": "OWNS", "lease": "LEASES", "sublease": "LEASES", "mortgage": "MORTGAGED_BY", "pledge": "MORTGAGED_BY", "arrest": "ARRESTED_BY", "prohibition": "ARRESTED_BY"}


def lookup(column: Column, labels: dict, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), column)
    return found if default is None else F.coalesce(found, default)


def nodes(frame: DataFrame, key: Column, kind: str, level: int, label: Column) -> DataFrame:
    """GRF-01: rows (id, kind, level, label); the id carries its kind."""
    return frame.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("id"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), label.cast("string").alias("label"))


def edges(frame: DataFrame, source: Column, source_kind: str, target: Column, target_kind: str, kind: str) -> DataFrame:
    return frame.where(source.isNotNull() & target.isNotNull()).select(F.concat(F.lit(f"{source_kind}:"), source.cast("string")).alias("src"), F.concat(F.lit(f"{target_kind}:"), target.cast("string")).alias("dst"), F.lit(kind).alias("kind"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_parent(node_rows: DataFrame, edge_rows: DataFrame, kind: str = "contains", top_level: int = 0) -> DataFrame:
    """GRF-01: nodes below the top that nothing contains."""
    return node_rows.where(F.col("level") > top_level).join(edge_rows.where(F.col("kind") == kind).select(F.col("dst").alias("id")), "id", "left_anti")


def around(edge_rows: DataFrame, centres: DataFrame, hops: int = 2) -> DataFrame:
    """GRF-02: edges within so many hops from the centres (id), in the direction of the edges."""
    reached, found = centres.select(F.col("id").alias("src")), None
    for _ in range(hops):
        step = edge_rows.join(reached.distinct(), "src")
        found = step if found is None else found.unionByName(step)
        reached = step.select(F.col("dst").alias("src"))
    return found.distinct()


def with_labels(node_ids: DataFrame, labels: DataFrame) -> DataFrame:
    """GRF-02: distinct nodes with their label, or the id where there is none (degraded)."""
    out = node_ids.select("id").distinct().join(labels.groupBy("id").agg(F.min("label").alias("_l")), "id", "left")
    return out.select("id", F.coalesce("_l", "id").alias("label"), F.col("_l").isNull().alias("degraded"))


def emit(entities: DataFrame, relations: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-03: (nodes, edges) of entities(id, node_id, kind, label), relations(id, from_id, to_id, code) and assertions(relation_id, confidence, status)."""
    best = assertions.where("status = 'active'").groupBy(F.col("relation_id").alias("id")).agg(F.max("confidence").alias("confidence"))
    n = entities.select(F.col("node_id").alias("id"), "kind", lookup(F.col("kind"), LEVELS).alias("level"), "label")
    a, b = entities.select(F.col("id").alias("from_id"), F.col("node_id").alias("src")), entities.select(F.col("id").alias("to_id"), F.col("node_id").alias("dst"))
    e = relations.join(a, "from_id").join(b, "to_id").join(best, "id", "left").select("src", "dst", lookup(F.col("code"), EDGE_KINDS, F.lower("code")).alias("kind"), "confidence")
    return n, e


def stubs(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """GRF-04: nodes for ids that only edges name."""
    ends = edge_rows.select(F.col("src").alias("id")).unionByName(edge_rows.select(F.col("dst").alias("id"))).distinct()
    return ends.join(node_rows.select("id"), "id", "left_anti").select("id", F.lit("stub").alias("kind"))


def undirected(edge_rows: DataFrame, preferred: Column | None = None) -> DataFrame:
    """GRF-04: one edge of each kind between two nodes; the preferred direction first, else the smaller id as source."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    rank = F.when(preferred, 0).otherwise(1) if preferred is not None else F.when(F.col("src") == low, 0).otherwise(1)
    keyed = edge_rows.where("src <> dst").withColumns({"_lo": low, "_hi": high, "_r": rank})
    return top_one(keyed, ["_lo", "_hi", "kind"], [F.col("_r"), F.col("src")]).drop("_lo", "_hi", "_r")


def node_index(frame: DataFrame, key: str, locals_: list[str]) -> DataFrame:
    """GRF-05: (local, id): each local key of a node, the smallest id where several share one."""
    flat = frame.select(F.col(key), F.explode(F.filter(F.array(*(F.col(c).cast("string") for c in locals_)), lambda x: x.isNotNull())).alias("local"))
    return flat.groupBy("local").agg(F.min(key).alias("id"))


def chains(parents: DataFrame, starts: DataFrame, node: str, parent: str, stop: str) -> DataFrame:
    """GRF-06: from each start up its parents to the first node that stops: (start, found, path, depth); cycles end a walk.

    Walks are joined with walks: each round doubles their length, so a chain of any depth takes as many joins as its depth
    has binary digits. Each round is written to the shared folder.
    """
    up = parents.select(F.col(node).alias("start"), F.col(parent).alias("next"), F.col(stop).alias("_stop"))
    own = F.array("start").alias("path")
    done = up.where("_stop").select("start", F.col("start").alias("found"), own).distinct()
    walk = materialise(up.where("not _stop and next is not null and next <> start").select("start", "next", own).distinct(), "chains")
    while not walk.isEmpty():
        known = done.select("start", "found", F.lit(None).cast(walk.schema["next"].dataType).alias("next"), "path").unionByName(walk.withColumn("found", F.lit(None).cast(done.schema["found"].dataType)))
        ahead = known.select(F.col("start").alias("_at"), F.col("found").alias("_found"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        met = walk.join(ahead, F.col("next") == F.col("_at")).where(~F.arrays_overlap("path", "_path"))
        met = materialise(met.select("start", "_found", "_next", F.concat("path", "_path").alias("path")), "chains")
        done = done.unionByName(met.where("_found is not null").select("start", F.col("_found").alias("found"), "path"))
        walk = met.where("_next is not null and not array_contains(path, _next)").select("start", F.col("_next").alias("next"), "path")
    wanted = starts.select(F.col(node).alias("start")).distinct()
    return done.join(wanted, "start").select("start", "found", "path", (F.size("path") - 1).alias("depth"))


def chains_recursive(spark, view: str, node: str, parent: str, stop: str) -> DataFrame:
    """GRF-06 as a recursive query over a registered view; only a stop, a cycle or a missing parent ends a walk. The session's
    limits of rows and levels for recursion are lifted while it runs (the rows are at most the nodes times the depth): the
    result is written."""
    walks = f"""
        WITH RECURSIVE up(start, at, path, depth, hit, next) AS (
          SELECT {node}, {node}, array({node}), 0, {stop}, {parent} FROM {view}
          UNION ALL
          SELECT u.start, v.{node}, concat(u.path, array(v.{node})), u.depth + 1, v.{stop}, v.{parent}
          FROM up u JOIN {view} v ON v.{node} = u.next
          WHERE NOT u.hit AND NOT array_contains(u.path, v.{node}))
        SELECT start, at AS found, path, depth FROM up WHERE hit"""
    limits = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k in limits:
            spark.conf.set(k, "-1")
        return materialise(spark.sql(walks), "chains")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def pledge_holders(by_right: DataFrame, by_register: DataFrame, entities: DataFrame, inn: str = "inn") -> DataFrame:
    """GRF-07: keys of all who hold a pledge, from two sources by tax id."""
    ids = by_right.select(inn).unionByName(by_register.select(inn)).where(F.col(inn).isNotNull()).distinct()
    return ids.join(entities.select(inn, "key"), inn, "left").select(F.coalesce("key", F.concat(F.lit("legal::inn::"), inn)).alias("key")).distinct()


def founder_edges(links: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-08: (edges, placeholder nodes) of links(founder, company, kind); an edge is there once, unknown ends get a node."""
    e = links.select(F.col("founder").alias("src"), F.col("company").alias("dst"), "kind").where("src is not null and dst is not null").distinct()
    return e, stubs(e, known)


def placemark_graph(places: DataFrame) -> DataFrame:
    """GRF-09: edges of placemarks(id, parent_id, owner_id): part_of and belongs_to."""
    part = places.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit("part_of").alias("kind"))
    own = places.where("owner_id is not null").select(F.col("id").alias("src"), F.col("owner_id").alias("dst"), F.lit("belongs_to").alias("kind"))
    return part.unionByName(own)


def path_tree(paths: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """GRF-10: every beginning of a path is a node: (id, path, parent_id, depth)."""
    parts = F.filter(F.split(F.col(column), sep), lambda x: x != "")
    begin = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", F.lit(1), i), sep))
    flat = paths.select(parts.alias("_p")).where(F.size("_p") > 0).distinct().select(F.posexplode(begin).alias("depth", "path")).distinct()
    up = F.when(F.col("depth") > 0, F.regexp_replace("path", f"{sep}[^{sep}]*$", ""))
    return flat.select(F.sha1("path").alias("id"), "path", F.sha1(up).alias("parent_id"), "depth")


def relation_code(right: Column) -> Column:
    """GRF-11/12: the relation of a right's code; other rights restrict."""
    return lookup(right, RELATIONS, F.lit("RESTRICTED_BY"))


def right_edges(rights: DataFrame, holders: DataFrame, key: str) -> DataFrame:
    """GRF-12: edges from holders of a right, or from its beneficiary where it has no holder."""
    joined = rights.join(holders.select(key, "holder"), key, "left")
    who = F.coalesce("holder", "beneficiary")
    return joined.where(who.isNotNull()).select(who.alias("src"), F.col("object").alias("dst"), relation_code(F.col("right_type")).alias("code")).distinct()


def local_id(*parts: Column) -> Column:
    """Ids of nodes without one of their own."""
    return stable_hash(*parts, length=12)


def edge_rank(kind: str) -> Column:
    return F.row_number().over(Window.partitionBy(kind).orderBy("src", "dst"))
