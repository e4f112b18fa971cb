"""As-of states, replayed effects, conflicts and balances (TMP-01..08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import open_at
from tessera.operators.relational import top_one, valid_at


def latest_base(documents: DataFrame, key: str, day: str, is_extract: Column, at: Column) -> DataFrame:
    """TMP-01: (key, base day): the last extract by then."""
    return documents.where(is_extract & (F.col(day) <= at)).groupBy(key).agg(F.max(day).alias("base"))


def overlays(documents: DataFrame, bases: DataFrame, key: str, day: str, is_extract: Column, at: Column) -> DataFrame:
    """TMP-01: documents after a key's base and up to the moment; keys without a base have none."""
    return documents.where(~is_extract & (F.col(day) <= at)).join(bases, key).where(F.col(day) > F.col("base"))


def replay(base: DataFrame, effects: DataFrame, key: str, items: str, order: list[str], op: str, match: str, value: str) -> DataFrame:
    """TMP-01: an array of struct(id, value) after the effects in order.

    add appends (match, value); remove drops items whose id matches; change sets the value of those. Keys without effects
    keep their items; effects of keys that have no row are left out.
    """
    steps = effects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(op).alias("_op"), F.col(match).alias("_m"), F.col(value).alias("_v")))).alias("_steps"))
    out = base.join(steps, key, "left")
    item = base.schema[items].dataType.elementType
    make = lambda i, v: F.struct(i.cast(item["id"].dataType).alias("id"), v.cast(item["value"].dataType).alias("value"))

    def step(state: Column, e: Column) -> Column:
        return (
            F.when(e["_op"] == "add", F.concat(state, F.array(make(e["_m"], e["_v"]))))
            .when(e["_op"] == "remove", F.filter(state, lambda x: ~x["id"].eqNullSafe(e["_m"])))
            .when(e["_op"] == "change", F.transform(state, lambda x: F.when(x["id"].eqNullSafe(e["_m"]), make(x["id"], e["_v"])).otherwise(make(x["id"], x["value"]))))
            .otherwise(state)
        )

    start = F.coalesce(items, F.array().cast(base.schema[items].dataType))
    return out.withColumn(items, F.when(F.col("_steps").isNull(), start).otherwise(F.aggregate("_steps", start, step))).drop("_steps")


def active_tags(tags: DataFrame, at: Column, since: str = "since", until: str = "until", default: str | None = None) -> DataFrame:
    """TMP-02: tags that hold at the moment; a tag without a start takes its document's day."""
    start = F.coalesce(since, default) if default else F.col(since)
    return tags.where(open_at(start, F.col(until), at))


def geo_snapshot(links: DataFrame, points: DataFrame, contours: DataFrame, at: Column, asset: str = "asset_id", geo: str = "geo_uuid") -> DataFrame:
    """TMP-03: each asset's places at the moment with the last point and the last contour that hold."""
    now = links.where(open_at(F.col("valid_from"), F.col("valid_to"), at)).select(asset, geo, "role")
    point = valid_at(points, geo, "valid_from", "valid_to", at, [F.col("lat"), F.col("lon")]).select(geo, "lat", "lon")
    contour = valid_at(contours, geo, "valid_from", "valid_to", at, [F.col("geometry")]).select(geo, "geometry")
    return now.join(point, geo, "left").join(contour, geo, "left")


def resolve_conflicts(facts: DataFrame, path: str, value: str, day: str, level: str, tie: str) -> DataFrame:
    """TMP-05: paths with different values: newest wins; of several newest a single registered (level 1) one wins, else none.

    (path, winner, resolution): newer_wins, registered_wins or unresolved.
    """
    w = Window.partitionBy(path)
    newest = facts.withColumn("_newest", F.max(day).over(w))
    is_newest = F.col(day) == F.col("_newest")
    registered = is_newest & (F.col(level) == 1)
    out = newest.groupBy(path).agg(
        F.count("*").alias("_facts"),
        F.count_distinct(value).alias("_values"),
        F.count_if(is_newest).alias("_n"),
        F.count_if(registered).alias("_r"),
        F.min_by(value, F.when(is_newest, F.col(tie))).alias("_new"),
        F.min_by(value, F.when(registered, F.col(tie))).alias("_reg"),
    )
    kind = F.when(F.col("_n") == 1, "newer_wins").when(F.col("_r") == 1, "registered_wins").otherwise("unresolved")
    winner = F.when(F.col("_n") == 1, F.col("_new")).when(F.col("_r") == 1, F.col("_reg"))
    return out.where("_facts >= 2 and _values >= 2").select(path, winner.alias("winner"), kind.alias("resolution"))


def current(edges: DataFrame, superseded: str = "superseded_at") -> DataFrame:
    """TMP-06."""
    return edges.where(F.col(superseded).isNull())


def balance(flows: DataFrame, key: str, order: list[str], amount: str, inward: Column, out: str = "level") -> DataFrame:
    """TMP-07: the running level of each key."""
    signed = F.when(inward, F.col(amount)).otherwise(-F.col(amount))
    return flows.withColumn(out, F.sum(signed).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def season(harvest: Column) -> Column:
    """TMP-08: a crop belongs to its harvest's year."""
    return F.year(harvest)


def plan_and_fact(cycles: DataFrame, keys: list[str], kind: str, amount: str, known_from: str, at: Column) -> DataFrame:
    """TMP-08: plan and fact of each season side by side, each the last one known at the moment."""
    known = top_one(cycles.where(F.col(known_from) <= at), [*keys, kind], [F.col(known_from).desc(), F.col(amount)])
    value = lambda k: F.max(F.when(F.col(kind) == k, F.col(amount))).alias(k)
    return known.groupBy(*keys).agg(value("plan"), value("fact"))


def as_of_view(objects: DataFrame, rights: DataFrame, restrictions: DataFrame, extracts: DataFrame, at: Column, key: str) -> DataFrame:
    """TMP-04: an object with its rights, restrictions and last extract as known at the moment; a right without a date passes."""
    r = rights.where(F.col("day").isNull() | (F.col("day") <= at)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "number", "holder"))).alias("rights"))
    s = restrictions.where(open_at(F.col("valid_from"), F.col("valid_to"), at)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("valid_from", "kind"))).alias("restrictions"))
    e = extracts.where(F.col("extract_date") <= at).groupBy(key).agg(F.max("extract_date").alias("extract_date"))
    return objects.join(r, key, "left").join(s, key, "left").join(e, key, "left")


def lot_view(items: DataFrame, objects: DataFrame, lot: str, key: str, order: str) -> DataFrame:
    """TMP-04, JON-20: a lot's members in order."""
    rows = items.join(objects, key, "left")
    fields = [c for c in objects.columns if c != key]
    return rows.groupBy(lot).agg(F.array_sort(F.collect_list(F.struct(order, key, *fields))).alias("members"))
