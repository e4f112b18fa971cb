"""Aggregates of registry data (AGG-01..20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import ranked


def latest(df: DataFrame, key: str, day: str, out: str = "latest") -> DataFrame:
    """AGG-01."""
    return df.where(F.col(day).isNotNull()).groupBy(key).agg(F.max(day).alias(out))


def joined(column: str, order: str | None = None, sep: str = "; ") -> Column:
    """AGG-02: texts in order, NULLs left out; nothing gives NULL."""
    items = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(order or column).alias("o"), F.col(column).alias("v")))))
    return F.nullif(F.array_join(F.transform(items, lambda x: x.v), sep), F.lit(""))


def named_with_id(name: Column, inn: Column) -> Column:
    """AGG-02: a holder with its tax id, where it has one."""
    return F.concat(name, F.coalesce(F.concat(F.lit(" ИНН "), inn), F.lit("")))


def counts_by(column: str, values: list[str], prefix: str = "n_") -> list[Column]:
    """AGG-03."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v.strip().lower().replace(' ', '_').replace('-', '_')}") for v in values]


def direct_owner(df: DataFrame, key: str, owner: str, ratio: str, tolerance: float = 1e-9) -> DataFrame:
    """AGG-04: the owner with the largest share; shares within the tolerance are equal, then the smallest id counts."""
    top = df.groupBy(key).agg(F.max(ratio).alias("_top"))
    near = df.join(top, key).where(F.col("_top") - F.col(ratio) <= tolerance)
    return near.groupBy(key).agg(F.min(owner).alias(owner), F.max("_top").alias(ratio))


#: Weights of evidence.
SOURCE_WEIGHTS = {"egrn": 0.9, "nspd": 0.7, "osv": 0.6, "manual": 0.5}


def noisy_or(weight: Column) -> Column:
    """AGG-05: 1 - product of (1 - weight), weights clipped to [0, 1], to four places."""
    clipped = F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))
    return F.round(1 - F.product(1 - clipped), 4)


def active_confidence(assertions: DataFrame, key: str, confidence: str, status: str, active: str = "active") -> DataFrame:
    """AGG-06."""
    return assertions.where(F.col(status) == active).groupBy(key).agg(F.max(confidence).alias(confidence))


def kind_counts(df: DataFrame, kind: str) -> DataFrame:
    """AGG-07: one row with a map of counts."""
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def statistics(df: DataFrame, day: str, flags: dict[str, Column]) -> DataFrame:
    """AGG-08."""
    return df.agg(F.count("*").alias("rows"), F.max(day).alias("latest"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()))


def sums_where(conditions: dict[str, Column]) -> list[Column]:
    """AGG-09."""
    return [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]


def first_seen(value: str, order: str) -> Column:
    """AGG-10: distinct values in the order of their first row."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x.v))


def sorted_set(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def grouped(df: DataFrame, key: Column, out: str, missing: str = "— без адреса —", last: str | None = None) -> DataFrame:
    """AGG-11/12: (group, size, place): groups from large to small; those without a key near the end, `last` at the end."""
    named = df.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(missing)).alias(out)).agg(F.count("*").alias("size"))
    rank = F.when(F.col(out) == F.lit(last), 2).when(F.col(out) == missing, 1).otherwise(0)
    return ranked(named.withColumn("_rank", rank), [F.col("_rank"), F.desc("size"), F.col(out)], "place").drop("_rank")


def anchors(df: DataFrame, group: str, key: str) -> DataFrame:
    """AGG-13."""
    return df.groupBy(group).agg(F.min(key).alias("anchor"))


def conflicts(facts: DataFrame, path: str, value: Column) -> DataFrame:
    """AGG-14: paths with two facts or more that state different values."""
    return facts.groupBy(path).agg(F.count("*").alias("facts"), F.count_distinct(value).alias("distinct_values")).where("facts >= 2 and distinct_values >= 2")


def floors_from_parts(parents: DataFrame, parts: DataFrame, key: str, floors: str, part_parent: str, part_floors: str, part_key: str) -> DataFrame:
    """AGG-15: a parent without floors takes the largest of its parts, with the parts that state it."""
    top = parts.groupBy(F.col(part_parent).alias("_p")).agg(F.max(part_floors).alias("_top"))
    who = parts.join(top, F.col(part_parent) == F.col("_p")).where(F.col(part_floors) == F.col("_top")).groupBy("_p", "_top").agg(sorted_set(part_key).alias("_from"))
    need = F.coalesce(F.col(floors), F.lit(0)) <= 0
    return parents.join(who, F.col(key) == F.col("_p"), "left").withColumn("floors_from", F.when(need, F.col("_from"))).withColumn(floors, F.when(need, F.coalesce("_top", floors)).otherwise(F.col(floors))).drop("_p", "_top", "_from")


def log_size(df: DataFrame, category: str, amount: str, out: str, low: int = 14, span: int = 22, default: int = 22) -> DataFrame:
    """AGG-16: sizes from low to low+span on a log scale of the category; one value or none gives the default."""
    log = F.when(F.col(amount) > 0, F.ln(F.col(amount)))
    bounds = df.groupBy(category).agg(F.min(log).alias("_lo"), F.max(log).alias("_hi"))
    size = F.round(low + span * (log - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("int")
    return df.join(bounds, category).withColumn(out, F.when(log.isNotNull() & (F.col("_hi") > F.col("_lo")), size).otherwise(F.lit(default))).drop("_lo", "_hi")


def pledge_class(own: Column, parent: Column, share: Column) -> Column:
    """AGG-18: whose pledge it is: the object's, an owner's shares, both, or none."""
    by_share = parent | share
    return F.when(own & by_share, "both").when(own, "object").when(by_share, "shares").otherwise("none")


def unit_points(units: DataFrame, unit: str, objects: str, owners: str, places: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """AGG-20: (owner, unit, lon, lat): the mean of a unit's object points, for each tax id of it."""
    points = units.select(unit, F.explode(objects).alias(key)).join(places.select(key, lon, lat), key)
    mean = points.groupBy(unit).agg(F.avg(lon).alias(lon), F.avg(lat).alias(lat))
    return units.select(unit, F.explode(owners).alias("owner")).join(mean, unit).select("owner", unit, lon, lat)
