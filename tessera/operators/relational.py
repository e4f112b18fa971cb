"""Filters, joins and ordering helpers with columns as parameters (FLT, JON, WIN, SRT, SET)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialise


def contains_any(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """FLT-07: rows where one of the columns contains the query, whatever the case."""
    q = query.lower()
    return df.where(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(q) for c in columns)))


def ends_with_part(df: DataFrame, column: str, tail: str, sep: str = ":") -> DataFrame:
    """FLT-05: rows whose last part is the tail, as an equality that a join or a bucket can use."""
    return df.where(F.element_at(F.split(F.col(column), sep), -1) == tail)


def as_of(day: Column, at: Column) -> Column:
    """FLT-08: known by then; no date passes."""
    return day.isNull() | (day <= at)


def still_valid(until: Column, today: Column) -> Column:
    """FLT-09: the last day counts."""
    return until.isNull() | (until >= today)


def allowed(rows: DataFrame, grants: DataFrame, subject: str, now: Column, resource: str, superuser: bool = False, denied: list[str] | None = None) -> DataFrame:
    """FLT-13, JON-11: rows that the subject has a grant for that has not run out; a superuser sees all, denied ids never show."""
    rows = rows if not denied else rows.where(~F.col(resource).isin(denied))
    if superuser:
        return rows
    own = grants.where((F.col("subject") == subject) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select(F.col("resource_id").alias(resource))
    return rows.join(own, resource, "left_semi")


def excluded_files(df: DataFrame, name: str, patterns: list[str], content: str | None = None, marks: list[str] | None = None) -> DataFrame:
    """FLT-14: files without those that name or content rule out."""
    bad = reduce(lambda a, b: a | b, (F.lower(F.col(name)).rlike(p) for p in patterns))
    if content and marks:
        bad = bad | reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(content)).contains(m), F.lit(False)) for m in marks))
    return df.where(~F.coalesce(bad, F.lit(False)))


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-01/02/04/05: the first row of each key in an order that the caller makes total."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """SRT-04. A group limit runs before the shuffle, so a hot key sends n rows from each task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Places 1, 2, ... of all rows in an order that the caller makes total, without one task that sees them all.

    Rows are sorted by ranges; a row's place is its number inside its range and the sizes of the ranges before, of which
    there are as many as partitions.
    """
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, place).drop("_id", "_part", "_before")


def next_numbers(new: DataFrame, old: DataFrame, key: str, number: str, order: list[Column]) -> DataFrame:
    """WIN-03: new rows numbered on from the largest number that the key has."""
    last = old.groupBy(key).agg(F.max(number).alias("_last"))
    w = Window.partitionBy(key).orderBy(*order)
    return new.withColumn("_n", F.row_number().over(w)).join(last, key, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def changes(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """WIN-06: rows whose value is not that of the row before; the first counts."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")


def carried(df: DataFrame, key: str, marker: str, order: list[str], out: str) -> DataFrame:
    """WIN-07: the last marker so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def with_fallback(left: DataFrame, on: str, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """JON-06: the parent in the first table, else in the second, else unknown."""
    a = first.select(F.col(key).alias("_a"))
    b = second.select(F.col(key).alias("_b"))
    out = left.join(a, F.col(on) == F.col("_a"), "left").join(b, F.col(on) == F.col("_b"), "left")
    return out.withColumn("parent_kind", F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("unknown")).drop("_a", "_b")


def by_tail(left: DataFrame, tail: str, right: DataFrame, key: str, sep: str = ":", unique: bool = True) -> DataFrame:
    """JON-07/08: join on the last part of a key. unique: only where one row has it; else the smallest key."""
    named = right.select(F.col(key).alias("_key"), F.element_at(F.split(F.col(key), sep), -1).alias("_tail"))
    found = named.groupBy("_tail").agg(F.count("*").alias("_n"), F.min("_key").alias("matched"))
    if unique:
        found = found.where("_n = 1")
    return left.join(found, F.col(tail) == F.col("_tail"), "left").drop("_n", "_tail")


def orphans(rows: DataFrame, key: str, *parents: tuple[DataFrame, str]) -> DataFrame:
    """JON-09: rows whose key stands in none of the parents."""
    known = reduce(lambda a, b: a.unionByName(b), (p.select(F.col(c).alias(key)) for p, c in parents))
    return rows.join(known, key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """JON-10: (group, key, side): what stands on one side only, where key is one value or, as an array, any of its values."""
    flat = lambda d: d.select(group, F.explode_outer(key).alias("_k"), F.col(key).alias("_own")) if dict(d.dtypes)[key].startswith("array") else d.select(group, F.col(key).alias("_k"), F.col(key).alias("_own"))
    a, b = flat(left), flat(right)

    def missing(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        hits = x.join(y.select(group, "_k"), [group, "_k"], "left_semi").select(group, "_own").distinct()
        return x.select(group, "_own").distinct().join(hits, [group, "_own"], "left_anti").select(group, F.col("_own").alias(key), F.lit(side).alias("side"))

    return missing(a, b, "left").unionByName(missing(b, a, "right"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """JON-12: each left row with the last right row of its key at or before it.

    Both sides are put into one order per key and the last right row is carried on: one shuffle, no range join.
    """
    payload = F.struct(F.col(right_time), *columns)
    a = left.select("*", F.lit(1).alias("_side"), F.col(left_time).alias("_t"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    b = right.select(F.col(key), F.lit(0).alias("_side"), F.col(right_time).alias("_t"), payload.alias("_p"))
    both = a.unionByName(b, allowMissingColumns=True)
    # of right rows at one moment the one with the largest columns counts
    w = Window.partitionBy(key).orderBy("_t", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    carried_on = both.withColumn("_hit", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return carried_on.select(*left.columns, F.col(f"_hit.{right_time}").alias(f"matched_{right_time}"), *(F.col(f"_hit.{c}").alias(f"matched_{c}") for c in columns))


def valid_at(rows: DataFrame, key: str, since: str, until: str, at: Column, tie: list[Column] | None = None) -> DataFrame:
    """JON-12 within validity: the latest row of each key that holds at the moment (its end doesn't count)."""
    inside = rows.where((F.col(since).isNull() | (F.col(since) <= at)) & (F.col(until).isNull() | (F.col(until) > at)))
    return top_one(inside, [key], [F.col(since).desc_nulls_last(), *(tie or [])])


def remembered(candidates: DataFrame, decisions: DataFrame, key: str, value: str) -> DataFrame:
    """JON-15: a stored decision before the computed one."""
    return candidates.join(decisions.select(key, F.col(value).alias("_stored")), key, "left").withColumn("remembered", F.col("_stored").isNotNull()).withColumn(value, F.coalesce("_stored", value)).drop("_stored")


def first_found(left: DataFrame, lookups: list[tuple[str, DataFrame, str, str]], out: str) -> DataFrame:
    """JON-17/19/22/25: out is the value of the first lookup (left column, table, key, value) that has the key; tag says which."""
    tags = []
    for i, (column, table, key, value) in enumerate(lookups):
        # one row a key: the smallest value
        found = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        left = left.join(found, F.col(column) == F.col(f"_k{i}"), "left")
        tags.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(column)))
    n = len(lookups)
    return left.withColumn(out, F.coalesce(*(F.col(f"_v{i}") for i in range(n)))).withColumn(f"{out}_by", F.coalesce(*tags)).drop(*(f"_{p}{i}" for i in range(n) for p in "kv"))


def absorb(rows: DataFrame, ids: str, mapping: DataFrame, old: str, new: str, row_key: str) -> DataFrame:
    """JON-18: an array of ids with local ones replaced by external ones, in order, each once."""
    flat = rows.select(row_key, F.posexplode_outer(ids).alias("_at", "_id"))
    mapped = flat.join(mapping.select(F.col(old).alias("_id"), F.col(new).alias("_new")), "_id", "left")
    back = mapped.groupBy(row_key).agg(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_at", F.coalesce("_new", "_id").alias("v"))))).alias("_l"))
    return rows.drop(ids).join(back, row_key, "left").withColumn(ids, F.array_distinct(F.transform("_l", lambda x: x.v))).drop("_l")


def last_writer(left: DataFrame, on: Column, right: DataFrame, right_key: Column, order: list[Column], value: str) -> DataFrame:
    """JON-16: join on a computed key; of several right rows the last written one counts."""
    named = right.select(right_key.alias("_k"), F.col(value).alias(f"matched_{value}"), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    best = top_one(named, ["_k"], [F.col(f"_o{i}").desc() for i in range(len(order))]).select("_k", f"matched_{value}")
    return left.withColumn("_lk", on).join(best, F.col("_lk") == F.col("_k"), "left").drop("_lk", "_k")


#: Kinds of subjects that are no legal entities.
NOT_LEGAL = ("ip", "person", "Индивидуальный предприниматель", "Физическое лицо")


def enterprise_match(enterprises: DataFrame, name: str, subjects: DataFrame, key: str, full: str, short: str, kind: str, order: str) -> DataFrame:
    """JON-23: the first legal subject whose full or short name contains the enterprise's name or begins with its first ten letters.

    Pairs meet where the first letters (four at most) of the enterprise's name are a piece of the subject's, never all with all.
    """
    target = F.upper(F.coalesce(F.col(name), F.lit("")))
    begin = enterprises.select(F.col(name), target.alias("_t")).distinct().where("_t <> ''").withColumn("_b", F.substring("_t", 1, 4))
    legal = subjects.where(~F.coalesce(F.col(kind), F.lit("")).isin(*NOT_LEGAL)).select(F.col(key), F.col(order).alias("_o"), *(F.upper(F.coalesce(F.col(c), F.lit(""))).alias(a) for c, a in ((full, "_f"), (short, "_s"))))
    pieces = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(F.col(c), i, n))))
    met = begin.join(legal.withColumn("_b", F.explode(F.array_distinct(F.concat(pieces("_f"), pieces("_s"))))), "_b")
    found = met.where(F.col("_f").contains(F.col("_t")) | F.col("_s").contains(F.col("_t")) | F.col("_f").startswith(F.substring("_t", 1, 10)))
    return enterprises.join(top_one(found, [name], [F.col("_o"), F.col(key)]).select(name, key), name, "left")


def photo_objects(photos: DataFrame, objects: DataFrame, equipment: DataFrame, units: DataFrame) -> DataFrame:
    """JON-22: photos(photo, kind, key, lat) to objects, by folder key: (photo, cad, source).

    A photo with a place of its own needs no object. Else the folder's key is an object (`cad`), an inventory number
    (`eq`: equipment(inv, seq, object_id), the first one's object) or a unit (`bu`: units(unit, slug, seq, object_ids), by
    id or slug, the first of its objects that has a place). objects(id, cad, has_place); others are left out.
    """
    own = photos.where("lat is not null").select("photo", F.lit(None).cast("string").alias("cad"), F.lit("exif").alias("source"))
    rest = photos.where("lat is null")
    placed = objects.where("has_place").select("id", "cad")
    by_cad = rest.where("kind = 'cad'").join(placed.select(F.col("cad").alias("key"), "cad"), "key").select("photo", "cad", F.lit("object").alias("source"))
    first_eq = top_one(equipment, ["inv"], [F.col("seq")]).select(F.col("inv").alias("key"), F.col("object_id").alias("id"))
    by_eq = rest.where("kind = 'eq'").join(first_eq, "key").join(placed, "id").select("photo", "cad", F.lit("equipment").alias("source"))
    named = units.select("seq", "object_ids", F.explode(F.array_distinct(F.array("unit", "slug"))).alias("key"))
    members = top_one(named, ["key"], [F.col("seq")]).select("key", F.posexplode("object_ids").alias("at", "id")).join(placed, "id")
    first_bu = top_one(members, ["key"], [F.col("at")]).select("key", "cad")
    by_bu = rest.where("kind = 'bu'").join(first_bu, "key").select("photo", "cad", F.lit("unit").alias("source"))
    return reduce(DataFrame.unionByName, (own, by_cad, by_eq, by_bu))


#: Kinds of extracts by the short kind of a file.
EXTRACT_KINDS = {"egrn": "egrn_extract", "egrul": "egrul_extract", "egrip": "egrip_extract"}


def document_nodes(files: DataFrame, by_artifact: DataFrame, by_extract: DataFrame, cads: DataFrame, inns: DataFrame, ogrns: DataFrame) -> DataFrame:
    """JON-25: files(file, cad, kind, inn, ogrn) to a document and a node of the graph: (file, doc_id, node, node_by).

    The document: by the artifact's file name, else by (cad, kind of extract). The node: the document's, else that of the
    object, tax id or registration id, or the id's own formula where the graph has no such node.
    """
    kind = F.create_map(*(F.lit(x) for kv in EXTRACT_KINDS.items() for x in kv))
    one = lambda df, on, value, alias: df.groupBy(*on).agg(F.max(value).alias(alias))  # noqa: E731  # the last stated one wins; ids are in order
    out = files.join(one(by_artifact, ["file"], "doc_id", "_a"), "file", "left").withColumn("_kind", F.try_element_at(kind, F.col("kind")))
    out = out.join(one(by_extract.withColumnRenamed("kind", "_kind"), ["cad", "_kind"], "doc_id", "_e"), ["cad", "_kind"], "left").withColumn("doc_id", F.coalesce("_a", "_e"))
    for table, column in ((cads, "cad"), (inns, "inn"), (ogrns, "ogrn")):
        out = out.join(one(table, [column], "node", f"_{column}"), column, "left")
    stages = [("doc", F.concat(F.lit("doc::"), F.nullif("doc_id", F.lit("")))), ("cad", F.coalesce("_cad", F.nullif("cad", F.lit("")))), ("inn", F.coalesce("_inn", F.concat(F.lit("legal::inn::"), F.nullif("inn", F.lit(""))))), ("ogrn", F.coalesce("_ogrn", F.concat(F.lit("legal::ogrn::"), F.nullif("ogrn", F.lit("")))))]
    return out.select("file", "doc_id", F.coalesce(*(c for _, c in stages)).alias("node"), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in stages)).alias("node_by"))


def evidence_cascade(candidates: DataFrame, key: str, target: str, rule: str) -> DataFrame:
    """JON-24: of candidates (key, target, rule rank) those of the best rule; more than one target gives NULL."""
    best = candidates.groupBy(key).agg(F.min(rule).alias(rule))
    kept = candidates.join(best, [key, rule]).groupBy(key, rule).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target))
    return kept.select(key, F.when(F.col("_n") == 1, F.col(target)).alias(target), F.col(rule).alias("evidence"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """WIN-08/09."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def preferred(df: DataFrame, keys: list[str], column: str, order: list[str], tie: list[Column]) -> DataFrame:
    """SET-06: one row of each key, by the preferred values in order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    return top_one(df.withColumn("_p", F.when(rank == 0, len(order) + 1).otherwise(rank)), keys, [F.col("_p"), *tie]).drop("_p")


def conformed(*frames: DataFrame) -> DataFrame:
    """SET-01, PRJ-01: all rows; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_items(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """SET-04: what a has and b has not."""
    return a.select(*columns).distinct().join(b.select(*columns), columns, "left_anti")


def tree_order(path: str) -> list[Column]:
    """SRT-07: by depth, then by path."""
    return [F.size(F.split(F.col(path), "/")), F.col(path)]
