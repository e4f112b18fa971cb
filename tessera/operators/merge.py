"""Merging sources with provenance (MRG-01..19, AGG-19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_hash, texts_differ, values_differ
from tessera.functions.text import short_form
from tessera.operators.relational import top_one

#: Source kinds by weight; an unknown source weighs nothing.
PRIORITY = {"egrn": 4, "nspd": 3, "legal_entity": 3, "ip_entity": 3, "kadbase": 2, "kml": 2, "certificate": 1}


def priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), kind), F.lit(0))


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    a = old.select(F.col(key), F.struct(*old.columns).alias("o"))
    b = new.select(F.col(key), F.struct(*new.columns).alias("n"))
    return a.join(b, key, "full")


def field_diff(old: DataFrame, new: DataFrame, key: str, numbers: list[str], texts: list[str], tolerance: float = 1e-4) -> DataFrame:
    """MRG-17: (key, field, old_value, new_value) of the significant fields that changed; a missing new value is no change."""
    both = _both(old, new, key).where("o is not null and n is not null")
    cell = lambda c, differ: F.when(differ(F.col(f"o.{c}"), F.col(f"n.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old_value"), F.col(f"n.{c}").cast("string").alias("new_value")))
    cells = [cell(c, lambda a, b: values_differ(a, b, tolerance)) for c in numbers] + [cell(c, texts_differ) for c in texts]
    return both.select(key, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def upsert(old: DataFrame, new: DataFrame, key: str, content: str, policy: str = "replace", fill: list[str] | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """MRG-01: all rows after the upsert, with the action: inserted, skipped (equal content), replaced, enriched, kept.

    Policy replace takes the new row, enrich only fills fields that are NULL (those of `fill`, or all), ask_enrich takes
    the new values of the fields that `accepted`(key, field) names, where they are stated. Two unknown contents are equal.
    """
    both = _both(old, new, key)
    if policy == "ask_enrich":
        # (key, fields) of what was agreed to; nothing agreed leaves a row as it is
        said = accepted.groupBy(key).agg(F.collect_set("field").alias("_ok")) if accepted is not None else old.limit(0).select(key, F.lit(None).cast("array<string>").alias("_ok"))
        both = both.join(said, key, "left")
    same = F.col("o").isNotNull() & F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}"))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(same, "skipped").otherwise("replaced" if policy == "replace" else "enriched")

    def changed(c: str) -> Column:
        if policy == "replace":
            return F.col(f"n.{c}")
        if policy == "ask_enrich":
            return F.when(F.coalesce(F.array_contains("_ok", c), F.lit(False)), F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}"))
        return F.coalesce(f"o.{c}", f"n.{c}") if c in (fill or old.columns) else F.col(f"o.{c}")

    value = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), F.col(f"n.{c}")).when(same, F.col(f"o.{c}")).otherwise(changed(c))
    return both.select(key, *(value(c).alias(c) for c in old.columns if c != key), action.alias("action"))


def upsert_events(old: DataFrame, new: DataFrame, key: str, content: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """MRG-01: (key, event, fields, content) that an upsert emits: created for new keys; modified, with the significant
    fields that changed, for keys whose content differs and that have any."""
    known = old.select(F.col(key), F.col(content).alias("_c"))
    made = new.join(known, key, "left_anti").select(key, F.lit("created").alias("event"), F.array().cast("array<string>").alias("fields"), F.col(content).alias("content"))
    other = new.join(known, key).where(~F.col(content).eqNullSafe(F.col("_c"))).drop("_c")
    diffs = field_diff(old, other, key, numbers, texts).groupBy(key).agg(F.array_sort(F.collect_list("field")).alias("fields"))
    return made.unionByName(other.select(key, F.col(content).alias("content")).join(diffs, key).withColumn("event", F.lit("modified")))


def parsed_changes(store: dict[str, DataFrame], parsed: dict[str, DataFrame], object_key: str, policy: str = "replace", fill: list[str] | None = None) -> dict[str, DataFrame]:
    """MRG-15: what extracts, objects, rights and holders of parsed documents add to a store, and the objects that they change.

    Extracts are told by number and object, the last stated one counts; objects go by upsert(); a right whose number is
    known, or comes twice, is the one there is, a right without a number is always new; holders follow their right and
    are there once by kind, name and tax id. rights and holders have a `ref` that ties them in the parsed documents.
    """
    extracts = top_one(parsed["extracts"], ["extract_number", object_key], [F.desc("extract_date")]).join(store["extracts"].select("extract_number", object_key), ["extract_number", object_key], "left_anti")
    new = top_one(parsed["objects"], [object_key], [F.col("content_hash")])
    objects = upsert(store["objects"], new, object_key, "content_hash", policy, fill).where("action not in ('kept', 'skipped')").drop("action")
    known = store["rights"].where("right_number is not null").groupBy("right_number").agg(F.min("right_id").alias("_known"))
    # the id of a right that is new: its own number's, or its place in the documents
    fresh = F.when(F.col("right_number").isNotNull(), stable_hash(F.col("right_number"))).otherwise(stable_hash(F.col("ref")))
    named = parsed["rights"].join(known, "right_number", "left").withColumn("right_id", F.coalesce("_known", fresh))
    added = top_one(named.where("_known is null"), ["right_id"], [F.col("ref")]).drop("_known", "ref")
    # each name is shortened once, however many rights it stands in
    short = parsed["holders"].select("name").distinct().select(F.col("name").alias("_name"), short_form(F.col("name")).alias("_short"))
    held = parsed["holders"].join(named.select("ref", "right_id"), "ref").join(short, F.col("name").eqNullSafe(F.col("_name"))).withColumn("name", F.col("_short"))
    same = ["right_id", "holder_type", "name", "inn"]
    return {"extracts": extracts, "objects": objects, "rights": added.select(*store["rights"].columns), "holders": held.select(*same).subtract(store["holders"].select(*same))}


def merge_parsed(store: dict[str, DataFrame], parsed: dict[str, DataFrame], object_key: str, policy: str = "replace", fill: list[str] | None = None) -> dict[str, DataFrame]:
    """MRG-15: the store's tables after parsed_changes()."""
    changes = parsed_changes(store, parsed, object_key, policy, fill)
    objects = store["objects"].join(changes["objects"].select(object_key), object_key, "left_anti")
    return {n: (objects if n == "objects" else store[n]).unionByName(changes[n]) for n in store}


def commit(changes: dict[str, DataFrame], folder: str, version: int) -> None:
    """MRG-15: the changes of a version, all tables or none: the file that names it is written last, and readers go by that file.

    A version that is tried again overwrites what it had written; what other versions wrote is never touched.
    """
    spark = next(iter(changes.values())).sparkSession
    for name, df in changes.items():
        df.withColumn("_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark.createDataFrame([(version, sorted(changes))], "version long, tables array<string>").coalesce(1).write.mode("append").json(f"{folder}/committed")


def last_committed(spark, folder: str, keys: dict[str, str]) -> dict[str, DataFrame]:
    """MRG-15: the tables as the versions that were written whole left them; of a table in keys the last version of each key.

    One small file is read for each version.
    """
    done = spark.read.schema("version long, tables array<string>").json(f"{folder}/committed").distinct().collect()
    out = {}
    for name in sorted({n for r in done for n in r.tables}):
        rows = spark.read.parquet(*(f"{folder}/v{r.version}/{name}" for r in done if name in r.tables))
        out[name] = (top_one(rows, [keys[name]], [F.desc("_version")]) if name in keys else rows).drop("_version")
    return out


def add_source(known: Column, source: Column) -> Column:
    """MRG-02: sources joined by ' | ', each named once."""
    return F.when(known.isNull() | (known == ""), source).when(source.isNull() | known.contains(source), known).otherwise(F.concat_ws(" | ", known, source))


def fill_missing(old: DataFrame, new: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """MRG-02: rows of old with NULL fields filled, and the source added where one was."""
    add = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in [*fields, source]))
    out = old.join(add, key, "left")
    filled = reduce(lambda a, b: a | b, (F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in fields))
    out = out.withColumn(source, F.when(filled, add_source(F.col(source), F.col(f"_{source}"))).otherwise(F.col(source)))
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop(*(f"_{c}" for c in [*fields, source]))


def priority_merge(values: DataFrame, key: str, field: str, value: str, source: str, rank: str, seq: str) -> DataFrame:
    """MRG-03/04/06/18: per (key, field) the value of the highest rank, of equals the first; the losing values in order.

    Empty markers don't take part. A value that the winner states too is no variant. Ranks may be numbers or structs
    (score and moment, or priority and version): whatever compares.
    """
    usable = values.where(F.col(value).isNotNull() & ~F.col(value).cast("string").isin("", "-"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(rank).alias("rank"), F.col(value).alias("value"), F.col(source).alias("source"))))
    # few sources state a field, so the rows of one field are a short list
    best = usable.groupBy(key, field).agg(F.max(rank).alias("_top"), rows.alias("_rows"))
    winner = F.try_element_at(F.filter("_rows", lambda r: r["rank"] == F.col("_top")), F.lit(1))
    out = best.withColumn("_win", winner)
    variants = F.transform(F.filter("_rows", lambda r: ~r["value"].eqNullSafe(F.col("_win.value"))), lambda r: F.struct(r["value"].alias("value"), r["source"].alias("source")))
    return out.select(key, field, F.col("_win.value").alias(value), F.col("_win.source").alias(source), variants.alias("variants"))


def is_noop(merged: DataFrame, before: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """MRG-05: (key, noop): whether the merge left all columns as they were."""
    b = before.select(F.col(key), F.struct(*columns).alias("_b"))
    return merged.select(F.col(key), F.struct(*columns).alias("_a")).join(b, key, "left").select(key, F.col("_a").eqNullSafe(F.col("_b")).alias("noop"))


def gap_fill(profile: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """MRG-07: missing fields filled; names of the filled ones, or why nothing was done."""
    add = found.select(F.col(key), F.lit(True).alias("_found"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = profile.join(add, key, "left")
    filled = F.filter(F.array(*(F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    out = out.withColumn("filled", filled)
    reason = F.when(F.col("_found").isNull(), "no source").when(F.size("filled") == 0, "nothing to fill")
    return out.withColumn("skipped", reason).withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop("_found", *(f"_{c}" for c in fields))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """MRG-08: rows of the keys that are new or stated anew are those of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """MRG-10, MRG-16: rows of new whose keys old lacks, one of each; a NULL key is never equal."""
    missing = new.join(old.select(*keys), keys, "left_anti")
    return top_one(missing, keys, order) if order else missing.dropDuplicates(keys)


def bundle_import(rows: DataFrame, existing: DataFrame, keys: list[str], parents: DataFrame, parent: str, order: list[Column]) -> DataFrame:
    """MRG-09: (row, outcome): insert, exists, or no_parent."""
    known = existing.select(*keys).distinct().withColumn("_e", F.lit(True))
    kin = parents.select(F.col(parent)).distinct().withColumn("_p", F.lit(True))
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.join(known, keys, "left").join(kin, parent, "left").withColumn("_n", F.row_number().over(w))
    return out.withColumn("outcome", F.when(F.col("_p").isNull(), "no_parent").when(F.col("_e").isNotNull() | (F.col("_n") > 1), "exists").otherwise("insert")).drop("_e", "_p", "_n")


def register_entities(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """MRG-11: entities added where absent, blank names filled."""
    fresh = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.nullif(F.col(name), F.lit(""))).alias("_name"))
    return old.join(fresh, key, "full").withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), "_name")).drop("_name")


def coalesce_update(old: DataFrame, new: DataFrame, key: str, columns: list[str], guarded: dict[str, list[str]] | None = None) -> DataFrame:
    """MRG-12: new values over old ones where they are stated; a guarded column never leaves its listed values."""
    add = new.select(F.col(key), F.lit(True).alias("_n"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(add, key, "full")
    guard = lambda c: F.when(F.col(c).isin(*(guarded or {}).get(c, [])), F.col(c)) if (guarded or {}).get(c) else F.lit(None)
    return out.withColumns({c: F.coalesce(guard(c), F.col(f"_{c}"), F.col(c)) for c in columns}).drop("_n", *(f"_{c}" for c in columns))


def preserve_confirmed(old: DataFrame, new: DataFrame, key: str, confirmed: str, editable: list[str]) -> DataFrame:
    """MRG-13: confirmed rows stay as they are, also where new lacks them; others are new, with the user's own fields kept."""
    both = _both(old, new, key).where(F.col("n").isNotNull() | F.col(f"o.{confirmed}"))
    keep = F.coalesce(F.col(f"o.{confirmed}"), F.lit(False))
    value = lambda c: F.when(keep, F.col(f"o.{c}")).otherwise(F.coalesce(F.nullif(F.col(f"o.{c}").cast("string"), F.lit("")).cast(old.schema[c].dataType), F.col(f"n.{c}")) if c in editable else F.col(f"n.{c}"))
    return both.select(key, *(value(c).alias(c) for c in old.columns if c != key))


def accumulate_assets(rows: DataFrame, cad: str, inventory: str, name: str, address: str, seq: str, fill: list[str], holder: str, source: str) -> DataFrame:
    """MRG-14: one asset by id, else inventory number, else name and address: first values, holders and sources once each."""
    key = F.coalesce(F.concat(F.lit("cad:"), F.col(cad)), F.concat(F.lit("inv:"), F.col(inventory)), F.concat_ws("|", F.lit("name"), F.lower(F.trim(F.col(name))), F.lower(F.trim(F.col(address)))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    each = lambda c: F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.col(c).alias("v")))), lambda x: x.v.isNotNull()), lambda x: x.v)).alias(f"{c}s")
    return rows.withColumn("asset", key).groupBy("asset").agg(*(first(c) for c in fill), each(holder), each(source))


def right_key(kind: Column, text: Column, number: Column) -> Column:
    """MRG-18: a right by its number, else by code and wording."""
    n = F.lower(F.regexp_replace(F.coalesce(number, F.lit("")), r"(?U)\s+", ""))
    return F.when(n != "", F.concat(F.lit("n:"), n)).otherwise(F.concat(F.lit("t:"), stable_hash(kind, F.lower(F.trim(text)))))


def merge_rights(rights: DataFrame, key: list[str], holder: str, source: str, seq: str, fields: list[str]) -> DataFrame:
    """AGG-19, MRG-18: one row a key: first stated fields, holders and sources in order, other statements as variants."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.col(holder).alias("h"), F.col(source).alias("s"), F.struct(*fields).alias("f"))))
    out = rights.groupBy(*key).agg(rows.alias("_r"))
    pick = lambda c: F.try_element_at(F.filter(F.transform("_r", lambda r: r["f"][c]), lambda x: x.isNotNull()), F.lit(1)).alias(c)
    names = lambda k: F.array_distinct(F.filter(F.transform("_r", lambda r: r[k]), lambda x: x.isNotNull()))
    return out.select(*key, *(pick(c) for c in fields), names("h").alias("holders"), names("s").alias("sources"), F.size(F.array_distinct(F.transform("_r", lambda r: r["f"]))).alias("statements"))


def beneficiary_key(ogrn: Column, inn: Column, name: Column) -> Column:
    """MRG-19: by registration id, tax id, or a hash of the name; nothing gives NULL."""
    return F.coalesce(
        F.concat(F.lit("legal::ogrn::"), F.nullif(ogrn, F.lit(""))),
        F.concat(F.lit("legal::inn::"), F.nullif(inn, F.lit(""))),
        F.when(F.trim(name) != "", F.concat(F.lit("person::"), stable_hash(F.lower(F.trim(name))))),
    )
