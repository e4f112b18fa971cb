"""The store's views and serving queries over registry tables: objects, rights, leases, dossiers, pledges, catalogue.

A store is a dict of DataFrames (land_objects, building_objects, rights, right_holders, extracts, valuations); a table that
is missing counts as empty where a view can do without it. Orders that the source leaves open are stated here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import decode, json_list, share_text
from tessera.operators.aggregates import joined, latest, named_with_id
from tessera.operators.relational import allowed, conformed, contains_any, still_valid, top_one

#: Names of building kinds and of right categories.
BUILDINGS = {"building": "Здание", "structure": "Сооружение", "room": "Помещение", "parking": "Машино-место", "ons": "ОНС", "complex": "Комплекс"}
CATEGORIES = {"encumbrance": "Обременение", "restriction": "Ограничение"}
LEASES = ("lease", "lease_full")
DEREGISTERED = ("снят с учет", "снято с учет", "снята с учет", "погашен")

Store = dict[str, DataFrame]


def is_deregistered(status: Column) -> Column:
    """FLT-15: a status text that speaks of deregistration."""
    return F.coalesce(F.lower(status).rlike("|".join(DEREGISTERED)), F.lit(False))


def registered(objects: DataFrame) -> DataFrame:
    """FLT-02."""
    return objects.where(F.col("lifecycle_status") != "deregistered")


def overlay_order() -> list[Column]:
    """SRT-05: documents by day, registration and id; a missing registration comes first."""
    return [F.col("doc_date"), F.coalesce("registered_at", F.lit("")), F.col("doc_id")]


def all_objects(store: Store) -> DataFrame:
    """v_all_objects: parcels and buildings in one schema."""
    land = store["land_objects"].withColumns({"object_class": F.lit("land"), "object_type_ru": F.lit("Земельный участок")})
    kind = decode(F.col("object_type"), BUILDINGS, F.col("object_type"))
    building = store["building_objects"].withColumns({"object_class": F.lit("building"), "object_type_ru": kind})
    return conformed(land, building)


def rights_full(store: Store) -> DataFrame:
    """v_rights_full: rights with their holders, a row for each; the share as text."""
    r = store["rights"].withColumn("share_str", F.when(F.col("share_numerator").isNotNull(), share_text(F.col("share_numerator"), F.col("share_denominator"))).otherwise("1/1"))
    h = store["right_holders"].select("right_id", "holder_type", F.col("name").alias("holder_name"), F.col("inn").alias("holder_inn"), F.col("ogrn").alias("holder_ogrn"))
    return r.join(h, "right_id", "left").withColumnRenamed("object_key_value", "cad_number")


def lease_contracts(store: Store, today: Column) -> DataFrame:
    """v_lease_contracts: leases and servitudes with their object and lessee; an end on the day itself is in force."""
    leases = rights_full(store).where((F.col("right_category") == "encumbrance") & F.col("right_type_code").isin(*LEASES, "servitude"))
    objects = all_objects(store).select("cad_number", F.col("name").alias("object_name"), "address", "area")
    status = F.when(still_valid(F.col("valid_until"), today), "Действует").otherwise("Истёк")
    return leases.join(objects, "cad_number", "left").select(F.col("right_number").alias("contract_number"), "cad_number", "object_name", "address", "area", F.col("holder_name").alias("lessee_name"), F.col("holder_inn").alias("lessee_inn"), F.col("right_date").alias("registration_date"), F.col("valid_from").alias("lease_start"), F.col("valid_until").alias("lease_end"), status.alias("status"))


def pledges_prohibitions(store: Store) -> DataFrame:
    """v_pledges_prohibitions: encumbrances and restrictions other than leases; a right without a code is left out."""
    r = store["rights"].where(F.col("right_category").isin(*CATEGORIES) & ~F.col("right_type_code").isin(*LEASES))
    objects = all_objects(store).select("cad_number", F.col("name").alias("object_name"), "address")
    out = r.withColumnRenamed("object_key_value", "cad_number").join(objects, "cad_number", "left")
    return out.withColumn("category_ru", decode(F.col("right_category"), CATEGORIES))


#: One restriction of an object's JSON list.
RESTRICTION = "array<struct<type:string,description:string,registry_number:string,valid_from:string,valid_to:string,notes:string,source_extract:string,basis_doc:struct<type:string,number:string,date:string>>>"


def restrictions(store: Store) -> DataFrame:
    """COL-02: the restrictions of objects, a row for each entry of their JSON lists, and those of rights, in one schema.

    A list that is malformed has no entries.
    """
    columns = {"land_objects": "cad_number", "building_objects": "cad_number"}
    own = [store[t].select(F.col(c).alias("cad_number"), F.inline(F.from_json("object_restrictions", RESTRICTION))) for t, c in columns.items() if t in store]
    of_objects = conformed(*own).select(
        F.lit("object").alias("kind"), "cad_number", F.lit(None).cast("string").alias("right_number"), F.coalesce("registry_number", "type").alias("registry_number"), "description",
        F.col("basis_doc.type").alias("basis_type"), F.col("basis_doc.number").alias("basis_number"), F.col("basis_doc.date").alias("basis_date"), "valid_from", "valid_to",
        F.lit(None).cast("string").alias("beneficiary_inn"), F.lit(None).cast("string").alias("beneficiary_name"), "notes",
    )
    of_rights = store["rights"].where("right_category = 'restriction'").select(
        F.lit("right").alias("kind"), F.col("object_key_value").alias("cad_number"), "right_number", F.col("right_type").alias("description"),
        F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_to"), "beneficiary_inn", "beneficiary_name", F.col("basis").alias("notes"),
    )
    return conformed(of_objects, of_rights)


def object_dossier(store: Store) -> DataFrame:
    """v_object_dossier: a row for each object with owners, leases, counts, last extract and book values.

    Each subquery of a row is one aggregation over its table and one join: nothing runs once for each object.
    """
    active = store["rights"].where("is_active = 1").withColumnRenamed("object_key_value", "cad_number")
    owners = active.where("right_category = 'right'").join(store["right_holders"], "right_id").withColumn("_o", named_with_id(F.col("name"), F.col("inn"))).groupBy("cad_number").agg(joined("_o").alias("owners"))
    own = active.groupBy("cad_number").agg(
        F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("right_type_code").isin(*LEASES), F.col("right_number")))), "; "), F.lit("")).alias("active_leases"),
        F.count_if(F.col("right_category") == "encumbrance").alias("encumbrances_count"),
        F.count_if(F.col("right_category") == "restriction").alias("restrictions_count"),
    )
    last = top_one(store["extracts"], ["cad_number"], [F.desc("extract_date"), F.col("extract_number")]).select("cad_number", F.concat("extract_number", F.lit(" от "), F.col("extract_date").cast("string")).alias("last_extract"))
    values = top_one(store["valuations"].where("cad_number is not null"), ["cad_number", "valuation_type"], [F.desc("doc_date"), F.desc("amount")])
    book = values.groupBy("cad_number").agg(*(F.max(F.when(F.col("valuation_type") == v, F.col("amount"))).alias(f"book_value_{v}") for v in ("initial", "residual")))
    out = all_objects(store)
    for part in (owners, own, last, book):
        out = out.join(part, "cad_number", "left")
    return out.withColumn("object_restrictions_count", F.when(F.col("object_restrictions").isNotNull(), F.size(json_list(F.col("object_restrictions"))))).fillna(0, ["encumbrances_count", "restrictions_count"])


def catalogue(store: Store, query: str = "", kind: str | None = None, grants: DataFrame | None = None, subject: str = "", now: Column | None = None, superuser: bool = False) -> DataFrame:
    """GET /catalog: objects that contain the query and that the subject may see, with the day of their last extract."""
    found = contains_any(registered(all_objects(store)), query, ["cad_number", "name", "address"]) if query else registered(all_objects(store))
    found = found.where(F.col("object_class") == kind) if kind else found
    seen = allowed(found, grants, subject, now, "cad_number", superuser) if grants is not None else found
    return seen.join(latest(store["extracts"], "cad_number", "extract_date"), "cad_number", "left")


def register_views(spark, store: Store, today: Column) -> None:
    """The five views under their names."""
    all_objects(store).createOrReplaceTempView("v_all_objects")
    rights_full(store).createOrReplaceTempView("v_rights_full")
    lease_contracts(store, today).createOrReplaceTempView("v_lease_contracts")
    object_dossier(store).createOrReplaceTempView("v_object_dossier")
    pledges_prohibitions(store).createOrReplaceTempView("v_pledges_prohibitions")
