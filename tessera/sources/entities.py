"""Register entries of entities and of the registry as JSON (SRC-19, SRC-23, SRC-28), each document parsed once by its schema.

Legal entities with their founders of each kind, pledges of shares, licences, branches and addresses; persons with the companies
that they found or lead; sole traders; and registry documents whose rights carry details of the extract that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_hash
from tessera.functions.text import right_number, right_type

_SHARE = "`Доля`: struct<`Процент`: string, `Номинал`: string>"
_NAMED = "`ОГРН`: string, `ИНН`: string, `НаимПолн`: string, `НаимСокр`: string"
#: Names of fields in the documents.
LEGAL = f"""entity struct<ogrn: string, inn: string, kpp: string, name_full: string, name_short: string, status: string, is_active: boolean, region: string, address: string, reg_date: string, ust_kap: double,
 directors: array<struct<position: string, fio: string, inn: string>>, okved_main: struct<code: string, name: string>, okved_additional: array<struct<code: string, name: string>>, contacts: struct<phones: array<string>, emails: array<string>, website: string>>,
 raw_data struct<`Лиценз`: array<struct<`Номер`: string, `Дата`: string, `ДатаНач`: string, `ЛицОрг`: string, `ВидДеят`: string>>,
  `Учред`: struct<`РосОрг`: array<struct<{_NAMED}, {_SHARE}, `Обрем`: array<struct<`Тип`: string, `Залогодерж`: struct<{_NAMED}>, `Нотариал`: struct<`Номер`: string, `Дата`: string, `ФИО`: string>, `НотариусФИО`: string>>>>,
   `РФ`: array<struct<{_SHARE}, `Регион`: struct<`Наим`: string>, `ОргОсущПрав`: array<struct<{_NAMED}>>>>, `ИнОрг`: array<struct<`НаимПолн`: string, `Наим`: string, `Страна`: string, `РегНомер`: string, {_SHARE}>>, `ФЛ`: array<struct<`ФИО`: string>>>,
  `Подразд`: struct<`Филиал`: array<struct<`НаимПолн`: string, `Наим`: string, `КПП`: string, `Адрес`: string>>, `Представ`: array<struct<`НаимПолн`: string, `Наим`: string, `КПП`: string, `Адрес`: string>>>, `ДержРеестрАО`: struct<{_NAMED}>>"""
_BRIEF = "struct<`ОГРН`: string, `ИНН`: string, `НаимПолн`: string, `НаимСокр`: string, `Статус`: string>"
PERSON = f"entity struct<inn: string, fio: string, name_full: string, ogrnip: string, gender: string, status: string>, raw_data struct<`Руковод`: array<{_BRIEF}>, `Учред`: array<{_BRIEF}>>"
TRADER = "entity struct<ogrnip: string, ogrn: string, inn: string, name_full: string, name_short: string, gender: string, citizenship: string, email: string, reg_date: string, tax_organ: string, status: string, is_active: boolean>"
REGISTRY = """tables struct<extracts: array<struct<extract_number: string, extract_date: string, organ: string, source_filename: string>>,
 building_objects: array<map<string, string>>, land_objects: array<map<string, string>>,
 rights: array<struct<right_category: string, object_key_value: string, right_type: string, right_type_code: string, right_number: string, right_date: string, valid_from: string, valid_until: string, share_numerator: string, share_denominator: string, basis: string, beneficiary_name: string, source_extract_number: string>>>"""
#: Kinds of registry objects.
OBJECT_KINDS = {"land": "Земельный участок", "building": "Здание", "construction": "Сооружение", "room": "Помещение", "uncompleted": "Объект незавершенного строительства"}


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _key(ogrn: Column, inn: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("legal::ogrn::"), _some(ogrn)), F.concat(F.lit("legal::inn::"), _some(inn)), F.concat(F.lit("legal::name::"), stable_hash(F.trim(F.lower(_some(name))))), F.concat(F.lit("unknown::"), stable_hash(F.lit("?"))))


def _each(items: Column, make) -> Column:
    """An array of structs made of another one's; empty where there is none."""
    return F.filter(F.transform(items, make), lambda x: x.isNotNull())


def _list(*parts: Column) -> Column:
    """Arrays of one type, one after the other, missing ones left out."""
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


_LINK = "kind ogrn inn name share_percent has_pledge reg_number country persons".split()


def _link(kind: str, **fields: Column) -> Column:
    types = {"has_pledge": "boolean", "persons": "int"}
    return F.struct(F.lit(kind).alias("kind"), *((fields[n] if n in fields else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in _LINK[1:]))


def _parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.from_json(text, schema).alias("_d")).where("_d.entity is not null")


def legal_entities(df: DataFrame, text: str) -> DataFrame:
    """SRC-23: per document of a legal entity: key, ids, name, addresses, founders, pledges, licences, directors, registrar, activities.

    founders: links of each kind (legal, rf_org, foreign, and one with the number of persons); pledges: of each founder's share;
    addresses: the legal one and those of branches. A document without an entity, or that isn't JSON, has no row.
    """
    d, raw, founders = F.col("_d.entity"), F.col("_d.raw_data"), F.col("_d.raw_data.Учред")
    name = F.coalesce(_some(d["name_full"]), d["name_short"], F.lit(""))

    def country(c: Column) -> Column:
        return F.coalesce(F.get_json_object(c, "$.Наим"), c)

    own = _each(founders["РосОрг"], lambda f: _link("legal", ogrn=f["ОГРН"], inn=f["ИНН"], name=f["НаимПолн"], share_percent=f["Доля"]["Процент"], has_pledge=F.coalesce(F.size(f["Обрем"]) > 0, F.lit(False))))
    state = F.flatten(_each(founders["РФ"], lambda f: _each(f["ОргОсущПрав"], lambda o: _link("rf_org", ogrn=o["ОГРН"], inn=o["ИНН"], name=o["НаимПолн"], share_percent=f["Доля"]["Процент"]))))
    foreign = _each(founders["ИнОрг"], lambda f: _link("foreign", name=F.coalesce(_some(f["НаимПолн"]), f["Наим"]), reg_number=f["РегНомер"], country=country(f["Страна"]), share_percent=f["Доля"]["Процент"]))
    persons = F.when(F.size(founders["ФЛ"]) > 0, F.array(_link("person", persons=F.size(founders["ФЛ"]))))

    def pledge(f: Column, o: Column) -> Column:
        h, n = o["Залогодерж"], o["Нотариал"]
        return F.struct(
            F.coalesce(_some(f["НаимПолн"]), _some(f["НаимСокр"]), f["ОГРН"]).alias("founder"), F.coalesce(o["Тип"], F.lit("Залог")).alias("kind"), h["ОГРН"].alias("holder_ogrn"), h["ИНН"].alias("holder_inn"), F.coalesce(_some(h["НаимПолн"]), h["НаимСокр"]).alias("holder_name"),
            n["Номер"].alias("contract_number"), n["Дата"].alias("contract_date"), F.coalesce(_some(o["НотариусФИО"]), n["ФИО"]).alias("notary"),
        )

    branches = _each(raw["Подразд"]["Филиал"], lambda b: F.when(_some(b["Адрес"]).isNotNull(), F.struct(b["Адрес"].alias("address"), F.coalesce(_some(b["НаимПолн"]), b["Наим"]).alias("label"), b["КПП"].alias("kpp"))))
    legal = F.array(F.struct(F.coalesce(d["address"], F.lit("")).alias("address"), F.lit("Юридический адрес").alias("label"), d["kpp"].alias("kpp")))
    holder = raw["ДержРеестрАО"]
    found = _parsed(df, text, LEGAL)
    return found.select(
        *(c for c in found.columns if c != "_d"), _key(d["ogrn"], d["inn"], name).alias("key"), F.lit("legal").alias("kind"), d["ogrn"].alias("ogrn"), d["inn"].alias("inn"), d["kpp"].alias("kpp"), name.alias("name"), d["status"].alias("status"), d["ust_kap"].alias("capital"),
        _list(legal, branches).alias("addresses"), _list(own, state, foreign, persons).alias("founders"), _list(F.flatten(_each(founders["РосОрг"], lambda f: _each(f["Обрем"], lambda o: pledge(f, o))))).alias("pledges"),
        _list(_each(raw["Лиценз"], lambda x: F.struct(x["Номер"].alias("number"), x["Дата"].alias("issued"), x["ДатаНач"].alias("since"), x["ЛицОрг"].alias("organ"), x["ВидДеят"].alias("activity")))).alias("licences"), _list(d["directors"]).alias("directors"),
        F.when(_some(holder["ОГРН"]).isNotNull() | _some(holder["ИНН"]).isNotNull(), F.struct(holder["ОГРН"].alias("ogrn"), holder["ИНН"].alias("inn"), F.coalesce(_some(holder["НаимПолн"]), holder["НаимСокр"]).alias("name"))).alias("registrar"),
        F.concat_ws(" — ", d["okved_main"]["code"], d["okved_main"]["name"]).alias("activity"), _list(_each(d["okved_additional"], lambda o: F.concat_ws(" — ", o["code"], o["name"]))).alias("activities"), _list(d["contacts"]["phones"]).alias("phones"), _list(d["contacts"]["emails"]).alias("emails"), d["contacts"]["website"].alias("website"),
    )


def persons(df: DataFrame, text: str) -> DataFrame:
    """SRC-28: per document of a person: key, inn, name, companies led, companies founded (those that are active as links)."""
    d, raw = F.col("_d.entity"), F.col("_d.raw_data")
    name = F.coalesce(_some(d["fio"]), d["name_full"], F.lit(""))
    brief = lambda x: F.struct(x["ОГРН"].alias("ogrn"), x["ИНН"].alias("inn"), F.coalesce(_some(x["НаимСокр"]), x["НаимПолн"]).alias("name"), x["Статус"].alias("status"))
    founded = _list(_each(raw["Учред"], brief))
    key = F.when(_some(d["inn"]).isNotNull(), F.concat(F.lit("legal::inn::"), d["inn"])).otherwise(F.concat(F.lit("person::"), stable_hash(F.lower(name))))
    found = _parsed(df, text, PERSON)
    active = F.filter(founded, lambda x: ~F.coalesce(F.lower(x["status"]).contains("не действует"), F.lit(False)))
    return found.select(*(c for c in found.columns if c != "_d"), key.alias("key"), F.lit("person").alias("kind"), d["inn"].alias("inn"), name.alias("name"), _list(_each(raw["Руковод"], brief)).alias("leads"), founded.alias("founded"), active.alias("links"))


def sole_traders(df: DataFrame, text: str) -> DataFrame:
    """SRC-28: per document of a sole trader: key, ids, name and facts; such traders publish no address and have no founders."""
    d = F.col("_d.entity")
    ogrn, name = F.coalesce(_some(d["ogrnip"]), d["ogrn"]), F.coalesce(_some(d["name_full"]), d["name_short"], F.lit(""))
    found = _parsed(df, text, TRADER)
    return found.select(*(c for c in found.columns if c != "_d"), _key(ogrn, d["inn"], name).alias("key"), F.lit("ip").alias("kind"), ogrn.alias("ogrn"), d["inn"].alias("inn"), name.alias("name"), *(d[n].alias(n) for n in ("gender", "citizenship", "email", "reg_date", "tax_organ", "status", "is_active")))


def registry_documents(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """SRC-19: (objects, rights) of registry documents: objects with what they state, rights with details of their extract.

    objects: cad, kind, attrs (stated fields, kind spelled out); of two in one document that share a number the last one counts,
    land after buildings. rights: is_right, dedup_key, beneficiary and the extract's date, organ and file where the document has
    the extract that the right names; of extracts that share a number the last one counts.
    """
    kept = [c for c in df.columns if c != text]
    docs = df.select(*kept, F.from_json(text, REGISTRY).alias("_d")).where("_d.tables is not null")
    tables = F.col("_d.tables")
    kinds = F.create_map(*(F.lit(v) for kv in OBJECT_KINDS.items() for v in kv))
    stated = _list(tables["building_objects"], tables["land_objects"])
    objects = docs.select(*kept, F.posexplode(F.filter(stated, lambda o: _some(F.try_element_at(o, F.lit("cad_number"))).isNotNull())).alias("_at", "_o"))
    cad, kind = F.try_element_at("_o", F.lit("cad_number")), F.coalesce(F.try_element_at(kinds, F.try_element_at("_o", F.lit("object_type"))), F.lit("Неизвестно"))
    attrs = F.transform_values(F.map_filter("_o", lambda k, v: _some(v).isNotNull()), lambda k, v: F.when(k == "object_type", kind).otherwise(v))
    rows = objects.select(*kept, "_at", cad.alias("cad"), kind.alias("kind"), attrs.alias("attrs"))
    objects = rows.groupBy(*kept, "cad").agg(F.max_by(F.struct("kind", "attrs"), "_at").alias("o")).select(*kept, "cad", "o.kind", "o.attrs")
    rights = docs.select(*kept, F.coalesce(tables["extracts"], F.array().cast("array<struct<extract_number:string,extract_date:string,organ:string,source_filename:string>>")).alias("_x"), F.explode(tables["rights"]).alias("_r"))
    r = F.col("_r")
    extract = F.element_at(F.concat(F.array(F.lit(None)), F.filter("_x", lambda x: x["extract_number"] == r["source_extract_number"])), -1)
    code = F.coalesce(_some(F.lower(r["right_type_code"])), right_type(F.coalesce(r["right_type"], F.lit(""))), F.lit("unknown"))
    number = _some(right_number(F.coalesce(r["right_number"], F.lit(""))))
    dedup = F.when(number.isNotNull(), stable_hash(code, number)).otherwise(stable_hash(code, F.lit("no_number"), F.coalesce(r["right_type"], F.lit(""))))
    found = rights.withColumn("_e", extract).select(
        *kept, r["object_key_value"].alias("cad"), F.coalesce(F.lower(r["right_category"]) == "right", F.lit(False)).alias("is_right"), dedup.alias("dedup_key"), F.trim(F.coalesce(r["beneficiary_name"], F.lit(""))).alias("beneficiary"),
        *(_some(r[n]).alias(n) for n in ("right_type", "right_number", "right_date", "valid_from", "valid_until", "share_numerator", "share_denominator", "basis")), F.when(_some(r["source_extract_number"]).isNotNull(), F.col("_e.extract_number")).alias("extract_number"), F.col("_e.extract_date").alias("extract_date"), F.col("_e.organ").alias("organ"), F.col("_e.source_filename").alias("file"),
    )
    return objects, found
