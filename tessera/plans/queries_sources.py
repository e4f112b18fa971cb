"""Readers and writers: rows of the driver's tables written in a source's layout to the scratch folder, and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.registry import Tables, query
from tessera.scratch import scratch_path
from tessera.sources import archives, documents, entities, extracts, ledgers, pages, photos, readers, sheets, sinks, tax_extracts


def _s(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _tag(name: str, *inner: Column | str) -> Column:
    """An XML element of columns and literal texts; markup in columns is escaped by the caller."""
    return F.concat(F.lit(f"<{name}>"), *(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in inner), F.lit(f"</{name}>"))


def _lines(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """Texts written as lines and read again: (value)."""
    path = scratch_path(t.spark, name)
    df.write.text(path)
    return t.spark.read.text(path)


@query("SELECT 'customer' AS name, count(*) AS rows, count(c_name) AS named FROM customer UNION ALL SELECT 'partsupp', 0, 0")
def optional_tables(t: Tables) -> DataFrame:
    """SRC-01: a table that is missing has no rows."""
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    counted = lambda name: readers.optional_table(t.spark, name, schema, f"{t.folder}/{name}.parquet").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count("c_name").alias("named"))
    return counted("customer").unionByName(counted("partsupp"))


@query("SELECT 'r=' || n_regionkey AS folder, 'txt' AS suffix, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def file_scan(t: Tables) -> DataFrame:
    """SRC-02: files below a folder with one ending; those with another are passed over."""
    path = scratch_path(t.spark, "files")
    rows = t.nation.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("r"))
    rows.coalesce(1).write.partitionBy("r").text(path)
    rows.coalesce(1).write.mode("append").partitionBy("r").json(path)
    found = readers.files(t.spark, path, ".txt", content=False).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("folder", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("suffix")).agg(F.sum("length").alias("bytes"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'kml' WHEN 1 THEN 'egrn' WHEN 2 THEN 'nspd' WHEN 3 THEN 'person' WHEN 4 THEN 'ip_entity' WHEN 5 THEN 'legal_entity' WHEN 6 THEN 'kadbase' WHEN 7 THEN 'certificate' ELSE 'unknown' END AS kind FROM orders""")
def source_kinds(t: Tables) -> DataFrame:
    """SRC-03: the kind of a document by its keys; what isn't JSON is unknown."""
    key = F.element_at(F.array(*map(F.lit, ("placemarks", "extract", "features", "person", "ip_entity", "legal_entity", "kadbase", "certificate", "none"))), (F.col("o_orderkey") % 9 + 1).cast("int"))
    body = F.when(F.col("o_orderkey") % 9 == 8, F.concat(F.lit("{not json "), _s("o_orderkey"))).otherwise(F.concat(F.lit('{"id": "'), _s("o_orderkey"), F.lit('", "'), key, F.lit('": {"x": [1]}}')))
    return t.orders.select("o_orderkey", readers.file_kind(body).alias("kind"))


def _cad(n: Column) -> Column:
    return F.concat(F.lit("61:44:0050706:"), _s(n))


def _documents(t: Tables, *keep: str) -> DataFrame:
    """Extracts of four kinds, one for each customer, in one line each."""
    k = F.col("c_custkey")
    kind = k % 4
    root = F.element_at(F.array(*map(F.lit, ("extract_about_property_land", "extract_about_property_build", "extract_about_property_room", "extract_about_property_construction"))), (kind + 1).cast("int"))
    params = (
        F.when(kind == 0, F.concat(_tag("category", _tag("type", _tag("value", F.lit("Земли населенных пунктов")))), _tag("area", _tag("value", _s(k + 100)), _tag("inaccuracy", _s(k % 7))), _tag("permitted_use", _tag("value", F.col("c_mktsegment"))), _tag("permitted_use", _tag("value", F.lit("Данные отсутствуют")))))
        .when(kind == 1, F.concat(_tag("area", _s(k + 100)), _tag("name", F.replace("c_name", F.lit("#"), F.lit("&amp;"))), _tag("floors", _s(k % 30)), _tag("underground_floors", _s(k % 2)), _tag("year_built", _s(1900 + k % 100))))
        .when(kind == 2, F.concat(_tag("area", _s(k + 100)), _tag("name", F.lit("-")), _tag("type", _tag("value", F.lit("Жилое")))))
        .otherwise(_tag("main_characteristics", _tag("type", F.lit("протяженность")), _tag("value", F.concat(_s(k), F.lit(",5"))), _tag("unit", F.lit("м"))))
    )
    head = _tag("details", _tag("group_top_requisites", _tag("organ_registr_rights", F.when(k % 7 == 0, " &#171;Росреестр&#xBB; ").when(k % 7 == 1, "<![CDATA[ Росреестр & <Ко> ]]>").otherwise(" Росреестр <!-- без отдела --> ")), _tag("date_formation", F.lit("30.12.2020")), _tag("registration_number", F.concat(F.lit("99/"), _s(k)))))
    record = _tag("record", _tag("record_info", _tag("registration_date", F.lit("2015-03-04T00:00:00+03:00"))), _tag("object", _tag("cad_number", _cad(k))), _tag("params", params), _tag("address", _tag("readable_address", F.concat(F.lit("г.  Город, "), F.col("c_mktsegment")))), _tag("cost", _tag("value", F.concat(_s(k), F.lit(",25")))), F.when(kind == 2, _tag("parent_cad_number", _tag("cad_number", _cad(k + 1)))))
    holder = _tag("right_holder", F.when(k % 3 == 0, _tag("legal_entity", _tag("full_name", F.col("c_name")), _tag("inn", F.lpad(_s(k), 10, "0")))).when(k % 3 == 1, _tag("individual", _tag("surname", F.lit("Н")), _tag("inn", F.lpad(_s(k), 12, "0")))).otherwise(_tag("public_formation", _tag("name", _tag("value", F.lit("Российская Федерация"))))))
    share = F.when(k % 2 == 0, _tag("share", _tag("numerator", F.lit("1")), _tag("denominator", _s(k % 5 + 1)))).otherwise(_tag("share", F.lit("доля 2/7")))
    right = _tag("right_record", _tag("record_info", _tag("registration_date", F.lit("01.02.2016"))), _tag("right_type", _tag("value", F.when(k % 5 == 0, "Хозяйственное ведение").when(k % 5 == 1, "Ипотека").otherwise("Собственность"))), _tag("right_number", F.concat(_cad(k), F.lit("-1"))), share, _tag("right_holders", F.when(k % 10 != 1, holder)))
    limit = _tag("restrict_record", _tag("restrictions_encumbrances_data", _tag("restriction_encumbrance_number", F.when(k % 6 != 0, F.concat(_cad(k), F.lit("-2")))), _tag("restriction_encumbrance_type", _tag("value", F.lit("Аренда"))), _tag("start_date", F.lit("2020-01-01")), _tag("end_date", F.lit("2030-01-01"))), _tag("right_holders", F.when(k % 2 == 0, _tag("right_holder", _tag("legal_entity", _tag("name", F.lit("ООО"))))).otherwise(_tag("right_holder", _tag("undefined", F.lit("x"))))))
    zone = _tag("restriction_encumbrance", _tag("number", F.lit("z1")), _tag("encumbrance_type", _tag("value", F.when(k % 2 == 0, "Памятник").otherwise("Охранная зона"))))
    body = F.concat(head, record, _tag("right_records", right), _tag("restrict_records", limit), zone, zone, F.when(kind == 3, _tag("special_notes", F.lit("особая отметка"))).otherwise("<special_notes/>"), _tag("status", F.when(k % 11 == 0, "Снят с учета").otherwise("Актуальные")))
    # half of the documents have a prefix on every name, a third names in capitals
    start, stop = F.concat(F.lit("<"), root, F.lit(">")), F.concat(F.lit("</"), root, F.lit(">"))
    plain = F.concat(start, body, stop)
    shown = F.when(k % 2 == 0, F.regexp_replace(F.regexp_replace(plain, r"<(/?)(\w)", "<$1x:$2"), r"^<x:(\w+)", '<x:$1 xmlns:x="urn:extract"')).otherwise(plain)
    shown = F.when(k % 3 == 0, F.replace(F.replace(shown, F.lit("cad_number>"), F.lit("Cad_Number>")), F.lit("right_record>"), F.lit("RIGHT_RECORD>"))).otherwise(shown)
    return t.customer.select(*keep, F.concat(F.lit('<?xml version="1.0"?><!-- <cad_number>0:0:0:0</cad_number> -->'), shown).alias("value"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS m, * FROM customer)
SELECT '99/' || k AS extract_number, '2020-12-30' AS extract_date, CASE k % 7 WHEN 0 THEN '«Росреестр»' WHEN 1 THEN 'Росреестр & <Ко>' ELSE 'Росреестр' END AS organ, ['land', 'building', 'room', 'structure'][m + 1] AS object_type, '61:44:0050706:' || k AS cad_number, '61:44:0050706' AS quarter_cad_number,
 'г. Город, ' || c_mktsegment AS address, k + 0.25 AS cadastral_value, CASE WHEN k % 11 = 0 THEN 'deregistered' ELSE 'active' END AS lifecycle_status, '2015-03-04' AS registration_date, CASE WHEN m < 3 THEN CAST(k + 100 AS DOUBLE) END AS area, CASE m WHEN 0 THEN CAST(k % 7 AS DOUBLE) END AS area_error,
 CASE m WHEN 0 THEN 'Земли населенных пунктов' END AS land_category, CASE m WHEN 0 THEN c_mktsegment END AS permitted_uses, CASE m WHEN 0 THEN 'Земельный участок 61:44:0050706:' || k || ', ' || (k + 100) || '.0 кв.м' WHEN 1 THEN replace(c_name, '#', '&') END AS name,
 CASE m WHEN 1 THEN CAST(k % 30 - k % 2 AS INTEGER) END AS floors_above_ground, CASE m WHEN 1 THEN CAST(1900 + k % 100 AS INTEGER) END AS year_built, CASE m WHEN 2 THEN 'Жилое' END AS room_type, CASE m WHEN 2 THEN '61:44:0050706:' || (k + 1) END AS parent_cad_number, CASE m WHEN 3 THEN k + 0.5 END AS main_value, CASE m WHEN 3 THEN 'м' END AS main_unit,
 CASE WHEN k % 2 = 0 THEN 'okn_territory' ELSE 'czuit_zone' END || ':z1' || CASE m WHEN 3 THEN ';other:' ELSE '' END AS object_restrictions FROM c""")
def xml_objects(t: Tables) -> DataFrame:
    """SRC-04: header, object and its restrictions of four kinds of extracts."""
    columns = "extract_number extract_date organ object_type cad_number quarter_cad_number address cadastral_value lifecycle_status registration_date area area_error land_category permitted_uses name floors_above_ground year_built room_type parent_cad_number main_value main_unit"
    found = extracts.read_extracts(_lines(t, _documents(t), "xml"), "value", (*columns.split(), "object_restrictions"))
    zones = F.array_join(F.transform("object_restrictions", lambda r: F.concat(r["type"], F.lit(":"), F.coalesce(r["registry_number"], F.lit("")))), ";")
    return found.select(*columns.split(), zones.alias("object_restrictions"))


@query("""
WITH c AS (SELECT c_custkey AS k, * FROM customer)
SELECT '61:44:0050706:' || k AS cad_number, '61:44:0050706:' || k || '-1' AS right_number, CASE WHEN k % 5 <> 1 THEN 'right' WHEN k % 10 = 1 THEN 'restriction' ELSE 'encumbrance' END AS right_category, CASE k % 5 WHEN 0 THEN 'economic_mgmt' WHEN 1 THEN 'mortgage' ELSE 'ownership' END AS right_type_code, '2016-02-01' AS right_date, NULL AS valid_until,
 CASE WHEN k % 2 = 0 THEN '1/' || (k % 5 + 1) ELSE '2/7' END AS share, CASE WHEN k % 10 <> 1 THEN CASE k % 3 WHEN 0 THEN 'legal_entity|' || c_name || '|' || lpad(CAST(k AS VARCHAR), 10, '0') WHEN 1 THEN 'individual||' || lpad(CAST(k AS VARCHAR), 12, '0') ELSE 'public|Российская Федерация|' END ELSE '' END AS holders FROM c
UNION ALL SELECT '61:44:0050706:' || k, '61:44:0050706:' || k || '-2', CASE WHEN k % 2 = 0 THEN 'encumbrance' ELSE 'restriction' END, 'lease', NULL, '2030-01-01', NULL, CASE WHEN k % 2 = 0 THEN 'legal_entity|ООО|' ELSE '' END FROM c WHERE k % 6 <> 0""")
def xml_rights(t: Tables) -> DataFrame:
    """SRC-04: rights, encumbrances and their holders; of a private person the tax id only."""
    rows = extracts.read_extracts(_lines(t, _documents(t), "xml"), "value", ("cad_number", "rights")).select("cad_number", F.inline("rights"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    holders = F.array_join(F.transform("holders", lambda h: F.concat_ws("|", h["holder_type"], empty(h["name"]), empty(h["inn"]))), ";")
    share = F.concat_ws("/", _s("share_numerator"), _s("share_denominator"))
    return rows.select("cad_number", "right_number", "right_category", "right_type_code", "right_date", "valid_until", F.nullif(share, F.lit("")).alias("share"), holders.alias("holders"))


@query("""
SELECT CASE c_custkey % 5 WHEN 0 THEN 'not well-formed' WHEN 1 THEN 'not an extract' WHEN 2 THEN 'no cadastral number' WHEN 3 THEN 'no text' ELSE 'none' END AS problem, count(*) AS documents, count(*) FILTER (c_custkey % 5 = 4) AS objects FROM customer GROUP BY 1""")
def xml_problems(t: Tables) -> DataFrame:
    """SRC-04: documents that give no object are reported, each with what is wrong; none is half read."""
    k, text = F.col("c_custkey") % 5, F.col("value")
    cut = F.when(k == 0, F.expr("substring(value, 1, length(value) - 9)")).when(k == 1, F.lit("<kml><cad_number>1:2:3:4</cad_number></kml>")).when(k == 2, F.lit("<extract_about_property_land/>")).when(k == 3, F.lit("")).otherwise(text)
    documents = _documents(t, "c_custkey").select("c_custkey", cut.alias("value"))
    found = extracts.read_extracts(documents, "value", ("cad_number", "address"))
    kind = F.coalesce(F.regexp_extract("problem", "^[^:]+", 0), F.lit("none"))
    return found.groupBy(kind.alias("problem")).agg(F.count("*").alias("documents"), F.count(F.coalesce("cad_number", "address")).alias("objects"))


def _printed(t: Tables) -> DataFrame:
    """Pages of extracts, one extract for each customer: section 1 of four kinds, section 2 with a block for each order."""
    k, text = F.col("c_custkey"), lambda *parts: F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    kind = k % 4
    named = F.element_at(F.array(*map(F.lit, ("Земельный участок", "Здание", "Помещение", "Сооружение"))), (kind + 1).cast("int"))
    said = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    own = (
        F.when(kind == 0, text(F.concat(F.lit("Площадь: "), _s(k + 100), F.lit(" +/- "), _s(k % 7)), "Категория земель:", "Земли населенных пунктов", said("Виды разрешенного использования", F.col("c_mktsegment")), F.concat(F.lit("Кадастровые номера расположенных в пределах земельного участка объектов недвижимости: "), _cad(k + 1), F.lit(", "), _cad(k + 2))))
        .when(kind == 1, text(F.concat(F.lit("Площадь, м2: "), _s(k + 100), F.lit(",5")), "Назначение: Нежилое", said("Наименование", F.col("c_name")), F.concat(F.lit("Количество этажей, в том числе подземных этажей: "), _s(k % 30 + 2), F.lit(", в том числе подземных "), _s(k % 2)), said("Год завершения строительства", _s(1900 + k % 100)), F.concat(F.lit("Расположен в пределах "), _cad(k + 3))))
        .when(kind == 2, text(F.concat(F.lit("Площадь, м2: "), _s(k + 100)), "Вид жилого помещения: Квартира", "Наименование:", "данные отсутствуют", F.concat(F.lit("Кадастровые номера иных объектов недвижимости, в пределах которых расположен: "), _cad(k + 1))))
        .otherwise(text("Основная характеристика сооружения", "тип значение единица измерения", F.concat(F.lit("протяженность "), _s(k % 1000 + 1), F.lit(".5 в погонных метрах")), said("Наименование", F.col("c_name"))))
    )
    zone = F.when(k % 5 < 4, text(F.concat(F.lit("Земельный участок полностью расположен в границах зоны с реестровым номером 61:00-6."), _s(k)), F.when(k % 2 == 0, "вид/наименование: Территория памятника; тип: Иная").otherwise("вид/наименование: Охранная зона, тип: Охранная"), "дата решения: 01.02.2015, номер решения: 5-п", F.concat(F.lit("полностью расположен в границах зоны с реестровым номером 61:00-6."), _s(k)))).otherwise(text("Особые отметки:", "вид ограничения (обременения): Водоохранная зона; номер решения: 7", "вид ограничения (обременения): данные отсутствуют", "Получатель выписки: Иванов"))
    first = text(
        "Филиал публично-правовой компании «Роскадастр»  по области", F.when(k % 3 == 0, "Выписка об основных характеристиках").otherwise("Выписка об объекте недвижимости"), F.concat(F.lit("Раздел 1 Лист № 1 раздела 1\n30.12.2020г. № КУВИ-001/2020-"), _s(k)), F.concat(named, F.lit("\nвид объекта недвижимости")), "Всего листов выписки: 3 Всего разделов: 2",
        F.when(k % 2 == 0, said("Кадастровый номер", _cad(k))).otherwise(F.concat(F.lit("Кадастровый номер:\n"), _cad(k))), "Дата присвоения кадастрового номера: 04.03.2015", "Ранее присвоенный государственный учетный номер: Инвентарный номер 12- 3", F.concat(F.lit("Местоположение: г.  Город, "), F.col("c_mktsegment")), own,
        F.when(k % 7 == 0, "Кадастровая стоимость: не определена").otherwise(said("Кадастровая стоимость, руб.", F.concat(_s(k), F.lit(",25")))), F.concat(F.lit("Статус записи об объекте недвижимости: Сведения об объекте недвижимости имеют статус "), F.when(k % 11 == 0, '"Снят с учета"').otherwise('"Актуальные"')), zone,
    )
    n, o = F.col("o_orderkey") % 3, F.col("o_orderkey")
    numbered, day = F.concat(F.lit("61:44:0050706:31-61/001/2020-"), _s(o)), F.date_format("o_orderdate", "dd.MM.yyyy")
    block = (
        F.when(n == 0, text(F.concat(F.lit("2.1 Собственность, 1/"), _s(F.col("o_custkey") % 9 + 1)), F.concat(F.when(o % 2 == 0, "права: ").otherwise(""), numbered), day))
        .when(n == 1, text("4.1 вид: Ипотека", said("дата государственной регистрации", day), said("номер государственной регистрации", numbered), F.when(o % 2 == 0, "срок, на который установлено ограничение прав: с 01.02.2020 сроком на 5 лет"), "лицо, в пользу которого установлено ограничение прав:", F.concat(F.lit("Банк "), _s("o_custkey"), F.when(o % 4 < 2, ",\nИНН: 7700000001").otherwise("")), "основание государственной регистрации: Договор"))
        .otherwise(text("вид: Запрещение регистрации", said("номер государственной регистрации", numbered), said("дата государственной регистрации", day), "лицо, в пользу которого установлено ограничение прав: данные отсутствуют"))
    )
    blocks = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("blocks"))
    lines = F.split("blocks", "\n")
    # a page may end inside a block; the page after says nothing of its section
    half = F.floor(F.size(lines) / 2).cast("int")
    sheet = lambda n, c: F.struct(F.lit(n).alias("page"), c.alias("text"))
    second = F.concat(F.lit("Лист № 1 раздела 2\n"), F.array_join(F.slice(lines, 1, half), "\n"))
    third = F.array_join(F.concat(F.slice(lines, half + 1, F.size(lines)), F.array(F.lit("Договоры участия в долевом строительстве: вид: нет"))), "\n")
    sheets = F.array(sheet(1, first), sheet(2, second), sheet(3, third))
    return t.customer.join(blocks, "c_custkey", "left").select("c_custkey", F.inline(sheets)).where("text is not null")


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS m, * FROM customer)
SELECT k AS c_custkey, 'КУВИ-001/2020-' || k AS extract_number, '2020-12-30' AS extract_date, 'Филиал публично-правовой компании «Роскадастр» по области' AS organ, CASE WHEN k % 3 = 0 THEN 'brief' ELSE 'full' END AS template, CAST(3 AS INTEGER) AS total_sheets, '61:44:0050706:' || k AS cad_number,
 ['land', 'building', 'room', 'structure'][m + 1] AS object_type, 'г. Город, ' || c_mktsegment AS address, '2015-03-04' AS registration_date, 'Инвентарный номер 12-3' AS old_numbers, CASE m WHEN 1 THEN k + 100.5 WHEN 3 THEN NULL ELSE CAST(k + 100 AS DOUBLE) END AS area, CASE m WHEN 0 THEN CAST(k % 7 AS DOUBLE) END AS area_error,
 CASE m WHEN 0 THEN 'Земли населенных пунктов' END AS land_category, CASE m WHEN 0 THEN c_mktsegment END AS permitted_uses, CASE WHEN k % 7 <> 0 THEN k + 0.25 END AS cadastral_value, CASE WHEN k % 11 = 0 THEN 'deregistered' ELSE 'active' END AS lifecycle_status, CASE WHEN k % 11 = 0 THEN 'Снят с учета' ELSE 'Актуальные' END AS status_text,
 CASE m WHEN 0 THEN '61:44:0050706:' || (k + 1) || '; 61:44:0050706:' || (k + 2) END AS nested_objects, CASE m WHEN 0 THEN 'Земельный участок 61:44:0050706:' || k || ', ' || (k + 100) || '.0 кв.м' WHEN 2 THEN NULL ELSE c_name END AS name, CASE m WHEN 1 THEN 'Нежилое' END AS purpose, CASE m WHEN 1 THEN CAST(k % 30 + 2 - k % 2 AS INTEGER) END AS floors_above_ground,
 CASE m WHEN 1 THEN CAST(1900 + k % 100 AS INTEGER) END AS year_built, CASE m WHEN 2 THEN 'Квартира' END AS room_type, CASE m WHEN 2 THEN '61:44:0050706:' || (k + 1) END AS parent_cad_number, CASE m WHEN 1 THEN '61:44:0050706:' || (k + 3) END AS land_cad_numbers, CASE m WHEN 3 THEN 'протяженность' END AS main_type, CASE m WHEN 3 THEN k % 1000 + 1.5 END AS main_value, CASE m WHEN 3 THEN 'в погонных метрах' END AS main_unit FROM c""")
def printed_objects(t: Tables) -> DataFrame:
    """SRC-05: header and section 1 of four kinds of objects, values beside their label or below it."""
    found = pages.printed_objects(pages.printed_lines(_printed(t), "c_custkey", "page", "text"))
    columns = "extract_number extract_date organ template total_sheets cad_number object_type address registration_date old_numbers area area_error land_category permitted_uses cadastral_value lifecycle_status status_text nested_objects name purpose floors_above_ground year_built room_type parent_cad_number land_cad_numbers main_type main_value main_unit"
    return found.select(F.col("document").alias("c_custkey"), *columns.split())


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'encumbrance' WHEN o_orderkey % 3 = 2 THEN 'restriction' ELSE 'right' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN '1/' || (o_custkey % 9 + 1) END AS share, '61:44:0050706:31-61/001/2020-' || o_orderkey AS right_number, strftime(o_orderdate, '%Y-%m-%d') AS right_date, CASE WHEN o_orderkey % 3 = 1 THEN 'Банк ' || o_custkey END AS beneficiary,
 ['ownership', 'mortgage', 'prohibition'][o_orderkey % 3 + 1] AS code, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN '2025-02-01' END AS valid_until, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 < 2 THEN '7700000001' END AS inn, '61:44:0050706:' || o_custkey AS cad_number FROM orders""")
def pdf_rights(t: Tables) -> DataFrame:
    """SRC-05: blocks of section 2 of any number of lines, also across pages; what isn't about a right falls away."""
    rows = pages.printed_rights(pages.printed_lines(_printed(t), "c_custkey", "page", "text"))
    share = F.nullif(F.concat_ws("/", _s("share_numerator"), _s("share_denominator")), F.lit(""))
    order = F.regexp_extract("right_number", r"(\d+)$", 1).cast("long")
    return rows.select(order.alias("o_orderkey"), F.col("right_category").alias("category"), share.alias("share"), "right_number", "right_date", F.col("beneficiary_name").alias("beneficiary"), F.col("right_type_code").alias("code"), "valid_until", F.col("beneficiary_inn").alias("inn"), "cad_number")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 < 4 THEN 'okn_territory' ELSE 'czuit_zone' END AS type, CASE WHEN c_custkey % 5 = 4 THEN 'Водоохранная зона; номер решения: 7' WHEN c_custkey % 2 = 0 THEN 'Территория памятника' ELSE 'Охранная зона' END AS description, CASE WHEN c_custkey % 5 < 4 THEN '61:00-6.' || c_custkey END AS registry_number,
 CASE WHEN c_custkey % 5 = 4 THEN '7' ELSE '5-п' END AS document_number, CASE WHEN c_custkey % 5 < 4 THEN '2015-02-01' END AS document_date FROM customer""")
def printed_restrictions(t: Tables) -> DataFrame:
    """SRC-05: zones of an object by number, each once; special notes where there is none."""
    found = pages.printed_restrictions(pages.printed_lines(_printed(t), "c_custkey", "page", "text"))
    return found.select(F.col("document").alias("c_custkey"), "type", "description", "registry_number", "document_number", "document_date")


def _numbered(df: DataFrame, key: str, first: Column, lines: list[tuple[str, Column | str | None]]) -> DataFrame:
    """Table lines of a document, numbered on from first; a line whose value is NULL isn't there."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for i, (f, v) in enumerate(lines)))
    return df.select(F.col(key).alias("document"), first.alias("first"), F.inline(cells)).where("value is not null").select("document", (F.col("first") + F.col("i")).alias("no"), "field", "value")


def _tax_lines(t: Tables) -> DataFrame:
    """An entry of the register of legal entities for each customer: a block of a founder or a director for each order."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    n, pledged, person = o % 3, (o % 6 == 0), "ГРН и дата внесения в ЕГРЮЛ сведений о данном лице"
    when = lambda c, v: F.when(c, v)
    head = _numbered(t.customer, "c_custkey", F.lit(0).cast("long"), [
        ("Полное наименование на русском языке", F.concat(F.lit("ООО\n"), F.col("c_name"))), ("ОГРН", F.concat(F.lit("1 "), F.lpad(_s(k), 12, "0"))), ("Дата присвоения ОГРН", "4.3.2015"), ("Адрес юридического лица", F.concat(F.lit("г.  Город,\n"), F.col("c_mktsegment"), F.lit(", "))), ("ИНН юридического лица", F.lpad(_s(k), 10, "0")), ("Размер (в рублях)", "10 000,50"),
    ])
    blocks = _numbered(t.orders, "o_custkey", o * 100 + 1000, [
        (person, "1 / 2"), ("Фамилия  Имя\nОтчество", when(n > 0, "ПЕТРОВ\nПЁТР")), ("ОГРН", when(n == 0, F.concat(F.lit("1 "), F.lpad(_s(o), 12, "0")))), ("ИНН", F.lpad(_s(o), 12, "0")), ("Полное наименование", when(n == 0, F.concat(F.lit("ООО "), _s(o)))), ("Должность", when(n == 1, "Директор")),
        ("Номинальная стоимость доли (в рублях)", when(n == 0, "1 000,5")), ("Размер доли (в процентах)", when(n != 1, _s(o % 100))),
        ("Сведения об обременении", when(pledged, "")), ("Сведения о договоре залога", when(pledged, F.concat(F.lit("Номер договора залога: 1 2-"), _s(o), F.lit("\nДата договора залога: 5.06.2020")))), ("Сведения о нотариусе, удостоверившем договор залога", when(pledged, "ИВАНОВ\nИВАН\nИВАНОВИЧ")),
        ("Сведения о залогодержателе", when(pledged, "")), (person, when(pledged, "3")), ("ОГРН", when(pledged, F.lpad(_s("o_custkey"), 13, "9"))), ("Полное наименование", when(pledged, "Банк\nДон")),
    ])
    tail = _numbered(t.customer, "c_custkey", F.lit(10**15), [("Код и наименование вида деятельности", "01.11 Выращивание\nзерна"), ("Код и наименование вида деятельности", "46.2 Торговля"), ("Код и наименование вида деятельности", "без кода"), ("ОГРН", "0"), ("Полное наименование на русском языке", "второе")])
    return head.unionByName(blocks).unionByName(tail)


@query("""
SELECT o_custkey AS c_custkey, ['legal', 'director', 'person'][o % 3 + 1] AS kind, CASE WHEN o % 3 = 0 THEN 'ООО ' || o ELSE 'Петров Пётр' END AS name, lpad(CAST(o AS VARCHAR), 12, '0') AS inn, CASE WHEN o % 3 = 0 THEN '1' || lpad(CAST(o AS VARCHAR), 12, '0') END AS ogrn, CASE WHEN o % 3 = 1 THEN 'Директор' END AS position,
 CASE WHEN o % 3 = 0 THEN 1000.5 END AS share_nominal, CASE WHEN o % 3 <> 1 THEN CAST(o % 100 AS DOUBLE) END AS share_percent, CASE WHEN o % 6 = 0 THEN '12-' || o END AS contract_number, CASE WHEN o % 6 = 0 THEN '2020-06-05' END AS contract_date, CASE WHEN o % 6 = 0 THEN 'Иванов Иван Иванович' END AS notary,
 CASE WHEN o % 6 = 0 THEN 'Банк Дон' END AS holder_name, CASE WHEN o % 6 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 13, '9') END AS holder_ogrn FROM (SELECT o_orderkey AS o, o_custkey FROM orders)""")
def tax_members(t: Tables) -> DataFrame:
    """SRC-11: directors and founders of legal entities, with the pledges of their shares."""
    found = tax_extracts.legal_entities(_tax_lines(t), "document", "no", "field", "value")
    rows = found.select(F.col("document").alias("c_custkey"), F.inline(F.concat("directors", "founders")))
    p = F.get("pledges", F.lit(0))
    return rows.select("c_custkey", "kind", "name", "inn", "ogrn", "position", "share_nominal", "share_percent", p["contract_number"].alias("contract_number"), p["contract_date"].alias("contract_date"), p["notary"].alias("notary"), p["holder"]["name"].alias("holder_name"), p["holder"]["ogrn"].alias("holder_ogrn"))


@query("""
SELECT c_custkey, 'ООО ' || c_name AS name_full, '1' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS ogrn, '2015-03-04' AS reg_date, 'г. Город, ' || c_mktsegment AS address, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS inn, CAST(10000 AS BIGINT) AS capital, '01.11' AS activity, 'Выращивание зерна' AS activity_name, '46.2' AS others,
 CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 1) AS INTEGER) AS directors, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 <> 1) AS INTEGER) AS founders FROM customer""")
def tax_entities(t: Tables) -> DataFrame:
    """SRC-11: a legal entity's own fields, of which the first line counts, and its activities."""
    found = tax_extracts.legal_entities(_tax_lines(t), "document", "no", "field", "value")
    return found.select(F.col("document").alias("c_custkey"), "name_full", "ogrn", "reg_date", "address", "inn", "capital", F.col("activity_main.code").alias("activity"), F.col("activity_main.name").alias("activity_name"), F.array_join(F.transform("activities_other", lambda a: a["code"]), ",").alias("others"), F.size("directors").alias("directors"), F.size("founders").alias("founders"))


@query("""
SELECT s_suppkey, 'Петрова Анна Ивановна оглы' AS name_full, 'Петрова' AS last_name, 'Анна' AS first_name, 'Ивановна оглы' AS patronymic, 'женский' AS gender, '3' || lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS ogrn, lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS inn, '2020-01-02' AS reg_date, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '@x' END AS email, '47.1' AS activity FROM supplier""")
def tax_traders(t: Tables) -> DataFrame:
    """SRC-11: sole traders of the other register."""
    k = F.col("s_suppkey")
    lines = _numbered(t.supplier, "s_suppkey", F.lit(1).cast("long"), [
        ("Фамилия Имя Отчество", "ПЕТРОВА\nАННА\nИВАНОВНА ОГЛЫ"), ("Пол", "Женский"), ("ОГРНИП", F.concat(F.lit("3"), F.lpad(_s(k), 14, "0"))), ("Дата регистрации", "2.1.2020"), ("Идентификационный номер налогоплательщика (ИНН)", F.lpad(_s(k), 12, "0")), ("E-mail", F.when(k % 2 == 0, F.concat("s_name", F.lit("@x")))), ("Код и наименование вида деятельности", "47.1 Торговля"), ("Пол", "мужской"),
    ])
    found = tax_extracts.sole_traders(lines, "document", "no", "field", "value")
    return found.select(F.col("document").alias("s_suppkey"), "name_full", "last_name", "first_name", "patronymic", "gender", "ogrn", "inn", "reg_date", "email", F.col("activity_main.code").alias("activity"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, CASE WHEN l_linenumber <= 3 THEN '01.01' ELSE '01.К' END AS account FROM lineitem)
SELECT l_orderkey, account, name, kind, round(amount, 2) AS amount FROM (
 SELECT l_orderkey, account, 'p' || l_linenumber AS name, 'initial' AS kind, l_quantity AS amount FROM r UNION ALL SELECT l_orderkey, account, 'p' || l_linenumber, 'residual', CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END FROM r
 UNION ALL SELECT l_orderkey, account, 'p' || l_linenumber, CASE account WHEN '01.К' THEN 'lease_annual' ELSE 'writeoff' END, l_tax FROM r) WHERE amount IS NOT NULL""")
def ledger_valuations(t: Tables) -> DataFrame:
    """SRC-06: rows under their section's account, up to three amounts of each."""
    rows = t.lineitem.select(_s("l_orderkey").alias("file"), (F.col("l_linenumber") * 10).alias("n"), F.lit(None).cast("string").alias("mark"), F.concat(F.lit("p"), _s("l_linenumber")).alias("name"), F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("b"), F.col("l_tax").alias("c"))
    files = t.lineitem.select(_s("l_orderkey").alias("file")).distinct()
    heads = files.select("file", F.inline(F.array(F.struct(F.lit(5).alias("n"), F.lit("01.01").alias("mark")), F.struct(F.lit(35).alias("n"), F.lit("01.К").alias("mark")))))
    sheet = rows.unionByName(heads, allowMissingColumns=True)
    found = readers.valuations(readers.ledger_rows(sheet, "n", "mark", "name", ["01.01", "01.К"]), "a", "b", "c", "account")
    return found.select(F.col("file").cast("long").alias("l_orderkey"), "account", "name", "kind", F.round("amount", 2).alias("amount"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT o_custkey AS file, i AS record, '01' AS account, 'n' || o_orderkey AS name, round(o_totalprice, 2) AS book, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice * 2, 2) END AS tax, round(o_totalprice * 3, 2) AS difference FROM o""")
def ledger_records(t: Tables) -> DataFrame:
    """SRC-26: rows of three kinds folded into records, the account carried on from the first one."""
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("file"), k.alias("k"), F.inline(F.array(F.struct((k * 3).alias("n"), F.lit("БУ").alias("label"), F.concat(F.lit("n"), _s(k)).alias("name"), F.col("o_totalprice").alias("v")), F.struct((k * 3 + 1).alias("n"), F.lit("НУ").alias("label"), F.lit(None).cast("string").alias("name"), (F.col("o_totalprice") * 2).alias("v")), F.struct((k * 3 + 2).alias("n"), F.lit("ВР").alias("label"), F.lit(None).cast("string").alias("name"), (F.col("o_totalprice") * 3).alias("v")))))
    first = F.min("k").over(Window.partitionBy("file"))
    sheet = rows.where("not (label = 'НУ' and k % 2 <> 0)").withColumn("account", F.when((F.col("k") == first) & (F.col("label") == "БУ"), "01"))
    out = readers.ledger_triples(sheet, "n", "label", ["v"])
    return out.select("file", "record", "account", "name", *(F.round(f"{c}.v", 2).alias(c) for c in ("book", "tax", "difference")))


@query("SELECT c_custkey, c_name AS tenant, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS purpose, CASE WHEN c_custkey % 2 = 0 THEN '2020-02-01' END AS valid_from, CASE WHEN c_custkey % 2 = 1 THEN 'бессрочно' END AS description, NULL::VARCHAR AS area FROM customer")
def lease_table(t: Tables) -> DataFrame:
    """SRC-07/08/24/25: columns found by words in their headings, cleaned values, terms."""
    k = F.col("c_custkey")
    sheet = t.customer.select(_s(k).alias("№ п/п"), F.col("c_name").alias("Наименование арендатора"), F.when(k % 3 == 0, "нет данных").otherwise(F.col("c_mktsegment")).alias("Целевое назначение"), F.when(k % 2 == 0, "с 01.02.2020").otherwise("Бессрочно").alias("Срок аренды"))
    rows = readers.lease_rows(sheet, {"c_custkey": ["№"], "tenant": ["арендатор"], "purpose": ["вид", "назначение"], "term": ["срок"], "area": ["площадь"]})
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "tenant", "purpose", _s("term.valid_from").alias("valid_from"), "term.description", "area")


def _map_files(t: Tables, placemarks: DataFrame) -> str:
    """(nation, value) as one map file for each nation."""
    path = scratch_path(t.spark, "kml")
    files = placemarks.groupBy("nation").agg(_tag("kml", F.array_join(F.collect_list("value"), "")).alias("value"))
    files.write.partitionBy("nation").text(path)
    return path


def _placemarks(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Здание "), _s(k))).when(k % 3 == 1, F.concat(F.lit("61:44:0050706:"), _s(k), F.lit(":1"))).otherwise(F.concat(F.lit("точка "), _s(k)))
    ring = F.concat(F.lit("0.0,0.0,0 "), _s(k), F.lit(".0,0.0,0 1.0,1.0,0"))
    return t.customer.select(F.col("c_nationkey").alias("nation"), _tag("Placemark", _tag("name", name), _tag("description", F.concat(F.lit("key: "), _s(k), F.lit("; вид: a: b"))), _tag("Polygon", _tag("coordinates", ring))).alias("value"))


@query("""
SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'Здание' WHEN 1 THEN 'Помещение' END AS kind, 'a: b' AS sort, 3 AS points, CAST(c_custkey AS DOUBLE) AS east FROM customer""")
def kml_placemarks(t: Tables) -> DataFrame:
    """SRC-09/21: placemarks of map files, their descriptions, outlines and kinds."""
    path = _map_files(t, _placemarks(t))
    rows = readers.xml_records(t.spark, path, "Placemark", "name string, description string, Polygon struct<coordinates:string>")
    found = readers.placemarks(rows.select("name", "description", F.col("Polygon.coordinates").alias("coordinates")), "name", "description", "coordinates", {"здание": "Здание"})
    return found.select(F.col("attrs")["key"].cast("long").alias("key"), "kind", F.col("attrs")["вид"].alias("sort"), F.size("ring").alias("points"), F.col("ring")[1][0].alias("east"))


@query("SELECT n_nationkey AS archive, 'doc.kml' AS name, '<name>' || n_name || '</name>' AS content FROM nation")
def kmz_entries(t: Tables) -> DataFrame:
    """SRC-09: entries of archives; those of another kind are passed over."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr("doc.kml", text)
                    z.writestr("photo.jpg", "x")
                out.append((path, raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    archives = t.nation.select(_s("n_nationkey").alias("path"), _tag("name", F.col("n_name")).alias("text")).mapInPandas(zipped, "path string, content binary")
    return readers.unzip(archives).select(F.col("path").cast("int").alias("archive"), "name", F.col("content").cast("string").alias("content"))


@query("""
SELECT CASE WHEN n_regionkey % 2 = 0 OR n_nationkey % 3 <> 0 THEN 'cad' || n_nationkey ELSE 'none' END AS cad, n_name AS name FROM nation""")
def keyed_objects(t: Tables) -> DataFrame:
    """SRC-10/14/16: whole JSON files that hold a list, or an object with a list; an entry without a key takes the file's name."""
    path = scratch_path(t.spark, "json")
    entry = F.to_json(F.struct(F.when((F.col("n_regionkey") % 2 == 0) | (F.col("n_nationkey") % 3 != 0), F.concat(F.lit("cad"), _s("n_nationkey"))).alias("cad"), F.col("n_name").alias("name")))
    lists = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(entry), ",").alias("items"))
    body = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit('{"objects": ['), "items", F.lit("]}")))
    lists.select(body.alias("value"), F.col("n_regionkey").alias("r")).write.partitionBy("r").text(path)
    files = readers.json_files(t.spark, path, ".txt")
    return readers.keyed_json(files, "text", "stem").select(F.when(F.col("cad").startswith("part-"), "none").otherwise(F.col("cad")).alias("cad"), F.get_json_object("body", "$.name").alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * round(p_size + 30 / 60.0 + 36 / 3600.0, 6) AS lat, round(p_size / 2.0 + 6 / 60.0, 6) AS lon FROM part")
def photo_points(t: Tables) -> DataFrame:
    """SRC-13: degrees of a photo's place."""
    n = F.col("p_size").cast("double")
    p = readers.exif_point(F.array(n, F.lit(30.0), F.lit(36.0)), F.when(F.col("p_size") % 2 == 0, "S").otherwise("N"), F.array(n / 2, F.lit(6.0), F.lit(0.0)), F.lit("E"))
    return t.part.select("p_partkey", F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon"))


@query("SELECT 'c' || c_custkey AS cad, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS label, 2 AS points, CAST(c_nationkey AS DOUBLE) AS x FROM customer")
def session_contours(t: Tables) -> DataFrame:
    """SRC-15: contours of session files in two layouts."""
    ring = F.array(F.array(F.col("c_nationkey").cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0)))
    cad = F.concat(F.lit("c"), _s("c_custkey"))
    body = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array(F.struct(cad.alias("cn"), ring.alias("contour"), F.col("c_name").alias("label"))))).otherwise(F.to_json(F.create_map(cad, ring)))
    out = readers.contour_records(_lines(t, t.customer.select(body.alias("value")), "contours"), "value")
    return out.select("cad", "label", F.size("ring").alias("points"), F.col("ring")[0][0].alias("x"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def cross_database(t: Tables) -> DataFrame:
    """SRC-17: a table of another database of the session."""
    t.nation.createOrReplaceGlobalTempView("registry_nations")
    other = readers.optional_table(t.spark, "global_temp.registry_nations", t.nation.schema)
    return t.supplier.join(F.broadcast(other.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("""
SELECT p_partkey, 'name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'area', CAST(p_size AS VARCHAR) || ' кв.м' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'area', CAST(p_size + 1 AS VARCHAR) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 = 0""")
def portal_attributes(t: Tables) -> DataFrame:
    """SRC-18/27: attributes under their own names; hidden and empty ones fall away, the first alias that is stated wins."""
    k = F.col("p_partkey")
    attrs = F.create_map(F.lit("Наименование"), F.col("p_name"), F.lit("Площадь"), F.when(k % 2 == 0, F.concat(_s("p_size"), F.lit(" кв.м"))).otherwise("-"), F.lit("Площадь общая"), F.when(k % 3 == 0, _s(F.col("p_size") + 1)).otherwise("***"), F.lit("Прочее"), F.lit("x"))
    return readers.attributes(t.part.select("p_partkey", attrs.alias("attrs")), "p_partkey", "attrs", {"Наименование": "name", "Площадь": "area", "Площадь общая": "area"})


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS area, 1900 + p_size AS year, CASE WHEN p_size > 9 THEN p_size END AS floors FROM part")
def portal_values(t: Tables) -> DataFrame:
    """SRC-18: numbers of portal texts."""
    n = _s("p_size")
    v = readers.portal_numbers(F.concat(n, F.lit(",5 кв. м")), F.concat(F.lit("в "), _s(F.col("p_size") + 1900), F.lit(" году")), F.when(F.col("p_size") > 9, F.concat(n, F.lit(" этажей"))).otherwise("нет"))
    return t.part.select("p_partkey", v["area"].alias("area"), v["year"].cast("int").alias("year"), v["floors"].alias("floors"))


@query("""
SELECT 'objects' AS stream, o_orderkey AS cad, NULL::BIGINT AS line FROM orders UNION ALL SELECT CASE WHEN l_returnflag = 'N' THEN 'rights' ELSE 'encumbrances' END, l_orderkey, l_linenumber FROM lineitem""")
def registry_tables(t: Tables) -> DataFrame:
    """SRC-19: an extract's table of rights as objects, rights and encumbrances."""
    own = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "N", "right").otherwise("encumbrance").alias("category"), _s("l_linenumber").alias("number"), F.lit("x").alias("type"), _s("l_suppkey").alias("holder"))).alias("rights"))
    docs = t.orders.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_s("o_orderkey").alias("number"), F.lit("2020-01-01").alias("day"), F.col("o_orderkey").alias("cad"), "rights")
    objects, rights, encumbrances = readers.registry_streams(docs)
    rows = lambda df, name: df.select(F.lit(name).alias("stream"), "cad", F.col("right_number").cast("long").alias("line"))
    return objects.select(F.lit("objects").alias("stream"), "cad", F.lit(None).cast("long").alias("line")).unionByName(rows(rights, "rights")).unionByName(rows(encumbrances, "encumbrances"))


@query("SELECT c_custkey, 'cultural_heritage' AS type, c_mktsegment AS text FROM customer WHERE c_custkey % 3 = 0")
def heritage_objects(t: Tables) -> DataFrame:
    """SRC-20: an encumbrance where the portal speaks of heritage."""
    k = F.col("c_custkey")
    attrs = F.create_map(F.lit("heritage"), F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, "—").otherwise("доступно в отчете"))
    return readers.heritage_encumbrances(t.customer.select("c_custkey", attrs.alias("attrs")), "c_custkey", "attrs")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '61:44:0050706:' || c_custkey ELSE 'cert::' || substr(sha1('n' || c_custkey || chr(0) || '01.02.2003' || chr(0)), 1, 16) END AS object_key, '2003-02-01' AS right_date, CASE WHEN c_custkey % 3 = 0 THEN 'legal_entity' ELSE 'unknown' END AS holder_type FROM customer""")
def certificate_objects(t: Tables) -> DataFrame:
    """SRC-22: an object keyed by its id, else by its certificate."""
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("кн: 61:44:0050706:"), _s(k))).alias("cad"), F.concat(F.lit("n"), _s(k)).alias("number"), F.when(k % 3 == 0, F.lit("Учреждение культуры")).otherwise(F.col("c_mktsegment")).alias("holder"), F.lit("01.02.2003").alias("day"))
    return readers.certificates(rows, "cad", "number", "holder", "day").select("c_custkey", "object_key", "right_date", "holder_type")


@query("SELECT l_orderkey AS entity, 'f' || l_suppkey AS name, CAST(l_linenumber AS VARCHAR) AS share FROM lineitem WHERE l_linenumber <> 3")
def entity_founders(t: Tables) -> DataFrame:
    """SRC-23/28: founders of an entity; one that is known to be inactive falls away."""
    n = F.col("l_linenumber")
    one = F.struct(F.concat(F.lit("f"), _s("l_suppkey")).alias("name"), F.lit(None).cast("string").alias("inn"), _s(n).alias("share"), F.when(n == 3, False).when(n == 2, True).alias("active"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("founders"))
    return readers.founders(docs, "l_orderkey", "founders").select("entity", "name", "share")


@query("SELECT 'c' || c_custkey AS id, 'node' AS part, c_name AS label FROM customer UNION ALL SELECT 'c' || c_custkey || '>n' || c_nationkey, 'edge', 'part_of' FROM customer")
def graph_files(t: Tables) -> DataFrame:
    """SNK-01: a graph as files of nodes and edges, read back."""
    path = scratch_path(t.spark, "graph")
    nodes = t.customer.select(F.concat(F.lit("c"), _s("c_custkey")).alias("id"), F.col("c_name").alias("label"))
    edges = t.customer.select(F.concat(F.lit("c"), _s("c_custkey")).alias("src"), F.concat(F.lit("n"), _s("c_nationkey")).alias("dst"), F.lit("part_of").alias("kind"))
    sinks.write_graph(nodes, edges, path)
    back = lambda name, schema: t.spark.read.schema(schema).json(f"{path}/{name}")
    n = back("nodes", "id string, label string").select("id", F.lit("node").alias("part"), "label")
    e = back("edges", "src string, dst string, kind string").select(F.concat_ws(">", "src", "dst").alias("id"), F.lit("edge").alias("part"), F.col("kind").alias("label"))
    return n.unionByName(e)


@query("SELECT o_orderkey, count(*) AS nodes, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def graph_documents(t: Tables) -> DataFrame:
    """SNK-01: one document for the graph of each object."""
    nodes = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("id"))
    edges = t.orders.select("o_orderkey", F.lit("x").alias("kind"))
    docs = sinks.graph_document(nodes, edges, "o_orderkey")
    ids = F.from_json(F.get_json_object("document", "$.nodes"), "array<struct<id:int>>")
    return docs.select("o_orderkey", F.size(ids).cast("long").alias("nodes"), F.aggregate(F.transform(ids, lambda x: x["id"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("numbers"))


@query("SELECT 'suppliers' AS sheet, s_name AS name, round(s_acctbal, 2) AS amount FROM supplier UNION ALL SELECT 'parts', p_name, round(p_retailprice, 2) FROM part")
def workbook_sheets(t: Tables) -> DataFrame:
    """SNK-03: a sheet for each query, read back."""
    path = scratch_path(t.spark, "sheets")
    sheets = {"suppliers": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount")), "parts": t.part.select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount"))}
    sinks.write_sheets(sheets, path)
    read = [t.spark.read.option("header", "true").schema("name string, amount double").csv(f"{path}/{n}").select(F.lit(n).alias("sheet"), "name", F.round("amount", 2).alias("amount")) for n in sheets]
    return read[0].unionByName(read[1])


@query("SELECT c_custkey, c_mktsegment AS project, c_name AS name FROM customer")
def profile_files(t: Tables) -> DataFrame:
    """SNK-05: profiles in a folder for each project, read back with the folder's name."""
    path = scratch_path(t.spark, "profiles")
    sinks.write_profiles(t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("project")), "project", path)
    return t.spark.read.schema("c_custkey long, name string, project string").json(path).select("c_custkey", "project", "name")


@query("SELECT c_name AS name, c_mktsegment || ' & co' AS description, CAST(c_nationkey AS DOUBLE) AS x FROM customer")
def kml_written(t: Tables) -> DataFrame:
    """SNK-06: placemarks written and read back; markup in texts survives."""
    ring = F.array(F.array(F.col("c_nationkey").cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(1.0)))
    path = _map_files(t, t.customer.select(F.col("c_nationkey").alias("nation"), sinks.placemark(F.col("c_name"), F.concat("c_mktsegment", F.lit(" & co")), ring).alias("value")))
    rows = readers.xml_records(t.spark, path, "Placemark", "name string, description string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>")
    return rows.select("name", "description", F.split("Polygon.outerBoundaryIs.LinearRing.coordinates", ",")[0].cast("double").alias("x"))


@query("SELECT event_id, event_type AS action FROM events")
def audit_log(t: Tables) -> DataFrame:
    """SNK-08: two batches appended to one log."""
    path = scratch_path(t.spark, "audit")
    rows = t.events.select("event_id", F.col("event_type").alias("action"))
    sinks.append_audit(rows.where("event_type in ('view', 'click')"), path)
    sinks.append_audit(rows.where("event_type not in ('view', 'click')"), path)
    return t.spark.read.schema("event_id long, action string").json(path)


@query('SELECT \'customer\' AS "table", count(*) AS rows FROM customer UNION ALL SELECT \'orders\', count(*) FROM orders')
def bundle_written(t: Tables) -> DataFrame:
    """SNK-04: a bundle of tables with its manifest, read back; the same tables in other partitions give the same id."""
    a, b = scratch_path(t.spark, "bundle"), scratch_path(t.spark, "bundle")
    tables = {"customer": t.customer, "orders": t.orders}
    same = sinks.write_bundle(tables, a) == sinks.write_bundle({n: df.repartition(3) for n, df in tables.items()}, b)
    return t.spark.read.schema("table string, rows long, digest string").json(f"{a}/manifest").where(F.lit(same)).select("table", "rows")


@query("""
SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_size + 0.51), 6) AS gps_lat, round(p_partkey % 170 + 0.25, 6) AS gps_lon, CASE WHEN p_size % 3 <> 0 THEN p_size * 1.5 END AS bearing, strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') || ' 10:20:30' AS taken,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || '/' || p_name END AS loc_path FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0""")
def photo_files(t: Tables) -> DataFrame:
    """SRC-13: facts of photos from their bytes, in both byte orders; every fifth is cut off within its segment."""
    k, size = F.col("p_partkey"), F.col("p_size")
    comment = F.when(k % 4 == 0, "[1]").otherwise(F.to_json(F.struct(F.lit("gpp").alias("app"), F.struct(F.concat_ws("/", "p_brand", "p_name").alias("path")).alias("loc"))))
    taken = F.concat(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), size), "yyyy:MM:dd"), F.lit(" 10:20:30"))
    made = photos.photos(t.part.select("p_partkey", "p_size", "p_brand", "p_name"), F.when(size % 2 == 0, -1).otherwise(1) * (size + 0.51), k % 170 + 0.25, F.when(size % 3 != 0, size * 1.5), taken, comment, k % 2 == 0)
    path = scratch_path(t.spark, "photos")
    made.select("p_partkey", F.when(k % 5 == 0, F.substring("content", 1, 12)).otherwise(F.col("content")).alias("content")).write.parquet(path)
    found = photos.photo_facts(t.spark.read.parquet(path), "content", app="gpp")
    return found.select("p_partkey", F.round("gps_lat", 6).alias("gps_lat"), F.round("gps_lon", 6).alias("gps_lon"), "bearing", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "loc_path")


def _read_back(t: Tables, chunks: DataFrame, name: str) -> DataFrame:
    path = scratch_path(t.spark, name)
    chunks.write.parquet(path)
    return t.spark.read.schema(chunks.schema).parquet(path)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS archive, 'customer.jsonl' AS path, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS sha256, CAST(NULL AS VARCHAR) AS problem FROM customer
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders.jsonl', sha256(string_agg('{"c_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}', chr(10) ORDER BY '{"c_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}')), NULL FROM orders GROUP BY o_custkey""")
def bundle_archives(t: Tables) -> DataFrame:
    """SNK-04: a zip file for each customer with its rows of two tables and a manifest of their hashes, written and read back."""
    tables = {"customer": t.customer.select("c_custkey", "c_name"), "orders": t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")}
    chunks = _read_back(t, archives.zip_entries(archives.slices(tables, "c_custkey"), "archive", "path", "content"), "bundles")
    return archives.read_entries(chunks).select("archive", "path", "sha256", "problem")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS archive, c_name AS name, c_mktsegment || ' & co' AS description FROM customer")
def kmz_written(t: Tables) -> DataFrame:
    """SNK-06: the placemarks of each nation as a KMZ file, read back from its one entry."""
    ring = F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(1.0)))
    marks = t.customer.select("c_nationkey", sinks.placemark(F.col("c_name"), F.concat("c_mktsegment", F.lit(" & co")), ring).alias("mark"))
    documents = marks.groupBy("c_nationkey").agg(F.concat(F.lit("<kml>"), F.array_join(F.collect_list("mark"), ""), F.lit("</kml>")).alias("kml"))
    chunks = _read_back(t, archives.zip_entries(documents.withColumn("path", F.lit("doc.kml")), "c_nationkey", "path", "kml", manifest=False), "kmz")
    entries = archives.read_entries(chunks).select("archive", F.col("content").cast("string").alias("kml"))
    found = entries.select("archive", F.inline(F.arrays_zip(F.expr("xpath(kml, '//Placemark/name/text()')").alias("name"), F.expr("xpath(kml, '//Placemark/description/text()')").alias("description"))))
    return found.select("archive", "name", "description")


@query("""
SELECT CAST(s_nationkey AS VARCHAR) AS archive, 'Suppliers' AS sheet, s_name AS name, round(s_acctbal, 2) AS amount FROM supplier UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'Customers & co', c_name, round(c_acctbal, 2) FROM customer""")
def workbook_files(t: Tables) -> DataFrame:
    """SNK-03: a workbook with two sheets for each nation as an XLSX file, read back cell by cell."""
    a = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    b = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    grid = sheets.grid_of(a, "nation", "Suppliers", ["name"], ["name", "amount"], 1).unionByName(sheets.grid_of(b, "nation", "Customers & co", ["name"], ["name", "amount"], 2))
    files = sinks.joined_chunks(_read_back(t, sheets.write_workbooks(grid), "workbooks"))
    cells = sheets.read_cells(files, "archive", "content")
    rows = [sheets.table_rows(cells, n, {"name": 1, "amount": 2}, 2, "name").withColumn("sheet", F.lit(n)) for n in ("Suppliers", "Customers & co")]
    return rows[0].unionByName(rows[1]).select("archive", "sheet", "name", F.round(F.col("amount").cast("double"), 2).alias("amount"))


@query("""
SELECT p_brand AS archive, '61:44:0050706:' || p_partkey AS cad_number, p_name AS address, CAST(p_size AS DOUBLE) AS area, 'Группа ' || p_brand AS owner FROM part WHERE p_size % 2 = 0""")
def asset_template(t: Tables) -> DataFrame:
    """SRC-08: rows of the asset template's land sheet from the third line on, a merged owner for all of them; those without a number fall away."""
    columns = sheets.ASSETS["Земельные участки"]
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = t.part.withColumns({"row": n + 2, "rows": F.count("*").over(Window.partitionBy("p_brand"))})
    cell = lambda name, value, numeric=False, until=None: F.struct((F.lit(columns.index(name) + 1)).alias("col"), value.cast("string").alias("value"), F.lit(numeric).alias("numeric"), (until if until is not None else F.lit(None).cast("string")).alias("until"))
    last = F.concat(F.lit(sheets.letters(columns.index("owner") + 1)), _s(F.col("rows") + 2))
    values = F.array(
        cell("num", F.col("row") - 2, True), cell("cad_number", F.when(F.col("p_size") % 2 == 0, _cad(F.col("p_partkey")))), cell("address", F.col("p_name")), cell("area", F.col("p_size"), True),
        cell("owner", F.when(F.col("row") == 3, F.concat(F.lit("Группа "), "p_brand")), False, F.when(F.col("rows") > 1, last)),
    )
    heads = t.part.select(F.col("p_brand").alias("archive")).distinct().select("archive", F.explode(F.array(F.lit(1), F.lit(2))).alias("row"), F.lit(6).alias("col"), F.lit("Кадастровый номер").alias("value"), F.lit(False).alias("numeric"), F.lit(None).cast("string").alias("until"))
    grid = rows.select(F.col("p_brand").alias("archive"), "row", F.inline(values)).where("value is not null").unionByName(heads).withColumns({"sheet": F.lit("Земельные участки"), "ord": F.lit(1)})
    files = sinks.joined_chunks(_read_back(t, sheets.write_workbooks(grid), "assets"))
    found = sheets.asset_rows(sheets.read_cells(files, "archive", "content", fill=True), "Земельные участки")
    return found.select("archive", "cad_number", "address", F.col("area").cast("double").alias("area"), "owner")


def _entity_json(t: Tables) -> DataFrame:
    """A JSON document for each customer: its orders are founders by turns Russian, foreign, persons and the state's bodies.

    Russian founders stand by number; padding gives orders like 408 and 11408 the same one, and these stand by order.
    """
    k, o, n = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_orderkey") % 4
    share = F.struct((o % 50).alias("Процент"), F.lit(1000.5).alias("Номинал"))
    pledge = F.struct(F.struct(F.lpad(_s(o), 13, "9").alias("ОГРН"), F.lit("Банк").alias("НаимСокр")).alias("Залогодерж"), F.struct(_s(o).alias("Номер"), F.lit("2020-06-05").alias("Дата"), F.lit("Нотариус").alias("ФИО")).alias("Нотариал"))
    company = F.when(n == 0, F.struct(F.lpad(_s(o), 13, "1").alias("ОГРН"), F.concat(F.lit("ООО "), _s(o)).alias("НаимПолн"), share.alias("Доля"), F.when(o % 8 == 0, F.array(pledge)).alias("Обрем")))
    foreign = F.when(n == 1, F.struct(F.concat(F.lit("Ltd "), _s(o)).alias("Наим"), F.when(o % 8 == 1, '{"Наим":"Кипр"}').otherwise("Мальта").alias("Страна"), _s(o).alias("РегНомер"), share.alias("Доля")))
    person = F.when(n == 2, F.struct(F.lit("Иванов").alias("ФИО")))
    state = F.when(n == 3, F.struct(share.alias("Доля"), F.array(F.struct(F.lpad(_s(o), 10, "7").alias("ИНН"), F.lit("Росимущество").alias("НаимПолн"))).alias("ОргОсущПрав")))
    each = lambda c: F.array_sort(F.collect_list(c))
    companies = F.transform(each(F.when(n == 0, F.struct(company["ОГРН"].alias("number"), o.alias("order"), company.alias("founder")))), lambda c: c["founder"])
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.struct(companies.alias("РосОрг"), each(foreign).alias("ИнОрг"), each(person).alias("ФЛ"), F.collect_list(state).alias("РФ")).alias("f"))
    entity = F.struct(F.when(k % 3 == 0, F.lpad(_s(k), 13, "0")).alias("ogrn"), F.when(k % 3 == 1, F.lpad(_s(k), 10, "0")).alias("inn"), F.lit("1").alias("kpp"), F.col("c_name").alias("name_short"), F.col("c_mktsegment").alias("address"))
    raw = F.struct(F.array(F.struct(_s(k).alias("Номер"), F.lit("Торговля").alias("ВидДеят"))).alias("Лиценз"), F.col("f").alias("Учред"), F.struct(F.array(F.struct(F.lit("Филиал").alias("Наим"), F.when(k % 2 == 0, "Ростов").alias("Адрес"))).alias("Филиал")).alias("Подразд"))
    return t.customer.join(lists, "c_custkey", "left").select("c_custkey", F.replace(F.to_json(F.struct(entity.alias("entity"), raw.alias("raw_data"))), F.lit('"{\\"Наим\\":\\"Кипр\\"}"'), F.lit('{"Наим":"Кипр"}')).alias("text"))


@query("""
WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey AS o, o_orderkey % 4 AS n FROM orders)
SELECT c_custkey, ['legal', 'foreign', 'person', 'rf_org'][n + 1] AS kind, CASE n WHEN 0 THEN 'ООО ' || o WHEN 1 THEN 'Ltd ' || o WHEN 3 THEN 'Росимущество' END AS name, CAST(o % 50 AS VARCHAR) AS share_percent, CASE WHEN o % 8 = 1 THEN 'Кипр' WHEN n = 1 THEN 'Мальта' END AS country, CASE WHEN n = 0 THEN o % 8 = 0 END AS has_pledge, NULL::INTEGER AS persons FROM o WHERE n <> 2
UNION ALL SELECT c_custkey, 'person', NULL, NULL, NULL, NULL, CAST(count(*) AS INTEGER) FROM o WHERE n = 2 GROUP BY 1""")
def legal_founders(t: Tables) -> DataFrame:
    """SRC-23: founders of each kind from a legal entity's JSON document."""
    return entities.legal_entities(_entity_json(t), "text").select("c_custkey", F.inline("founders")).select("c_custkey", "kind", "name", "share_percent", "country", "has_pledge", "persons")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'legal::ogrn::' || lpad(CAST(c_custkey AS VARCHAR), 13, '0') WHEN 1 THEN 'legal::inn::' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE 'legal::name::' || substr(sha1(lower(c_name) || chr(0)), 1, 16) END AS key, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '|Ростов' ELSE '' END AS addresses, CAST(c_custkey AS VARCHAR) AS licence,
 (SELECT coalesce(string_agg('ООО ' || o_orderkey || ':' || o_orderkey || ':Банк:Нотариус', ';' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 13, '1')), '') FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 8 = 0) AS pledges FROM customer""")
def legal_documents(t: Tables) -> DataFrame:
    """SRC-23: keys, addresses with those of branches, licences and pledges of shares."""
    found = entities.legal_entities(_entity_json(t), "text")
    pledges = F.array_join(F.transform("pledges", lambda p: F.concat_ws(":", p["founder"], p["contract_number"], p["holder_name"], p["notary"])), ";")
    return found.select("c_custkey", "key", F.array_join(F.transform("addresses", lambda a: a["address"]), "|").alias("addresses"), F.get("licences", F.lit(0))["number"].alias("licence"), pledges.alias("pledges"))


@query("""
SELECT 'person' AS kind, s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'legal::inn::' || s_suppkey ELSE 'person::' || substr(sha1(lower(s_name) || chr(0)), 1, 16) END AS key, s_name AS name, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS links FROM supplier
UNION ALL SELECT 'ip', p_partkey, 'legal::ogrn::3' || p_partkey, p_name, NULL FROM part""")
def person_documents(t: Tables) -> DataFrame:
    """SRC-28: persons with the active companies that they founded, and sole traders."""
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    company = lambda n, status: F.struct(F.lit(n).alias("ОГРН"), F.lit("ООО").alias("НаимПолн"), status.alias("Статус"))
    text = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, _s(k)).alias("inn"), F.col("s_name").alias("fio")).alias("entity"), F.struct(F.array(company("1", F.lit(None).cast("string")), company("2", F.when(k % 3 == 0, "Не действует").otherwise("Действует"))).alias("Учред")).alias("raw_data")))
    found = entities.persons(t.supplier.select("s_suppkey", text.alias("text")), "text").select("kind", F.col("s_suppkey").alias("id"), "key", "name", F.size("links").alias("links"))
    trader = F.to_json(F.struct(F.struct(F.concat(F.lit("3"), _s(p)).alias("ogrnip"), F.col("p_name").alias("name_full")).alias("entity")))
    more = entities.sole_traders(t.part.select("p_partkey", trader.alias("text")), "text").select("kind", F.col("p_partkey").alias("id"), "key", "name", F.lit(None).cast("int").alias("links"))
    return found.unionByName(more)


@query("""
SELECT 'object' AS part, CAST(o_orderkey AS VARCHAR) AS cad, CASE o_orderkey % 3 WHEN 0 THEN 'Здание' WHEN 1 THEN 'Помещение' ELSE 'Неизвестно' END AS kind, NULL AS number, NULL AS extract_date, NULL::BOOLEAN AS is_right FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'right', CAST(l_orderkey AS VARCHAR), NULL, l_orderkey || '/' || l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END, l_returnflag = 'N' FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def registry_json(t: Tables) -> DataFrame:
    """SRC-19: objects and rights of registry documents; a right has the date of the extract that it names, if the document has it."""
    o, l = F.col("o_orderkey"), F.col("l_linenumber")  # noqa: E741
    right = F.struct(F.when(F.col("l_returnflag") == "N", "Right").otherwise("encumbrance").alias("right_category"), _s("l_orderkey").alias("object_key_value"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("right_number"), F.when(l % 2 == 1, F.concat(F.lit("e"), _s("l_orderkey"))).otherwise("other").alias("source_extract_number"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(right).alias("rights"))
    number, day = F.concat(F.lit("e"), _s(o)), F.date_format("o_orderdate", "yyyy-MM-dd")
    extracts_ = F.array(F.struct(number.alias("extract_number"), F.lit("1999-01-01").alias("extract_date")), F.struct(number.alias("extract_number"), day.alias("extract_date")))
    kind = F.when(o % 3 == 0, "building").when(o % 3 == 1, "room").otherwise("boat")
    objects = F.array(F.create_map(F.lit("cad_number"), _s(o), F.lit("object_type"), kind, F.lit("address"), F.lit("")), F.create_map(F.lit("object_type"), F.lit("room")))
    text = F.to_json(F.struct(F.struct(extracts_.alias("extracts"), objects.alias("building_objects"), F.col("rights")).alias("tables")))
    found, rights = entities.registry_documents(t.orders.join(lists, "o_orderkey").select(text.alias("text")), "text")
    return found.select(F.lit("object").alias("part"), "cad", "kind", F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("extract_date"), F.lit(None).cast("boolean").alias("is_right")).unionByName(rights.select(F.lit("right").alias("part"), "cad", F.lit(None).cast("string").alias("kind"), F.col("right_number").alias("number"), "extract_date", "is_right"))


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS archive, c_name AS tenant, '61:44:0050706:' || c_custkey AS cad, CASE WHEN c_custkey % 3 <> 0 THEN 'с 01.02.2020 по 01.02.2025' END AS term FROM customer""")
def lease_documents(t: Tables) -> DataFrame:
    """SRC-07, SNK-07: a Word document for each nation with a table of leases, written and read back by its headings."""
    k = F.col("c_custkey")
    row = F.array(_cad(k), F.when(k % 3 != 0, "с 01.02.2020\nпо 01.02.2025").otherwise(""), F.col("c_name"))
    tables = t.customer.groupBy(_s("c_nationkey").alias("archive")).agg(F.concat(F.array(F.array(F.lit("Кадастровый номер"), F.lit("Срок аренды"), F.lit("Арендатор & Ко"))), F.collect_list(row)).alias("rows"))
    blocks = tables.select("archive", F.inline(F.array(F.struct(F.lit(1).alias("ord"), F.lit("Справка <об аренде>\nСписок").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")), F.struct(F.lit(2).alias("ord"), F.lit(None).cast("string").alias("text"), F.col("rows").alias("rows")))))
    files = sinks.joined_chunks(_read_back(t, documents.write_documents(blocks), "documents"))
    rows = documents.rows_by_keyword(documents.read_tables(files, "archive", "content"), {"tenant": ["арендатор"], "cad": ["номер", "кадастр"], "term": ["период", "срок"]})
    return rows.select("archive", "tenant", "cad", F.replace("term", F.lit("\n"), F.lit(" ")).alias("term"))


@query("""
WITH i AS (SELECT CAST(s_nationkey AS VARCHAR) AS archive, 'Склад ' || s_suppkey || ' инв. № И-' || s_suppkey AS item_name, '01.01' AS account, 'И-' || s_suppkey AS inventory_number, NULL AS cad, CAST(s_suppkey % 50 AS DOUBLE) AS s, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_suppkey % 50 + 0.5 END AS e, CAST(s_suppkey % 7 AS DOUBLE) AS t FROM supplier
 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'Участок 61:44:0050706:' || (c_custkey + 1), '01.К', NULL, '61:44:0050706:' || (c_custkey + 1), CAST(c_custkey % 5 AS DOUBLE), 0.0, CAST(c_custkey % 11 AS DOUBLE) FROM customer)
SELECT archive, item_name, account, inventory_number, cad, kind, amount, day FROM (
 SELECT *, 'initial' AS kind, s AS amount, '2026-01-01' AS day FROM i WHERE s > 0 UNION ALL SELECT *, 'residual', e, '2026-03-31' FROM i WHERE e > 0 UNION ALL SELECT *, 'writeoff', t, '2026-03-31' FROM i WHERE account = '01.01' AND e < 1 AND t > 0
 UNION ALL SELECT *, 'lease_annual', round(t * 4.055556, 2), '2026-03-31' FROM i WHERE account = '01.К' AND t > 0)""")
def ledger_workbooks(t: Tables) -> DataFrame:
    """SRC-06: a trial balance for each nation as an XLSX file, read back by its layout: own assets, then leased ones, their values."""
    cell = lambda i, v, numeric=False: F.struct(F.lit(i).alias("col"), v.cast("string").alias("value"), F.lit(numeric).alias("numeric"))

    def records(df: DataFrame, nation: str, key: str, name: Column, kind: str, opening: Column, credit: Column, closing: Column, at: int) -> DataFrame:
        row = F.row_number().over(Window.partitionBy(nation).orderBy(key)) * 2 + at
        one = lambda r, b: F.struct(r.alias("row"), F.array(cell(1, name), cell(2, F.lit(b)), cell(3, opening, True), cell(6, credit, True), cell(7, closing, True)).alias("cells"))
        both = df.select(_s(nation).alias("archive"), row.alias("r"), F.inline(F.array(one(F.lit(0), kind), one(F.lit(1), "ВР"))))
        return both.select("archive", (F.col("r") + F.col("row")).cast("int").alias("row"), F.inline("cells"))

    nations = t.supplier.select(F.col("s_nationkey").alias("n")).union(t.customer.select("c_nationkey")).distinct().select(_s("n").alias("archive"))
    text = lambda r, i, v: F.struct(F.lit(r).alias("row"), F.lit(i).alias("col"), F.lit(v).alias("value"), F.lit(False).alias("numeric"))
    middle, last = 100_000, 1_000_000
    fixed = F.array(*(text(r, i, v) for r, i, v in [(1, 1, "ООО Дон"), (2, 1, "Оборотно-сальдовая ведомость за 1 квартал 2026 г."), (7, 1, "01"), (7, 2, "БУ"), (8, 2, "НУ"), (9, 1, "01.02.2020"), (9, 2, "БУ"), (middle, 1, "01.К"), (middle, 2, "БУ"), (last, 1, "Итого"), (last + 1, 1, "После"), (last + 1, 2, "НУ"), (last + 1, 3, "9")]))
    own, leased = F.col("s_suppkey"), F.col("c_custkey")
    parts = [
        nations.select("archive", F.inline(fixed)),
        records(t.supplier, "s_nationkey", "s_suppkey", F.concat(F.lit("Склад "), _s(own), F.lit(" инв. № И-"), _s(own)), "БУ", own % 50, own % 7, F.when(own % 3 == 0, 0.0).otherwise(own % 50 + 0.5), 10),
        records(t.customer, "c_nationkey", "c_custkey", F.concat(F.lit("Участок "), _cad(leased + 1)), "НУ", leased % 5, leased % 11, F.lit(0), middle + 1),
    ]
    grid = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({"sheet": F.lit("TDSheet"), "ord": F.lit(1), "until": F.lit(None).cast("string")})
    files = sinks.joined_chunks(_read_back(t, sheets.write_workbooks(grid), "ledgers"))
    values = ledgers.ledger_values(ledgers.ledger_assets(sheets.read_cells(files, "archive", "content")))
    return values.select("archive", "item_name", "account", "inventory_number", "cad", "kind", "amount", _s("day").alias("day"))
