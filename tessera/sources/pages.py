"""Registry extracts as pages of text (SRC-05): header, the object of section 1, rights and restrictions of section 2.

Pages become ordered lines. Each line knows its section: a page says which one it belongs to, and pages that don't say follow
the one before. Fields are found by a table of labels; right, encumbrance and zone blocks run from their first line to the
next block's or to a heading that closes them, whatever their number of lines. All lines of a document meet in one place by
one shuffle; no text is gathered but that of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import date_ru, datetime_ru, term
from tessera.functions.numbers import number
from tessera.functions.text import cad_numbers, cad_quarter, restriction_type, short_form, squeezed, tax_id, without_consent
from tessera.functions.values import parse_share
from tessera.sources.extracts import ENCUMBRANCES, RIGHTS, stated

#: Labels of section 1; of a field's labels the first one with a value counts.
LABELS = {
    "address": ["Местоположение", "Адрес", "Местоположение установлено"],
    "registration_date": ["Дата присвоения кадастрового номера"],
    "old_numbers": ["Ранее присвоенный государственный учетный номер"],
    "area_m2": ["Площадь, м2"],
    "area": ["Площадь"],
    "land_category": ["Категория земель"],
    "permitted_uses": ["Виды разрешенного использования"],
    "cadastral_value": ["Кадастровая стоимость, руб.", "Кадастровая стоимость, руб", "Кадастровая стоимость"],
    "status": ["Статус записи об объекте недвижимости"],
    "nested_objects": ["Кадастровые номера расположенных в пределах земельного участка объектов"],
    "predecessors": ["Кадастровые номера объектов недвижимости, из которых образован"],
    "successors": ["Кадастровые номера образованных объектов недвижимости"],
    "purpose": ["Назначение"],
    "projected_purpose": ["Проектируемое назначение"],
    "floors": ["Количество этажей, в том числе подземных этажей"],
    "year_built": ["Год завершения строительства"],
    "year_used": ["Год ввода в эксплуатацию по завершении строительства"],
    "within": ["Кадастровые номера иных объектов недвижимости, в пределах которых"],
    "room_kind": ["Вид жилого помещения"],
    "floor": ["Номер, тип этажа, на котором расположено помещение"],
    "readiness": ["Степень готовности объекта незавершенного строительства, %"],
}
#: Patterns of the header; the first match in the document counts.
PATTERNS = {
    "extract_number": r"№\s*(КУВИ-\d+/\d{4}-\d+)",
    "extract_date": r"(\d{2}\.\d{2}\.\d{4})\s*г?\.?\s*№\s*КУВИ",
    "organ": r"(Филиал публично-правовой компании[^\n]+)",
    "total_sheets": r"Всего листов выписки:\s*(\d+)",
    "total_sections": r"Всего разделов:\s*(\d+)",
    "kind": r"(?i)(Земельный участок|Помещение|Здание|Сооружение|Машино-место|Объект незаверш[её]нного строительства)\s+вид объекта",
}
CAD_LABEL = r"Кадастровый номер\s*:\s*(\d{2}:\d{2}:\d{6,7}:\d+)"
SHEET = r"Лист\s*№\s*\d+\s*раздела\s*(\d+(?:\.\d+)?)"
RIGHTS_HEADING = "Сведения о зарегистрированных правах"
#: Kinds of objects.
KINDS = {"земельный участок": "land", "здание": "building", "сооружение": "structure", "помещение": "room", "машино-место": "parking", "объект незавершённого строительства": "ons", "объект незавершенного строительства": "ons"}
#: Wordings that open a block of a right, and headings that close encumbrances.
RIGHT_WORDINGS = ("Собственность", "Общая долевая собственность", "Аренда", "Постоянное (бессрочное) пользование", "Оперативное управление", "Хозяйственное ведение", "Безвозмездное пользование", "Пожизненное наследуемое владение", "Доверительное управление")
CLOSING = "Договоры участия|Заявленные в судебном|Правопритязания|Сведения о невозможности"
_WORDINGS = "|".join(w.replace("(", r"\(").replace(")", r"\)") for w in RIGHT_WORDINGS)
_MAIN = r"(?i)^(?:[^\n]*\n)?([\p{L}\w][\p{L}\w\s]*?)\s+(\d[\d.,\s]*)\s+(в\s+[\p{L}\w\s]+(?:метрах|метров)|погонных метрах|[\p{L}\w\s]+метр[\p{L}]*)"


def printed_lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Lines with text of each document, in order: document, at, section (1, 2 or another), in_1, in_2, line, next, cad, cad_at.

    cad is the document's labelled number, cad_at the first line that has it. A document no page of which belongs to section 1
    is section 1 as a whole; one without section 2 has it from the heading of rights on. Consent blocks are taken out first.
    """
    doc, order = Window.partitionBy("document"), Window.partitionBy("document").orderBy("page", "no")
    rows = pages.select(F.col(document).alias("document"), F.col(page).alias("page"), F.col(text).alias("t"))
    told = F.nullif(F.regexp_extract("t", SHEET, 1), F.lit(""))
    carried = F.last(told, ignorenulls=True).over(Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("section", F.coalesce(carried, F.lit("1")))
    flat = rows.select("document", "page", "section", F.posexplode(F.split(without_consent(F.col("t")), "\r?\n")).alias("no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    flat = flat.withColumns({"at": F.row_number().over(order), "next": F.lead("line").over(order)})
    flat = flat.withColumn("both", F.concat_ws("\n", "line", "next"))
    heading = F.min(F.when(F.col("line").contains(RIGHTS_HEADING), F.col("at"))).over(doc)
    cad = F.nullif(F.regexp_extract("both", CAD_LABEL, 1), F.lit(""))
    flat = flat.withColumns({"in_1": (F.col("section") == "1") | ~F.bool_or(F.col("section") == "1").over(doc), "in_2": (F.col("section") == "2") | (~F.bool_or(F.col("section") == "2").over(doc) & F.coalesce(F.col("at") >= heading, F.lit(False)))})
    flat = flat.withColumn("cad", F.min_by(cad, F.when(cad.isNotNull(), F.col("at"))).over(doc))
    return flat.withColumn("cad_at", F.min(F.when(F.instr("line", F.col("cad")) > 0, F.col("at"))).over(doc))


def _labelled() -> Column:
    """(field, rank, value) of each label in a line: what follows it and a colon, on this line or else the next one."""
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("rank"), F.lit(label.lower()).alias("label")) for f, names in LABELS.items() for i, label in enumerate(names)))
    low = F.lower("line")
    rest = lambda e: F.regexp_replace(F.substring(F.col("line"), F.instr(low, e["label"]) + F.length(e["label"]), F.lit(1 << 20)), r"^\s*:?\s*", "")
    return F.transform(F.filter(entries, lambda e: F.contains(low, e["label"])), lambda e: F.struct(e["field"].alias("field"), e["rank"].alias("rank"), F.coalesce(F.nullif(rest(e), F.lit("")), F.col("next")).alias("value")))


def _patterned() -> Column:
    made = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(0).alias("rank"), F.nullif(F.regexp_extract("both", p, 1), F.lit("")).alias("value")) for f, p in PATTERNS.items()))
    return F.filter(made, lambda e: e["value"].isNotNull())


def printed_fields(lines: DataFrame) -> DataFrame:
    """Per document: cad, template (full or brief), and fields, a map of what the labels and patterns give."""
    name = F.when(F.col("in_1") & (F.col("at") > F.col("cad_at")) & F.col("line").rlike(r"(?iu)^наименование\s*:"), F.coalesce(F.nullif(F.regexp_extract("line", r"(?iu)^наименование\s*:\s*(.*)$", 1), F.lit("")), F.col("next")))
    within = F.when(F.col("in_1") & F.lower("line").rlike("пределах|расположен объект"), F.array_join(cad_numbers(F.col("line")), "; "))
    main = F.when(F.col("in_1") & F.lower("line").contains("основная характеристика"), F.col("at"))
    one = lambda f, c: F.struct(F.lit(f).alias("field"), F.lit(0).alias("rank"), c.alias("value"))
    more = F.filter(F.array(one("name", name)), lambda e: e["value"].isNotNull())
    found = lines.select("document", "cad", "at", F.inline(F.concat(F.when(F.col("in_1"), _labelled()).otherwise(F.array().cast("array<struct<field:string,rank:int,value:string>>")), _patterned(), more)))
    # the first match of a label counts, even where it says that there is nothing; then the field's next label does
    first = found.groupBy("document", "field", "rank").agg(F.min_by("value", "at").alias("value"))
    first = first.withColumn("value", stated(F.col("value"))).where("value is not null")
    fields = first.groupBy("document", "field").agg(F.min_by("value", "rank").alias("value")).groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    # lines of main characteristics and of the objects around, and the template, are seen over all lines
    after = Window.partitionBy("document").orderBy("at").rowsBetween(Window.currentRow, 2)
    seen = lines.withColumns({"_within": F.nullif(within, F.lit("")), "_main": F.when(main.isNotNull(), F.array_join(F.collect_list("line").over(after), "\n"))})
    whole = seen.groupBy("document").agg(
        F.first("cad").alias("cad"), F.when(F.bool_or(F.lower("line").contains("об основных характеристиках")), "brief").otherwise("full").alias("template"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_within").isNotNull(), F.struct("at", "_within")))), lambda x: x["_within"]), "; ").alias("within_lines"),
        F.min_by("_main", F.when(F.col("_main").isNotNull(), F.col("at"))).alias("main"),
    )
    return whole.join(fields, "document", "left")


def _year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1), F.lit("")).cast("int")


def printed_objects(lines: DataFrame) -> DataFrame:
    """SRC-05: header and object of each document that states its number (cad)."""
    x = lambda n: F.try_element_at(F.col("fields"), F.lit(n))
    of = lambda *kinds: F.col("object_type").isin(*kinds)
    found = printed_fields(lines).where("cad is not null")
    kind = F.try_element_at(F.create_map(*(F.lit(v) for kv in KINDS.items() for v in kv)), F.lower(x("kind")))
    found = found.withColumns({"object_type": F.coalesce(kind, F.lit("unknown")), "_floors": F.nullif(F.regexp_extract(x("floors"), r"^(\d+)", 1), F.lit("")).cast("int"), "_below": F.nullif(F.regexp_extract(x("floors"), r"(\d+)\s*$", 1), F.lit("")).cast("int")})
    exact = lambda g: number(F.nullif(F.regexp_extract(x("area"), r"^([\d.]+)\s*\+/-\s*([\d.]+)", g), F.lit("")))
    area = F.when(of("land"), F.coalesce(exact(1), number(x("area")))).otherwise(number(F.coalesce(x("area_m2"), x("area"))))
    storey = lambda c: F.when(F.col(c) < 200, F.col(c))
    value = number(F.regexp_replace(x("cadastral_value"), r"^[.:\s]+", ""))
    purpose = F.when(of("structure", "ons"), F.coalesce(x("projected_purpose"), x("purpose"))).when(~of("land"), x("purpose"))
    main = lambda g: F.nullif(F.trim(F.regexp_extract(F.regexp_replace("main", r"^[^\n]*\n?", ""), _MAIN, g)), F.lit(""))
    around = F.coalesce(F.nullif("within_lines", F.lit("")), F.nullif(F.array_join(cad_numbers(x("within")), "; "), F.lit("")))
    listed = lambda n: F.nullif(F.array_join(cad_numbers(x(n)), "; "), F.lit(""))
    found = found.withColumns({"area": area, "floors_total": F.when(of("building"), storey("_floors")), "underground_floors": F.when(of("building"), storey("_below")), "_purpose": purpose})
    status = F.regexp_replace(x("status"), r'(?iu)^Сведения об объекте недвижимости имеют статус\s*["“]?\s*', "")
    return found.select(
        "document", x("extract_number").alias("extract_number"), date_ru(x("extract_date")).cast("string").alias("extract_date"), squeezed(x("organ")).alias("organ"), "template", x("total_sheets").cast("int").alias("total_sheets"), x("total_sections").cast("int").alias("total_sections"),
        F.col("cad").alias("cad_number"), cad_quarter(F.col("cad")).alias("quarter_cad_number"), "object_type", x("address").alias("address"), date_ru(x("registration_date")).cast("string").alias("registration_date"), F.regexp_replace(x("old_numbers"), r"(\d)- (?=[\d/])", "$1-").alias("old_numbers"),
        "area", F.when(of("land"), exact(2)).alias("area_error"), F.when(of("land"), x("land_category")).alias("land_category"), F.when(of("land"), x("permitted_uses")).alias("permitted_uses"), value.alias("cadastral_value"),
        F.when(F.coalesce(F.lower(x("status")).contains("снят"), F.lit(False)), "deregistered").otherwise("active").alias("lifecycle_status"), F.nullif(F.regexp_replace(status, r'^["» ]+|["» ]+$', ""), F.lit("")).alias("status_text"),
        F.when(of("land"), listed("nested_objects")).alias("nested_objects"), F.when(of("land"), listed("predecessors")).alias("predecessor_cad_numbers"), F.when(of("land"), listed("successors")).alias("successor_cad_numbers"),
        F.when(of("land"), F.concat(F.lit("Земельный участок "), "cad", F.coalesce(F.when(F.col("area") != 0, F.concat(F.lit(", "), F.col("area").cast("string"), F.lit(" кв.м"))), F.lit("")))).when(of("ons"), F.coalesce(x("name"), "_purpose")).otherwise(F.when(F.length(x("name")) < 200, x("name"))).alias("name"),
        F.col("_purpose").alias("purpose"), "floors_total", "underground_floors", (F.col("floors_total") - F.coalesce("underground_floors", F.lit(0))).alias("floors_above_ground"), F.when(~of("land", "room", "parking"), _year(x("year_built"))).alias("year_built"), F.when(~of("land", "room", "parking"), _year(x("year_used"))).alias("year_used"),
        F.when(of("room", "parking"), x("room_kind")).alias("room_type"), F.when(of("room", "parking"), F.get(cad_numbers(x("within")), F.lit(0))).alias("parent_cad_number"), F.when(of("building", "structure", "ons"), around).alias("land_cad_numbers"),
        F.when(of("structure", "ons"), squeezed(main(1))).alias("main_type"), F.when(of("structure", "ons"), number(main(2))).alias("main_value"), F.when(of("structure", "ons"), squeezed(main(3))).alias("main_unit"), F.when(of("ons"), number(x("readiness"))).alias("readiness"),
    )


def _moment(text: Column) -> Column:
    return F.coalesce(F.date_format(datetime_ru(text), "yyyy-MM-dd HH:mm:ss"), date_ru(text).cast("string"))


def _block(rows: DataFrame, *more: str) -> DataFrame:
    """The lines of each block as one text: document, block, at (its first line), text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("document", "block", *more).agg(F.min("at").alias("at"), joined.alias("text"))


def _owned(lines: DataFrame) -> DataFrame:
    """Rights: wording and share, then a number, then often a moment, each on its line."""
    order = Window.partitionBy("document").orderBy("at")
    opened = F.regexp_extract("line", rf"(?iu)((?:{_WORDINGS}).*)$", 1)
    rows = lines.where("in_2").select("document", "cad", "at", "line", opened.alias("opened"), F.lead("line", 1).over(order).alias("second"), F.lead("line", 2).over(order).alias("third"))
    rows = rows.withColumn("starts", (F.col("opened") != "") & F.coalesce(F.col("second").rlike(r"^[\d\-/:\p{IsCyrillic}]"), F.lit(False)))
    # a line taken as the number of the block before opens none: of lines that follow each other every second one does
    rows = rows.withColumn("_gap", F.sum(F.when(F.col("starts"), 0).otherwise(1)).over(order))
    rows = rows.withColumn("_nth", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("document", "_gap").orderBy("at"))).where("starts and _nth % 2 = 1")
    third = F.when(F.col("third").rlike(r"^[\d.:]"), F.col("third"))
    told = F.trim(F.regexp_replace("second", r"(?iu)^(?:права|ограничения|обременения):\s*", ""))
    number_ = F.when((told == "") | told.rlike(r"(?iu)дата|^\d{2}\.\d{2}\.\d{4}"), third).otherwise(told)
    number_ = F.when(~number_.rlike("(?iu)дата государственной"), number_)
    wording, share = F.trim(F.substring_index("opened", ",", 1)), parse_share(F.col("opened"))
    code = F.try_element_at(F.create_map(*(F.lit(v) for kv in RIGHTS.items() for v in kv)), F.lower(wording))
    nothing = F.lit(None).cast("string")
    return rows.select(
        "document", "cad", "at", F.lit("right").alias("right_category"), wording.alias("right_type"), F.coalesce(code, F.lit("unknown")).alias("right_type_code"), number_.alias("right_number"), _moment(third).alias("right_date"), share["numerator"].alias("share_numerator"), share["denominator"].alias("share_denominator"),
        nothing.alias("valid_from"), nothing.alias("valid_until"), nothing.alias("term"), nothing.alias("beneficiary_name"), nothing.alias("beneficiary_inn"), nothing.alias("basis"), F.lit(False).alias("is_public"),
    ).where("right_number is not null")


def _encumbered(lines: DataFrame) -> DataFrame:
    """Encumbrances and restrictions: from a line with 'вид:' to the next one, to a numbered right or to a heading that closes them; each number once."""
    order = Window.partitionBy("document").orderBy("at")
    opens, closing = r"(?iu)вид\s*:\s*\S|вид\s*:$", rf"(?iu)^(.*?)(?:{CLOSING}|(?<!.)\d[\d.]*\s+(?:{_WORDINGS}))"
    rows = lines.where("in_2").select("document", "cad", "at", "line", F.sum(F.col("line").rlike(opens).cast("int")).over(order).alias("block")).where("block > 0")
    shut = F.sum(F.col("line").rlike(closing).cast("int")).over(Window.partitionBy("document", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_shut", F.coalesce(shut, F.lit(0))).where("_shut = 0").withColumn("line", F.when(F.col("line").rlike(closing), F.regexp_extract("line", closing, 1)).otherwise(F.col("line")))
    text = _block(rows, "cad").withColumn("text", F.regexp_extract("text", r"(?isu)(вид\s*:.*)$", 1))
    take = lambda p, g=1: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    number_ = take(r"(?iu)номер государственной регистрации\s*:\s*([^\n]+)")
    text = text.withColumn("_key", F.coalesce(F.trim(number_), F.substring("text", 1, 60)))
    text = text.withColumn("_n", F.row_number().over(Window.partitionBy("document", "_key").orderBy("at"))).where("_n = 1")
    wording = squeezed(take(r"(?iu)вид\s*:\s*([^\n]+)"))
    code = F.try_element_at(F.create_map(*(F.lit(v) for kv in ENCUMBRANCES.items() for v in kv)), F.lower(wording))
    for_whom = squeezed(take(r"(?isu)лицо,\s*в пользу которого[^:]*:\s*(.{1,400}?)(?=\n(?:основани|сведения о возможности|данные отсутствуют)|\z)"))
    for_whom = stated(F.trim(F.regexp_replace(for_whom, r"(?iu)^(?:прав и обременение объекта недвижимости|ограничение прав|объекта недвижимости|прав и обременение)\s*:\s*", "")))
    text = text.withColumns({"_for": F.when(F.lower(for_whom) != "не определено", for_whom), "_term": term(take(r"(?iu)срок[^\n]*:\s*([^\n]+)"))})
    name = F.trim(F.regexp_replace("_for", r"(?iu),?\s*ИНН[:\s]+\d{10,12}", ""))
    nothing = F.lit(None).cast("long")
    return text.select(
        "document", "cad", "at", F.when(F.col("_for").isNotNull(), "encumbrance").otherwise("restriction").alias("right_category"), wording.alias("right_type"), F.when(wording.isNotNull(), F.coalesce(code, F.lit("other"))).alias("right_type_code"), squeezed(number_).alias("right_number"),
        _moment(take(r"(?iu)дата государственной регистрации\s*:\s*([^\n]+)")).alias("right_date"), nothing.alias("share_numerator"), nothing.alias("share_denominator"),
        F.col("_term.valid_from").cast("string").alias("valid_from"), F.col("_term.valid_until").cast("string").alias("valid_until"), F.col("_term.description").alias("term"),
        F.when(~name.rlike(r"^\d{10,12}$"), short_form(name)).alias("beneficiary_name"), F.coalesce(tax_id(F.col("_for")), F.nullif(F.regexp_extract("_for", r"\b(\d{10,12})\b", 1), F.lit(""))).alias("beneficiary_inn"),
        F.substring(squeezed(take(r"(?iu)основани[ея][^\n]*:\s*([^\n]+(?:\n[^\n]+)?)")), 1, 500).alias("basis"), F.coalesce(F.lower(wording).contains("публичный"), F.lit(False)).alias("is_public"),
    ).where("right_type is not null or right_number is not null")


def printed_rights(lines: DataFrame) -> DataFrame:
    """SRC-05: rights, encumbrances (for a named person) and restrictions of section 2, in the order of their lines (at)."""
    return _owned(lines).unionByName(_encumbered(lines)).where("cad is not null").withColumnRenamed("cad", "cad_number")


def printed_restrictions(lines: DataFrame) -> DataFrame:
    """SRC-05: zones that the object lies in, by number, each once; of a document without any its special notes."""
    order = Window.partitionBy("document").orderBy("at")
    doc = Window.partitionBy("document")
    rows = lines.where("(in_1 or in_2) and cad is not null").withColumn("both", F.concat_ws("\n", "line", "next"))
    zone = F.nullif(F.regexp_extract("both", r"(?iu)^[^\n]*полностью расположен[^\n]*реестровым номером\s+([\d:.\-/]+)", 1), F.lit(""))
    rows = rows.withColumn("zone", zone)
    rows = rows.withColumns({"block": F.count("zone").over(order), "zones": F.count("zone").over(doc), "_noted": F.max(F.when(F.col("line").rlike(r"(?iu)особые отметки\s*:"), 1)).over(order), "_told": F.max(F.when(F.col("line").rlike("(?iu)получатель выписки"), 1)).over(order)})
    decided = {"document_number": r"(?iu)номер решения:\s*([^\n,;]{1,100})", "document_date": r"(?iu)дата решения:\s*(\d{2}\.\d{2}\.\d{4})"}
    take = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    basis = lambda c: (squeezed(take(c, decided["document_number"])).alias("document_number"), date_ru(take(c, decided["document_date"])).cast("string").alias("document_date"))
    numbers = rows.where("zone is not null").select("document", "block", F.col("zone").alias("registry_number"))
    text = _block(rows.where("block > 0"), "cad", "zones").join(numbers, ["document", "block"])
    text = text.withColumn("text", F.when(F.col("block") == F.col("zones"), F.substring("text", 1, 3000)).otherwise(F.col("text")))
    text = text.withColumn("_n", F.row_number().over(Window.partitionBy("document", "registry_number").orderBy("block"))).where("_n = 1")
    seen, kind = take("text", r"(?iu)вид/наименование:\s*([^\n;,|]{3,200})"), take("text", r"(?iu)тип:\s*([^\n,;]{3,100})")
    zoned = text.select("document", F.col("cad").alias("cad_number"), restriction_type(kind, seen).alias("type"), F.substring(squeezed(F.coalesce(seen, kind)), 1, 200).alias("description"), "registry_number", *basis("text"))
    notes = rows.where("zones = 0 and _noted = 1 and _told is null").withColumn("block", F.lit(0))
    said = F.regexp_replace("text", r"(?isu)^.*?особые отметки\s*:", "")
    chunks = _block(notes, "cad").select("document", F.col("cad").alias("cad_number"), F.explode(F.split(said, r"(?iu)вид ограничения \(обременения\)\s*:")).alias("c"))
    line = squeezed(F.substring("c", 1, 200))
    noted = chunks.select("document", "cad_number", restriction_type(F.col("c"), F.lit(None).cast("string")).alias("type"), line.alias("description"), F.lit(None).cast("string").alias("registry_number"), *basis("c"))
    return zoned.unionByName(noted.where(r"description <> '' and not lower(description) rlike 'данные отсутствуют|сведения, необходимые|план расположения|отсутствуют\\.'"))
