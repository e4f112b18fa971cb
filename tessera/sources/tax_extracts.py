"""Tax-service extracts (SRC-11): numbered table lines (field, value) of a legal entity's or a sole trader's register entry.

Lines have no nesting of their own: some open a block (a founder or director; a pledge of a share; the holder of that pledge),
some close one. What is open at a line follows from the last opening or closing line before it, so blocks are counted and
carried forward by windows over each document's lines, and then grouped from the inside out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import squeezed

#: Wordings that tell the register, that open blocks and that close them.
REGISTERS = {"реестра юридических лиц": "legal", "реестра индивидуальных предпринимателей": "ip"}
PLEDGE, CONTRACT, NOTARY, HOLDER = "сведения об обременении", "сведения о договоре залога", "сведения о нотариусе", "сведения о залогодержателе"
PERSON = "грн и дата внесения в егрюл сведений о данном лице"
CLOSING = ("Размер (в рублях)", "ИНН юридического лица", "КПП юридического лица", "Код и наименование вида деятельности", "Причина внесения записи в ЕГРЮЛ", "Способ образования", "Наименование регистрирующего органа", "Адрес регистрирующего органа")
ACTIVITY = "код и наименование вида деятельности"
#: Fields of the entity itself, by what a line's field contains. Of several lines the first counts, of LATEST the last.
ENTITY = {"полное наименование на русском языке": "name_full", "сокращенное наименование на русском языке": "name_short", "адрес юридического лица": "address", "место нахождения юридического лица": "region", "дата присвоения огрн": "reg_date", "инн юридического лица": "inn", "кпп юридического лица": "kpp", "размер (в рублях)": "capital"}
LATEST = ("inn", "kpp", "capital")
TRADER = {"адрес электронной почты": "email", "идентификационный номер налогоплательщика": "inn", "наименование налогового органа": "tax_organ"}
TRADER_EXACT = {"Пол": "gender", "Гражданство": "citizenship", "E-mail": "email", "ОГРНИП": "ogrn", "Дата регистрации": "reg_date", "ИНН": "inn"}
#: Fields of a founder or director.
MEMBER = {"полное наименование": "name", "должность": "position", "номинальная стоимость доли": "share_nominal", "размер доли": "share_percent"}


def register(text: Column) -> Column:
    """Which register the first page's text speaks of: legal, ip or NULL."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(w), F.lit(k)) for w, k in REGISTERS.items()))


def day(text: Column) -> Column:
    """D.M.YYYY as YYYY-MM-DD; any other text as it is."""
    parts = [F.regexp_extract(F.trim(text), r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", g) for g in (3, 2, 1)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).otherwise(F.trim(text))


def amount(text: Column) -> Column:
    """A number with a point or a comma among other signs; NULL where there is none."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"[^\d.,\-]", ""), r"^[.,]+|[.,]+$", ""), F.lit(","), F.lit(".")).try_cast("double")


def full_name(text: Column) -> Column:
    """SURNAME, NAME and PATRONYMIC on lines of their own as one line with capitals; one line stays as it is."""
    parts = F.filter(F.transform(F.split(text, r"[\n\r]+|\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(F.slice(parts, 1, 3), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), " ")).otherwise(F.trim(text))


def _digits(value: Column) -> Column:
    return F.trim(F.replace(value, F.lit(" "), F.lit("")))


def _line(value: Column) -> Column:
    return F.trim(F.replace(value, F.lit("\n"), F.lit(" ")))


def _key(field: Column, contains: dict[str, str], exact: dict[str, str] | None = None) -> Column:
    low = F.lower(field)
    choices = [F.when(field == f, F.lit(k)) for f, k in (exact or {}).items()] + [F.when(low.contains(f), F.lit(k)) for f, k in contains.items()]
    return F.coalesce(*choices)


def _is_name(low: Column) -> Column:
    return low.contains("фамилия") & low.contains("имя") & low.contains("отчество")


def _first(key: str, value: Column) -> Column:
    """The first line's value of a key; empty is none."""
    return F.nullif(F.min_by(value, F.when(F.col("key") == key, F.col("no"))), F.lit("")).alias(key)


def _last(key: str, value: Column) -> Column:
    return F.nullif(F.max_by(value, F.when(F.col("key") == key, F.col("no"))), F.lit("")).alias(key)


def _activities(rows: DataFrame) -> DataFrame:
    """Per document the main activity and the others, as structs of code and name, in order."""
    text = _line(F.col("value"))
    coded = rows.where(F.lower("field").contains(ACTIVITY)).select("document", "no", F.regexp_extract(text, r"^([\d.]+)\s+(.+)", 1).alias("code"), F.trim(F.regexp_extract(text, r"^([\d.]+)\s+(.+)", 2)).alias("name")).where("code <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "code", "name"))), lambda a: a.dropFields("no"))
    return coded.groupBy("document").agg(ordered.alias("a")).select("document", F.get("a", F.lit(0)).alias("activity_main"), F.slice("a", 2, 1 << 20).alias("activities_other"))


def _rows(lines: DataFrame, document: str, no: str, field: str, value: str) -> DataFrame:
    rows = lines.select(F.col(document).alias("document"), F.col(no).alias("no"), F.coalesce(squeezed(F.col(field)), F.lit("")).alias("field"), F.trim(F.coalesce(F.col(value), F.lit(""))).alias("value"))
    return rows.where("field <> '' or value <> ''")


def legal_entities(lines: DataFrame, document: str, no: str, field: str, value: str) -> DataFrame:
    """SRC-11: per document of the register of legal entities: its fields, directors, and founders with their pledges.

    A pledge is {contract_number, contract_date, notary, holder {ogrn, inn, name}}. A block with a position is a director, one
    with a share a founder: a legal one with an id, else a person with a name; other blocks fall away. Of a field that a block
    has twice the last one counts. Lines are told apart by their number only; a document may have no block at all.
    """
    rows = _rows(lines, document, no, field, value)
    order = Window.partitionBy("document").orderBy("no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    low, empty = F.lower("field"), F.col("value") == ""
    closes = F.lit(False)
    for wording in CLOSING:
        closes = closes | F.col("field").contains(wording)
    mark = F.when(low.contains(PLEDGE) & empty, "pledge").when(low.contains(CONTRACT), "contract").when(low.contains(NOTARY) & low.contains("договор залога"), "notary").when(low.contains(HOLDER) & empty, "holder").when(low.contains(PERSON), "person").when(closes, "close")
    rows = rows.withColumn("mark", mark)
    # the line that states a person after the heading of a pledge's holder opens that holder, any other a new block
    state = F.last(F.when(F.col("mark").isin("pledge", "holder", "person", "close"), F.col("mark")), ignorenulls=True)
    rows = rows.withColumn("mark", F.when((F.col("mark") == "person") & (state.over(before) == "holder"), "held").when(F.col("mark") == "person", "block").otherwise(F.col("mark")))
    rows = rows.withColumns({"block": F.count(F.when(F.col("mark") == "block", 1)).over(order), "_open": F.last(F.when(F.col("mark").isin("block", "close"), F.col("mark")), ignorenulls=True).over(order) == "block", "_in": F.last(F.when(F.col("mark").isin("pledge", "holder", "held", "block", "close"), F.col("mark")), ignorenulls=True).over(order)})
    rows = rows.withColumns({"open": F.coalesce("_open", F.lit(False)), "held": F.coalesce(F.col("_in") == "held", F.lit(False))})
    inside = Window.partitionBy("document", "block").orderBy("no")
    rows = rows.withColumn("pledge", F.count(F.when(F.col("mark") == "pledge", 1)).over(inside))
    rows = rows.withColumn("holder_no", F.count(F.when(F.col("mark").isin("holder", "held"), 1)).over(inside))

    plain = rows.where("mark is null or mark = 'close'").withColumn("key", _key(F.col("field"), ENTITY))
    at_large = ~F.col("open") & ~F.col("held")
    plain = plain.withColumn("key", F.coalesce("key", F.when((F.col("field") == "ОГРН") & at_large, "ogrn").when((F.col("field") == "Дата регистрации") & ~F.col("open"), "reg_date")))
    v = F.col("value")
    shaped = F.when(F.col("key").isin("inn", "kpp", "ogrn"), _digits(v)).when(F.col("key") == "reg_date", day(v)).when(F.col("key") == "address", F.regexp_replace(squeezed(v), r"[, ]+$", "")).when(F.col("key") == "capital", F.floor(amount(v)).cast("string")).otherwise(_line(v))
    known = plain.where("key is not null").withColumn("shaped", shaped)
    fields = known.groupBy("document").agg(*(_first(k, F.col("shaped")) for k in ("name_full", "name_short", "address", "region", "ogrn", "reg_date")), *(_last(k, F.when(F.col("key") == k, F.col("shaped"))) for k in ("inn", "kpp")), F.max_by("shaped", F.when((F.col("key") == "capital") & F.col("shaped").isNotNull(), F.col("no"))).cast("long").alias("capital"))

    exact = {"ИНН": "inn", "ОГРН": "ogrn"}
    own = plain.where("open and not held and key is null and mark is null").withColumn("key", F.when(_is_name(low), "person").otherwise(_key(F.col("field"), MEMBER, exact)))
    shaped = F.when(F.col("key") == "person", full_name(v)).when(F.col("key").isin("inn", "ogrn"), _digits(v)).when(F.col("key").isin("share_nominal", "share_percent"), amount(v).cast("string")).otherwise(_line(v))
    own = own.withColumn("shaped", shaped).where("key is not null and shaped is not null")
    members = own.groupBy("document", "block").agg(*(_last(k, F.col("shaped")) for k in ("person", "name", "inn", "ogrn", "position", "share_nominal", "share_percent")))

    one = squeezed(v)
    contract = F.regexp_replace(F.regexp_extract(one, r"(?iu)номер договора залога:\s*(.+?)\s*(?:дата договора залога:|$)", 1), r"\s+", "")
    taken = rows.where("open and (mark in ('contract', 'notary') or (held and mark is null))").withColumn("key", F.when(F.col("mark").isNotNull(), F.col("mark")).otherwise(_key(F.col("field"), {"полное наименование": "name"}, exact)))
    taken = taken.withColumn("_global", _key(F.col("field"), ENTITY)).where("_global is null or mark is not null")
    pledges = taken.groupBy("document", "block", "pledge").agg(
        F.nullif(F.max_by(contract, F.when((F.col("key") == "contract") & (contract != ""), F.col("no"))), F.lit("")).alias("contract_number"),
        F.max_by(day(F.regexp_extract(one, r"(?iu)дата договора залога:\s*([\d.]+)", 1)), F.when((F.col("key") == "contract") & one.rlike(r"(?iu)дата договора залога:\s*[\d.]"), F.col("no"))).alias("contract_date"),
        F.max_by(full_name(v), F.when(F.col("key") == "notary", F.col("no"))).alias("notary"),
        *(F.max_by(F.struct("holder_no", (_line(v) if k == "name" else _digits(v)).alias("value")), F.when(F.col("key") == k, F.struct("holder_no", "no"))).alias(k) for k in ("ogrn", "inn", "name")), F.max(F.when(F.col("held"), F.col("holder_no"))).alias("_holder"),
    )
    opened = rows.where("open and mark = 'pledge'").select("document", "block", "pledge", "no").unionByName(taken.select("document", "block", "pledge", "no")).groupBy("document", "block", "pledge").agg(F.min("no").alias("no"))
    # of several holders of one pledge the last one counts
    of_holder = lambda k: F.when(F.col(k)["holder_no"] == F.col("_holder"), F.col(k)["value"]).alias(k)
    whole = opened.join(pledges, ["document", "block", "pledge"], "left").select("document", "block", "pledge", F.struct("contract_number", "contract_date", "notary", F.struct(of_holder("ogrn"), of_holder("inn"), of_holder("name")).alias("holder")).alias("p"))
    lists = whole.groupBy("document", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pledge", "p"))), lambda x: x["p"]).alias("pledges"))
    members = members.join(lists, ["document", "block"], "left")
    share = F.col("share_nominal").isNotNull() | F.col("share_percent").isNotNull()
    kind = F.when(F.col("position").isNotNull(), "director").when(share & F.col("ogrn").isNotNull(), "legal").when(share & F.col("person").isNotNull(), "person")
    none = F.array().cast(lists.schema["pledges"].dataType)
    member = F.struct("block", kind.alias("kind"), F.when(kind == "legal", F.col("name")).otherwise(F.col("person")).alias("name"), "inn", F.when(kind == "legal", F.col("ogrn")).alias("ogrn"), "position", F.col("share_nominal").cast("double").alias("share_nominal"), F.col("share_percent").cast("double").alias("share_percent"), F.when(kind == "legal", F.coalesce("pledges", none)).otherwise(none).alias("pledges"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda m: m.dropFields("block"))
    grouped = members.select("document", member.alias("m")).where("m.kind is not null").groupBy("document").agg(ordered(F.when(F.col("m.kind") == "director", F.col("m"))).alias("directors"), ordered(F.when(F.col("m.kind") != "director", F.col("m"))).alias("founders"))
    return rows.select("document").distinct().join(fields, "document", "left").join(grouped, "document", "left").join(_activities(rows), "document", "left").withColumns({c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)) for c in ("directors", "founders")})


def sole_traders(lines: DataFrame, document: str, no: str, field: str, value: str) -> DataFrame:
    """SRC-11: per document of the register of sole traders: name in parts, ids, register date, office and activities; first lines count."""
    rows = _rows(lines, document, no, field, value)
    low, v = F.lower("field"), F.col("value")
    known = rows.withColumn("key", F.when(_is_name(low), "name_full").otherwise(_key(F.col("field"), TRADER, TRADER_EXACT))).where("key is not null")
    shaped = F.when(F.col("key") == "name_full", full_name(v)).when(F.col("key").isin("ogrn", "inn"), _digits(v)).when(F.col("key") == "reg_date", day(v)).when(F.col("key") == "gender", F.lower(v)).otherwise(v)
    fields = known.withColumn("shaped", shaped).groupBy("document").agg(*(_first(k, F.col("shaped")) for k in ("name_full", "gender", "citizenship", "email", "ogrn", "reg_date", "inn", "tax_organ")))
    parts = F.split("name_full", " ")
    fields = fields.withColumns({"last_name": F.get(parts, F.lit(0)), "first_name": F.get(parts, F.lit(1)), "patronymic": F.nullif(F.array_join(F.slice(parts, 3, 1 << 20), " "), F.lit(""))})
    return rows.select("document").distinct().join(fields, "document", "left").join(_activities(rows), "document", "left")


def registrar(text: Column) -> Column:
    """Keeper of the shareholders' register from an extract's whole text: struct(ogrn, inn, name)."""
    section = F.regexp_extract(text, r"(?su)Сведения о держателе реестра акционеров[^\n]*\n(.*?)(?:\n\s*Сведения о|\n\s*Сведения об учете)", 1)
    one = lambda p: F.nullif(F.regexp_extract(section, p, 1), F.lit(""))
    name = F.trim(F.regexp_replace(squeezed(one(r"Полное наименование\s+([^\n]+(?:\n[^\n0-9]+)*)")), r"\s+ГРН\b.*$", ""))
    return F.struct(one(r"\bОГРН\s+(\d{13})\b").alias("ogrn"), one(r"\bИНН\s+(\d{10})\b").alias("inn"), name.alias("name"))
