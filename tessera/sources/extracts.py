"""Registry extracts in XML (SRC-04): header, object, rights and restrictions.

Each document goes through an XML parser once, in Arrow batches, and tables of paths say which texts are taken: they come out
as strings, and all that is done with them are expressions. (``from_xml`` needs the whole path of every field; extracts' fields
are found at any depth, as their layouts differ in what stands around them.)

Paths: ``//name`` is the first element of a name inside the one before, at any depth, ``/name`` its first child so called. Names
are compared in lower case and without prefix. An element without text gives '', one that isn't there NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from tessera.functions.dates import date_any, term
from tessera.functions.numbers import number
from tessera.functions.text import cad_quarter, squeezed
from tessera.functions.values import bound, parse_share

#: Root elements and the kinds of their objects.
ROOTS = {
    "extract_about_property_land": "land",
    "extract_about_property_build": "building",
    "extract_about_property_room": "room",
    "extract_about_property_construction": "structure",
    "extract_about_property_parking": "parking",
    "extract_about_property_ons": "ons",
}
#: Wordings of rights and of encumbrances and their codes.
RIGHTS = {
    "собственность": "ownership",
    "общая долевая собственность": "shared",
    "общая совместная собственность": "joint",
    "аренда": "lease",
    "постоянное (бессрочное) пользование": "perpetual_use",
    "постоянное пользование": "perpetual_use",
    "безвозмездное пользование": "free_use",
    "безвозмездное срочное пользование": "free_use",
    "пожизненное наследуемое владение": "lifelong_inherit",
    "оперативное управление": "operative_mgmt",
    "хозяйственное ведение": "economic_mgmt",
    "доверительное управление": "trust_mgmt",
}
ENCUMBRANCES = {
    "ипотека": "mortgage",
    "аренда": "lease",
    "арест": "arrest",
    "запрещение регистрации": "prohibition",
    "запрет регистрационных действий": "prohibition",
    "концессия": "concession",
    "сервитут": "easement",
    "публичный сервитут": "pub_easement",
    "доверительное управление": "trust_mgmt",
}
#: Wordings of an absent value.
ABSENT = ("данные отсутствуют", "не зарегистрировано", "отсутствуют", "нет данных", "-", "")
HERITAGE_MARKS = "культурного наследия|памятник"

#: The document's own texts.
TEXTS = {
    "organ": "//group_top_requisites/organ_registr_rights",
    "extract_date": "//group_top_requisites/date_formation",
    "extract_number": "//group_top_requisites/registration_number",
    "cad_number": "//cad_number",
    "quarter": "//quarter_cad_number",
    "address": "//readable_address",
    "cost": "//cost/value",
    "status": "//status",
    "any_registration_date": "//registration_date",
    "land_area": "//area/value",
    "area_error": "//area/inaccuracy",
    "category_type": "//category/type/value",
    "category_value": "//category/value",
    "category": "//category",
    "area": "//params/area",
    "params": "//params",
    "name": "//params/name",
    "purpose_value": "//params/purpose/value",
    "purpose": "//params/purpose",
    "floors": "//params/floors",
    "underground_floors": "//params/underground_floors",
    "year_built": "//params/year_built",
    "type_value": "//params/type/value",
    "type": "//params/type",
    "build_cad_number": "//build_cad_number",
    "main_type": "//params/main_characteristics/type",
    "main_value": "//params/main_characteristics/value",
    "main_unit": "//params/main_characteristics/unit",
    "special_notes": "//special_notes",
}
#: For all elements of a name: texts inside each.
LISTS = {
    "prev_cad_number": {"cad": "//cad_number"},
    "new_cad_number": {"cad": "//cad_number"},
    "inner_cadastral_numbers": {"cad": "//cad_number"},
    "land_cad_number": {"cad": "//cad_number"},
    "parent_cad_number": {"cad": "//cad_number"},
    "permitted_use_established": {"text": "/by_document"},
    "permitted_use": {"value": "/value", "text": ""},
    "restriction_encumbrance": {
        "inner_number": "//number/number", "border_number": "//reg_number_border/number", "border": "//reg_number_border", "number": "//number",
        "content": "//content_restrict_encumbrances", "kind": "//encumbrance_type/value", "document_number": "//underlying_document//document_number", "document_date": "//underlying_document//document_date",
    },
}
RIGHT = {"type_value": "//right_type/value", "type": "//right_type", "number": "//right_number", "other_number": "//number", "info": "/record_info", "info_date": "/record_info//registration_date", "date": "//registration_date", "share": "//share", "numerator": "//share/numerator", "denominator": "//share/denominator"}
RESTRICTION = {
    "number": "/restrictions_encumbrances_data/restriction_encumbrance_number", "type_value": "/restrictions_encumbrances_data/restriction_encumbrance_type/value", "type": "/restrictions_encumbrances_data/restriction_encumbrance_type",
    "date": "/record_info//registration_date", "start": "/restrictions_encumbrances_data//start_date", "starting": "/restrictions_encumbrances_data//starting_date", "end": "/restrictions_encumbrances_data//end_date",
    "document_name": "//underlying_document/document_name", "document_number": "//underlying_document/document_number", "document_date": "//underlying_document/document_date", "document_issuer": "//underlying_document/document_issuer",
}
_HOLDER_TEXTS = {"name": "/name", "full_name": "//full_name", "any_name": "//name", "inn": "//inn", "ogrn": "//ogrn", "value": "//value"}
HOLDERS = {"organization": "legal_entity", "legal_entity": "legal_entity", "public_formation": "public", "subject_rf": "public", "individual": "individual", "person": "individual"}

Element = ElementTree.Element


def _steps(path: str) -> list[tuple[bool, str]]:
    return [(slashes == "//", name) for slashes, name in re.findall("(//?)([^/]+)", path)]


def _text(e: Element | None) -> str | None:
    return None if e is None else (e.text or "").strip()


def _at(e: Element | None, steps: list[tuple[bool, str]]) -> Element | None:
    for deep, name in steps:
        if e is None:
            return None
        e = next(e.iter(name), None) if deep else e.find(name)
    return e


def _taker(paths: dict[str, str]) -> Callable[[Element], dict]:
    compiled = [(k, _steps(p)) for k, p in paths.items()]
    return lambda e: {k: _text(_at(e, steps)) for k, steps in compiled}


_take_texts, _take_right, _take_restriction, _take_holder = map(_taker, (TEXTS, RIGHT, RESTRICTION, _HOLDER_TEXTS))
_take_lists = {name: _taker(paths) for name, paths in LISTS.items()}
_take_old = _taker({"kind_value": "/number_type/value", "kind": "/number_type", "number": "/number"})


def _holders(e: Element | None) -> list[dict]:
    """Of each holder its first part of a known kind, of private persons the tax id only."""
    out = []
    for h in e.iter("right_holder") if e is not None else ():
        name, part = next(((n, p) for n in HOLDERS if (p := h.find(n)) is not None), (None, None))
        if name:
            taken = _take_holder(part)
            out.append({"holder_type": HOLDERS[name]} | (taken if HOLDERS[name] != "individual" else dict.fromkeys(taken) | {"inn": taken["inn"]}))
    return out


def _registered(root: Element) -> str | None:
    """Text of the root's own record_info's date, else of that of its first child named after a record that has one; '' without a date in it."""
    infos = [root.find("record_info"), *(c.find("record_info") for c in root if "record" in c.tag)]
    info = next((i for i in infos if i is not None), None)
    return None if info is None else _text(info.find("registration_date")) or ""


def take(document: str | bytes) -> dict:
    """The texts of one document; raises ElementTree.ParseError where it isn't well-formed. Bytes are decoded as they declare."""
    root = ElementTree.fromstring(document)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""
    old = next(root.iter("old_numbers"), ())
    rights = [_take_right(r) | {"duration": (None if (d := next(r.iter("duration"), None)) is None else " ".join(c.text or "" for c in d)), "holders": _holders(r)} for r in root.iter("right_record")]
    restrictions = [_take_restriction(r) | {"named": any(sub.tag != "undefined" for h in r.find("right_holders") or () for sub in h), "holders": _holders(r.find("right_holders"))} for r in root.iter("restrict_record")]
    lists = {name: [taker(e) for e in root.iter(name)] for name, taker in _take_lists.items()}
    return {"root": root.tag, "registered": _registered(root), "old_numbers": [_take_old(o) for o in old if o.tag == "old_number"], "rights": rights, "restrictions": restrictions} | _take_texts(root) | lists


def _struct(names, *more: tuple[str, pa.DataType]) -> pa.DataType:
    return pa.struct([*((n, pa.string()) for n in names), *more])


_HOLDER_TYPE = _struct(["holder_type", *_HOLDER_TEXTS])
_TAKEN = _struct(
    ["root", "registered", *TEXTS],
    ("old_numbers", pa.list_(_struct(["kind_value", "kind", "number"]))),
    ("rights", pa.list_(_struct(RIGHT, ("duration", pa.string()), ("holders", pa.list_(_HOLDER_TYPE))))),
    ("restrictions", pa.list_(_struct(RESTRICTION, ("named", pa.bool_()), ("holders", pa.list_(_HOLDER_TYPE))))),
    *((name, pa.list_(_struct(paths))) for name, paths in LISTS.items()),
)


def _parsed(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, problems = [], []
            for document in batch[column]:
                document, found, problem = document.as_py(), None, None
                try:
                    found = take(document) if document else None
                    problem = None if document else "no text"
                except (ElementTree.ParseError, LookupError, ValueError) as e:  # malformed; an unknown encoding
                    problem = f"not well-formed: {e}"
                taken.append(found)
                problems.append(problem)
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(taken, _TAKEN), pa.array(problems, pa.string())], names=[*kept, "_x", "problem"])

    return run


def parsed(df: DataFrame, text: str) -> DataFrame:
    """df with the text column replaced by _x (the texts of TEXTS, LISTS, RIGHT, RESTRICTION) and problem (NULL where it could be read)."""
    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(_parsed(text), T.StructType([*fields, T.StructField("_x", from_arrow_type(_TAKEN)), T.StructField("problem", T.StringType())]))


def some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def stated(text: Column) -> Column:
    """The text on one line; NULL where it says that there is nothing."""
    return bound(squeezed(text), lambda s: F.when(~F.lower(s).isin(*ABSENT), s))


def _joined(items: Column) -> Column:
    return some(F.array_join(F.filter(items, lambda x: x.isNotNull()), "; "))


def _code(wording: Column, codes: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.lower(wording))


def _holder(h: Column) -> Column:
    kind = h["holder_type"]
    # a public body's name is its first value at any depth, else its name, else the state's
    name = F.when(kind == "legal_entity", stated(F.coalesce(some(h["name"]), some(h["full_name"]), h["any_name"]))).when(kind == "public", stated(F.coalesce(h["value"], h["name"], F.lit("Российская Федерация"))))
    return F.struct(kind.alias("holder_type"), name.alias("name"), F.when(kind != "public", some(h["inn"])).alias("inn"), F.when(kind == "legal_entity", some(h["ogrn"])).alias("ogrn"))


def _right(r: Column) -> Column:
    def make(v: Column) -> Column:
        typed, own = r["type"].isNotNull(), v["own"]
        category = F.when(~typed | own.isNotNull(), "right").when(F.size(r["holders"]) > 0, "encumbrance").otherwise("restriction")
        code = F.when(typed, F.coalesce(own, _code(v["wording"], ENCUMBRANCES), F.lit("other")))
        return F.struct(
            category.alias("right_category"), stated(v["wording"]).alias("right_type"), code.alias("right_type_code"), stated(F.coalesce(r["number"], r["other_number"])).alias("right_number"),
            date_any(F.when(r["info"].isNotNull(), r["info_date"]).otherwise(r["date"])).alias("right_date"), v["share"]["numerator"].alias("share_numerator"), v["share"]["denominator"].alias("share_denominator"),
            v["term"]["valid_from"].cast("string").alias("valid_from"), v["term"]["valid_until"].cast("string").alias("valid_until"), F.lit(None).cast("string").alias("basis"), F.transform(r["holders"], _holder).alias("holders"),
        )

    counted = F.struct(r["numerator"].try_cast("long").alias("numerator"), r["denominator"].try_cast("long").alias("denominator"))
    share = F.when(r["numerator"].isNotNull() & r["denominator"].isNotNull(), counted).otherwise(parse_share(r["share"]))
    wording = F.coalesce(r["type_value"], r["type"])
    return bound(F.struct(wording.alias("wording"), _code(wording, RIGHTS).alias("own"), share.alias("share"), F.when(r["duration"].isNotNull(), term(r["duration"])).alias("term")), make)


def _restriction_of_right(r: Column) -> Column:
    """An encumbrance if somebody is named who it is for, else a restriction."""
    wording = F.coalesce(some(r["type_value"]), r["type"])
    parts = F.filter(F.array(*(stated(r[n]) for n in ("document_name", "document_number", "document_date", "document_issuer"))), lambda x: x.isNotNull())
    return F.struct(
        F.when(r["named"], "encumbrance").otherwise("restriction").alias("right_category"), stated(wording).alias("right_type"), F.when(r["type"].isNotNull(), F.coalesce(_code(wording, ENCUMBRANCES), F.lit("other"))).alias("right_type_code"),
        stated(r["number"]).alias("right_number"), date_any(r["date"]).alias("right_date"), F.lit(None).cast("long").alias("share_numerator"), F.lit(None).cast("long").alias("share_denominator"),
        date_any(F.coalesce(some(r["start"]), r["starting"])).alias("valid_from"), date_any(r["end"]).alias("valid_until"), F.substring(some(F.array_join(parts, ", ")), 1, 500).alias("basis"), F.transform(r["holders"], _holder).alias("holders"),
    )


def _restriction_of_object(e: Column) -> Column:
    wording = F.coalesce(e["kind"], F.lit(""))
    description = F.coalesce(F.substring(e["content"], 1, 200), wording)
    kind = F.when(F.lower(F.concat_ws(" ", wording, description)).rlike(HERITAGE_MARKS), "okn_territory").otherwise("czuit_zone")
    number_ = F.coalesce(*(some(e[n]) for n in ("inner_number", "border_number", "border", "number")))
    return F.struct(kind.alias("type"), stated(description).alias("description"), number_.alias("registry_number"), some(e["document_number"]).alias("document_number"), date_any(e["document_date"]).alias("document_date"), description.alias("said"))


_RESTRICTIONS = "array<struct<type:string,description:string,registry_number:string,document_number:string,document_date:string>>"


def _object_restrictions(x: Column) -> Column:
    def once(all_: Column) -> Column:
        # a number, or else a description, is there once
        keyed = F.transform(all_, lambda r: F.coalesce(r["registry_number"], F.substring(r["said"], 1, 50)))
        return F.transform(F.filter(all_, lambda r, i: F.array_position(keyed, F.get(keyed, i)) == i + 1), lambda r: r.dropFields("said"))

    notes = some(x["special_notes"])
    empty = F.lower(notes).rlike("сведения, необходимые|данные отсутствуют|план расположения")
    nothing = F.lit(None).cast("string")
    noted = F.when(notes.isNotNull() & ~empty & stated(notes).isNotNull(), F.array(F.struct(F.lit("other").alias("type"), F.substring(notes, 1, 300).alias("description"), nothing.alias("registry_number"), nothing.alias("document_number"), nothing.alias("document_date"))))
    return F.concat(bound(F.transform(x["restriction_encumbrance"], _restriction_of_object), once), F.coalesce(noted, F.array().cast(_RESTRICTIONS)))


def read_extracts(df: DataFrame, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """SRC-04: columns of the extract and its object, `rights` and `object_restrictions` as arrays of structs, and `problem`.

    problem says why a row has no object: no text, not well-formed (with the place), not an extract, no cadastral number. Such
    rows are kept, with NULL everywhere else. text is a string or binary column. columns: only these are built.
    """
    x = F.col("_x")
    root = x["root"]
    kind = F.coalesce(_code(root, ROOTS), *(F.when(root.contains(name), F.lit(k)) for name, k in ROOTS.items()), F.lit("unknown"))
    problem = F.coalesce("problem", F.when(~root.contains("extract_about_property"), "not an extract"), F.when(some(x["cad_number"]).isNull(), "no cadastral number"))
    whole = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("int"))
    cads = lambda name: _joined(F.transform(x[name], lambda e: some(e["cad"])))
    of = lambda *kinds: F.col("object_type").isin(*kinds)
    area = F.when(of("land"), number(x["land_area"])).when(of("building", "room", "parking"), number(x["area"]))
    found = parsed(df, text).withColumns({"problem": problem, "object_type": kind, "cad_number": some(x["cad_number"])})
    found = found.withColumns({"area": area, "_floors": whole(x["floors"]), "_below": F.when(x["params"].isNotNull(), F.coalesce(whole(x["underground_floors"]), F.lit(0)))})
    old = F.array_distinct(F.transform(x["old_numbers"], lambda o: bound(stated(o["number"]), lambda n: F.when(n.isNotNull(), F.concat_ws(" ", some(F.coalesce(o["kind_value"], o["kind"])), n)))))
    documents = F.transform(x["permitted_use_established"], lambda e: stated(e["text"]))
    uses = F.array_distinct(F.transform(x["permitted_use"], lambda e: stated(F.coalesce(e["value"], e["text"]))))
    parent = F.get(F.filter(F.transform(x["parent_cad_number"], lambda e: e["cad"]), lambda c: c.isNotNull()), F.lit(0))
    fields = {
        "object_type": lambda: F.col("object_type"),
        "organ": lambda: stated(x["organ"]),
        "extract_date": lambda: date_any(stated(x["extract_date"])),
        "extract_number": lambda: stated(x["extract_number"]),
        "cad_number": lambda: F.col("cad_number"),
        "quarter_cad_number": lambda: F.coalesce(some(x["quarter"]), cad_quarter(F.col("cad_number"))),
        "address": lambda: stated(x["address"]),
        "cadastral_value": lambda: number(x["cost"]),
        "lifecycle_status": lambda: F.when(F.coalesce(F.lower(x["status"]).contains("снят"), F.lit(False)), "deregistered").otherwise("active"),
        "registration_date": lambda: date_any(F.coalesce(x["registered"], x["any_registration_date"])),
        "old_numbers": lambda: _joined(old),
        "predecessor_cad_numbers": lambda: cads("prev_cad_number"),
        "successor_cad_numbers": lambda: cads("new_cad_number"),
        "area": lambda: F.col("area"),
        "area_error": lambda: F.when(of("land"), number(x["area_error"])),
        "land_category": lambda: F.when(of("land"), stated(F.coalesce(some(x["category_type"]), some(x["category_value"]), x["category"]))),
        "permitted_uses": lambda: F.when(of("land"), F.coalesce(_joined(documents), _joined(uses))),
        "nested_objects": lambda: F.when(of("land"), cads("inner_cadastral_numbers")),
        "name": lambda: F.when(of("land"), F.concat(F.lit("Земельный участок "), "cad_number", F.coalesce(F.when(F.col("area") != 0, F.concat(F.lit(", "), F.col("area").cast("string"), F.lit(" кв.м"))), F.lit("")))).otherwise(stated(x["name"])),
        "purpose": lambda: F.when(~of("land"), stated(F.coalesce(some(x["purpose_value"]), x["purpose"]))),
        "floors_total": lambda: F.when(of("building"), F.col("_floors")),
        "underground_floors": lambda: F.when(of("building"), F.col("_below")),
        "floors_above_ground": lambda: F.when(of("building"), F.col("_floors") - F.col("_below")),
        "year_built": lambda: F.when(of("building", "structure", "ons"), whole(x["year_built"])),
        "room_type": lambda: F.when(of("room", "parking"), stated(F.coalesce(some(x["type_value"]), x["type"]))),
        "parent_cad_number": lambda: F.when(of("room", "parking"), F.coalesce(some(parent), some(x["build_cad_number"]))),
        "main_type": lambda: F.when(of("structure", "ons"), stated(x["main_type"])),
        "main_value": lambda: F.when(of("structure", "ons"), number(x["main_value"])),
        "main_unit": lambda: F.when(of("structure", "ons"), stated(x["main_unit"])),
        "land_cad_numbers": lambda: F.when(of("building", "structure", "ons"), cads("land_cad_number")),
        "rights": lambda: F.concat(F.transform(x["rights"], _right), F.filter(F.transform(x["restrictions"], _restriction_of_right), lambda r: r["right_number"].isNotNull())),
        "object_restrictions": lambda: _object_restrictions(x),
    }
    ok = F.col("problem").isNull()
    return found.select(*(c for c in df.columns if c != text), "problem", *(F.when(ok, fields[n]()).alias(n) for n in columns or fields))
