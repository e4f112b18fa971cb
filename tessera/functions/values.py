"""JSON, arrays, maps and shares (PRJ-02..07, COL-01..08, SET-03/05/07, AGG-17, FLT-11/12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of hidden, paid and empty fields.
MASKS = ("***", "•••")
PAID = ("платн", "заказать отчет", "доступно в отчете")
EMPTY = ("-", "—", "–", "", "не указано", "нет данных")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def decode(code: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """PRJ-02: code to label."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), code)
    return found if default is None else F.coalesce(found, default)


def share_text(numerator: Column, denominator: Column) -> Column:
    """PRJ-03 for views: 'n/d', whole where nothing is stated."""
    return F.concat(F.coalesce(numerator.cast("string"), F.lit("1")), F.lit("/"), F.coalesce(denominator.cast("string"), F.lit("1")))


def share_or_null(numerator: Column, denominator: Column) -> Column:
    """PRJ-03 for serving: NULL where a part is missing or the denominator is 0."""
    return F.when(denominator != 0, F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string")))


def share_ratio(numerator: Column, denominator: Column) -> Column:
    """The share as a number; nothing stated is the whole."""
    return F.when(numerator.isNull() | denominator.isNull() | (denominator == 0), F.lit(1.0)).otherwise(numerator / denominator)


def parse_share(text: Column) -> Column:
    """TXT-04: struct(numerator, denominator)."""
    part = lambda g: F.nullif(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", g), F.lit("")).try_cast("long")
    return F.struct(part(1).alias("numerator"), part(2).alias("denominator"))


def json_or_null(text: Column) -> Column:
    """PRJ-05."""
    return F.try_parse_json(text)


def json_list(text: Column) -> Column:
    """COL-05, PRJ-04: array of a JSON list; malformed or missing is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def lists_differ(old: Column, new: Column) -> Column:
    """COL-01: JSON lists as sets with counts; [] equals NULL and a missing new list is no change."""
    return F.when(new.isNull(), F.lit(False)).otherwise(F.array_sort(json_list(old)) != F.array_sort(json_list(new)))


def without_keys(attrs: Column, banned: list[str]) -> Column:
    """PRJ-06: personal keys dropped from a map."""
    return F.map_filter(attrs, lambda k, _: ~F.lower(k).isin([b.lower() for b in banned]))


def without_technical(attrs: Column) -> Column:
    """PRJ-07: keys that start with an underscore dropped."""
    return F.map_filter(attrs, lambda k, _: ~k.startswith("_"))


def is_masked(value: Column) -> Column:
    """FLT-11: missing, hidden, paid for or an empty marker."""
    s = F.lower(F.trim(value))
    hidden = F.lit(False)
    for m in (*MASKS, *PAID):
        hidden = hidden | s.contains(m)
    return F.coalesce(hidden | s.isin(*EMPTY), F.lit(True))


def cleaned(value: Column) -> Column:
    """FLT-12: trimmed; markers of nothing become NULL."""
    return F.when(~F.lower(F.trim(value)).isin(*EMPTY), F.trim(value))


def labelled(restrictions: Column, labels: dict[str, str]) -> Column:
    """COL-03: each struct of an array with a label for its type."""
    return F.transform(restrictions, lambda r: F.struct(r["type"].alias("type"), r["text"].alias("text"), decode(r["type"], labels, r["type"]).alias("label")))


def conditional_number(numbers: Column) -> Column:
    """COL-04: the first old number whose type speaks of a conditional one."""
    return F.try_element_at(F.filter(numbers, lambda n: F.lower(n["type"]).contains("усл")), F.lit(1))["number"]


def target_path(path: Column) -> Column:
    """COL-06: 'collection[key=value].field' in parts; NULLs where it doesn't read so."""
    p = r"^([a-z_]+)\[([a-z_]+)=([^\]]+)\]\.([a-z_]+)$"
    part = lambda g: F.nullif(F.regexp_extract(path, p, g), F.lit(""))
    return F.struct(*(part(i + 1).alias(n) for i, n in enumerate(("collection", "key", "value", "field"))))


def links(ids: Column, kinds: Column) -> Column:
    """COL-07: parallel arrays as structs."""
    return F.zip_with(ids, kinds, lambda i, k: F.struct(i.alias("id"), k.alias("kind")))


def photo_payload(comment: Column, app: str, most: int = 1000) -> Column:
    """COL-08: struct of a photo's JSON comment, if it is the application's own; the note is cut to `most` letters."""
    own = F.get_json_object(comment, "$.app") == app
    return F.when(own, F.struct(F.get_json_object(comment, "$.cad").alias("cad"), F.substring(F.get_json_object(comment, "$.note"), 1, most).alias("note")))


def union_lists(*lists: Column) -> Column:
    """AGG-17, SET-05: all lists in order, each value where it stands first."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def union_sorted(a: Column, b: Column) -> Column:
    """SET-07."""
    return F.array_sort(F.array_union(a, b))


def overlap(a: Column, b: Column) -> Column:
    """SET-03: shared tokens by the larger set."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b))), F.lit(0.0))
