"""Numbers, hashes and level heights (MTH-01..11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x{00a0}]"
STOREY = 3.0
SEMI_BASEMENT, TECHNICAL_BELOW, MEZZANINE = -2.0, -1.0, 2.0


def number(text: Column) -> Column:
    """MTH-01: digits, point and minus of a text, a comma being a point; what isn't a number gives NULL."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACES, ""), ",", "."), r"[^0-9.\-]", "").try_cast("double")


def leading_number(text: Column) -> Column:
    """MTH-02: the number that the text starts with, blanks inside it dropped."""
    lead = F.regexp_extract(F.trim(F.regexp_replace(text, r"\x{00a0}", " ")), r"^([\d\s]+(?:[.,]\d+)?)", 1)
    return F.replace(F.replace(lead, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def year(text: Column, low: int = 1700, high: int = 2100) -> Column:
    """MTH-03: a whole number between the bounds."""
    n = F.trim(text.cast("string")).try_cast("int")
    return F.when(n.between(low, high), n)


def values_differ(old: Column, new: Column, tolerance: float = 1e-4) -> Column:
    """MTH-04: numbers that differ by more than the relative tolerance. A missing new value is no change."""
    largest = F.greatest(F.abs(old), F.abs(new), F.lit(1e-9))
    return F.when(new.isNull(), F.lit(False)).when(old.isNull(), F.lit(True)).otherwise(F.abs(old - new) / largest > tolerance)


def texts_differ(old: Column, new: Column) -> Column:
    """MTH-04 for texts: trimmed, and a missing new value is no change."""
    return F.when(new.isNull(), F.lit(False)).when(old.isNull(), F.lit(True)).otherwise(F.trim(old) != F.trim(new))


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """MTH-05: SHA-1 over the parts, each ended by a NUL; the first hex digits. NULL counts as empty."""
    joined = F.concat(*(x for p in parts for x in (F.encode(F.coalesce(p.cast("string"), F.lit("")), "utf-8"), F.lit(b"\x00"))))
    return F.substring(F.sha1(joined), 1, length)


def content_hash(*fields: Column) -> Column:
    """MTH-06: SHA-256 over the significant fields in the order given, as text; NULL is marked apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields)), 256)


def level_height(kind: Column, label: Column, underground: Column, storeys: Column) -> Column:
    """MTH-07: metres of a level's floor over that of the first storey."""
    k, text, n = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(label, F.lit(""))), F.coalesce(storeys, F.lit(0)).cast("double")
    part = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).try_cast("double")
    basement = F.coalesce(part(r"подвал\s*(\d+)", 1), part(r"(\d+)\s*подвал", 1), F.lit(1.0))
    mezzanine, storey = part(r"антресол\p{L}*\s+(\d+)\s*эта", 1), part(r"этаж\s+(\d+)", 1)
    above = (
        F.when(k.contains("антресол"), F.when(mezzanine.isNotNull(), (mezzanine - 1) * STOREY + MEZZANINE).when(n > 0, (n - 1) * STOREY + MEZZANINE).otherwise(MEZZANINE))
        .when(k.rlike("мансарда|чердак|эксплуатируемая кровля|надстро"), F.when(n > 0, n * STOREY).otherwise(STOREY))
        .when(k.contains("технич"), F.when(n > 0, (n + 1) * STOREY).otherwise(0.0))
        .when(storey.isNotNull(), (storey - 1) * STOREY)
    )
    below = F.when(k.rlike("полуподвал|цоколь"), SEMI_BASEMENT).when(k.rlike("тех.*подпол"), TECHNICAL_BELOW).otherwise(-basement * STOREY)
    return F.when(F.coalesce(underground, F.lit(False)), below).otherwise(above)


def levels(above: Column, below: Column) -> Column:
    """MTH-08: array of struct(number, underground, label) from the lowest basement up to the top storey."""
    down = F.when(below > 0, F.transform(F.sequence(below, F.lit(1)), lambda k: F.struct(k.alias("number"), F.lit(True).alias("underground"), F.concat(F.lit("Подвал "), k.cast("string")).alias("label"))))
    up = F.when(above > 0, F.transform(F.sequence(F.lit(1), above), lambda k: F.struct(k.alias("number"), F.lit(False).alias("underground"), F.concat(F.lit("Этаж "), k.cast("string")).alias("label"))))
    empty = F.array().cast("array<struct<number:int,underground:boolean,label:string>>")
    return F.concat(F.coalesce(down, empty), F.coalesce(up, empty))


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """MTH-09: decimal degrees, negative in the south and west."""
    return (degrees + minutes / 60.0 + seconds / 3600.0) * F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)


def scale_correction(stated: Column, computed: Column) -> Column:
    """MTH-10."""
    return F.round(F.try_divide(stated, computed), 6)


def version_key(version: Column) -> Column:
    """MTH-11: 'v8.5' as a struct that compares."""
    part = lambda g: F.coalesce(F.nullif(F.regexp_extract(version, r"(\d+)(?:\.(\d+))?", g), F.lit("")).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))
