"""Dates and terms in registry texts, as Column expressions (DAT-01..13). Dates are DATE columns, moments TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import bound


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


_RU = r"(?<![0-9\p{L}_])(\d{2})\.(\d{2})\.(\d{4})(?![0-9\p{L}_])"


def date_ru(text: Column) -> Column:
    """DAT-01: the first DD.MM.YYYY; a year may run into 'г.'. A date that doesn't exist gives NULL."""
    clean = F.regexp_replace(text, r"(\d{4})г\.?", "$1 ")
    return _date(_group(clean, _RU, 3), _group(clean, _RU, 2), _group(clean, _RU, 1))


def datetime_ru(text: Column) -> Column:
    """DAT-02: the first DD.MM.YYYY HH:MM:SS."""
    found = _group(text, r"(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.regexp_replace(found, r"\s+", " "), F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz")


def date_any(text: Column) -> Column:
    """DAT-03: ISO moment (zone dropped), ISO date, DD.MM.YYYY with or without time, else the first Russian date.

    Text out: 'YYYY-MM-DD', or with ' HH:MM:SS' where the time isn't midnight (a Russian midnight keeps its time).
    """
    t = F.trim(text)
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    day = F.try_to_date(_group(t, iso, 1), "yyyy-MM-dd")
    time = _group(t, iso, 2)
    plain = F.try_to_date(_group(t, r"(?<![0-9\p{L}_])(\d{4}-\d{2}-\d{2})(?![0-9\p{L}_])", 1), "yyyy-MM-dd")
    ru = r"^(\d{2})\.(\d{2})\.(\d{4})(?:\s+(\d{2}:\d{2}:\d{2}))?"
    ru_day, ru_time = _date(_group(t, ru, 3), _group(t, ru, 2), _group(t, ru, 1)), _group(t, ru, 4)
    return F.coalesce(
        F.when(day.isNotNull(), F.when(time == "00:00:00", day.cast("string")).otherwise(F.concat_ws(" ", day.cast("string"), time))),
        plain.cast("string"),
        F.when(ru_day.isNotNull(), F.concat_ws(" ", ru_day.cast("string"), ru_time)),
        date_ru(text).cast("string"),
    )


def add_years(day: Column, years: Column) -> Column:
    """DAT-04: the same day so many years on; 29 February of a common year gives NULL."""
    return F.try_to_date(F.concat_ws("-", F.lpad((F.year(day) + years).cast("string"), 4, "0"), F.date_format(day, "MM-dd")), "yyyy-MM-dd")


def term(text: Column) -> Column:
    """DAT-05: struct(valid_from, valid_until, years, description) of a term's wording: span before years before start."""
    ru = r"с\s+(\d{2}\.\d{2}\.\d{4})"
    span, years = ru + r"\s+по\s+(\d{2}\.\d{2}\.\d{4})", ru + r"\s+(?:сроком\s+на\s+(\d+)\s+лет|(\d+)\s*лет)"
    day = lambda c: F.try_to_date(c, "dd.MM.yyyy")

    def read(t: Column) -> Column:
        is_open = t.rlike(r"(?iu)бессрочно|на неопределённый срок|не установлен")
        return F.struct(
            t.alias("t"),
            is_open.alias("open"),
            *(F.when(~is_open, c).alias(n) for n, c in {"a": _group(t, span, 1), "b": _group(t, span, 2), "y": _group(t, years, 1), "n": F.coalesce(_group(t, years, 2), _group(t, years, 3)).try_cast("int"), "s": _group(t, ru, 1)}.items()),
        )

    def result(p: Column) -> Column:
        by_years = p["a"].isNull() & p["y"].isNotNull()
        since = day(F.coalesce(p["a"], p["y"], p["s"]))
        until = F.when(p["a"].isNotNull(), day(p["b"])).when(by_years, bound(since, lambda d: add_years(d, p["n"])))
        wording = F.when(p["open"], F.lit("бессрочно")).when(p["s"].isNull(), F.nullif(p["t"], F.lit("")))
        return F.struct(since.alias("valid_from"), until.alias("valid_until"), F.when(by_years, p["n"]).alias("years"), wording.alias("description"))

    return bound(bound(F.coalesce(F.trim(text), F.lit("")), read), result)


def ledger_period(title: Column) -> Column:
    """DAT-06: struct(period_from, period_to) of a ledger's title: quarter, half-year, nine months, year; else NULLs."""
    quarter, half = r"(?iu)за\s+([1-4])\s+квартал\s+(\d{4})", r"(?iu)за\s+([12])\s+полугодие\s+(\d{4})"
    nine, year = r"(?iu)за\s+9\s+месяцев\s+(\d{4})", r"(?iu)за\s+(\d{4})\s+г"
    q, h = _group(title, quarter, 1).try_cast("int"), _group(title, half, 1).try_cast("int")
    y = F.coalesce(_group(title, quarter, 2), _group(title, half, 2), _group(title, nine, 1), _group(title, year, 1)).try_cast("int")
    first = F.when(q.isNotNull(), q * 3 - 2).when(h.isNotNull(), h * 6 - 5).otherwise(F.lit(1))
    months = F.when(q.isNotNull(), F.lit(3)).when(h.isNotNull(), F.lit(6)).when(title.rlike(nine), F.lit(9)).otherwise(F.lit(12))
    start = F.when(y.isNotNull(), F.make_date(y, first, F.lit(1)))
    return F.struct(start.alias("period_from"), F.date_sub(F.add_months(start, months), 1).alias("period_to"))


def annual_factor(start: Column, end: Column) -> Column:
    """DAT-07: 365 / days, both ends counted, to six places; 1 where there are no days."""
    days = F.datediff(end, start) + 1
    return F.when(days > 0, F.round(F.lit(365.0) / days, 6)).otherwise(F.lit(1.0))


def show_ru(moment: Column) -> Column:
    """DAT-08: DD.MM.YYYY, with the time where it isn't midnight."""
    midnight = F.date_format(moment, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(moment, "dd.MM.yyyy")).otherwise(F.date_format(moment, "dd.MM.yyyy HH:mm:ss"))


def filename_date(name: Column) -> Column:
    """DAT-09: DD-MM-YYYY in a file name."""
    p = r"(\d{2})-(\d{2})-(\d{4})"
    return _date(_group(name, p, 3), _group(name, p, 2), _group(name, p, 1))


def is_iso_date(text: Column) -> Column:
    """DAT-10: exactly YYYY-MM-DD, and a day that exists."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def moments_differ(a: Column, b: Column, seconds: int = 60) -> Column:
    """DAT-11: more than so many seconds apart."""
    return F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))) > seconds


def open_at(since: Column, until: Column, at: Column) -> Column:
    """DAT-12, FLT-10: since <= at < until; a missing bound is open."""
    return (since.isNull() | (since <= at)) & (until.isNull() | (until > at))


def document_date(kind: Column, text: Column, patterns: dict[str, str]) -> Column:
    """DAT-13: the date after the kind's own pattern, else the first in the text."""
    own = [F.when(kind == k, date_ru(_group(text, p + r"\D{0,20}(\d{2}\.\d{2}\.\d{4})", 1))) for k, p in patterns.items()]
    return F.coalesce(*own, date_ru(text))
