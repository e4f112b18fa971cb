"""Trial balances as the accounting program lays them out in a sheet (SRC-06): assets of own and leased property, and their values.

Line 1 names the organisation, line 2 the period; data begin in line 7: name or account in A, kind of record in B, opening debit,
turnovers and closing debit in C, F and G. Which account a line belongs to follows from the last marker above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import annual_factor, ledger_period
from tessera.functions.numbers import number
from tessera.functions.text import cad_numbers, inventory_number

#: Accounts of own and of leased assets, kinds of records, and places of the columns.
OWN, LEASED = "01.01", "01.К"
BOOK, TAX, DIFFERENCE = "БУ", "НУ", "ВР"
FIRST = 7
_PLACES = {"a": 1, "b": 2, "debit_start": 3, "turn_credit": 6, "debit_end": 7}
_DAY = r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})"


def ledger_assets(grid: DataFrame) -> DataFrame:
    """(archive, sheet, row, entity_name, period_from, period_to, factor, account, item_name, inventory_number, cad, cad_fragment,
    category, is_disposed, debit_start, debit_end, turn_credit) of a grid of cells.

    Own assets are book records, leased ones tax records; differences, totals of accounts and of days fall away, and so does all
    below the line of totals. An id is whole, or a fragment that has yet to be matched. factor: turnover to a year's.
    """
    lines = grid.groupBy("archive", "sheet", "row").agg(*(F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for n, i in _PLACES.items()))
    lines = lines.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("a", "b")})
    sheet = Window.partitionBy("archive", "sheet")
    above = sheet.orderBy("row")
    title = F.max(F.when(F.col("row") == 2, F.col("a"))).over(sheet)
    lines = lines.withColumns({"entity_name": F.nullif(F.max(F.when(F.col("row") == 1, F.col("a"))).over(sheet), F.lit("")), "_p": ledger_period(title)})
    lines = lines.where((F.col("row") >= FIRST) & (F.col("b") != DIFFERENCE))
    leased = (F.col("a") == LEASED) & F.col("b").isin(BOOK, "")
    ended = F.max(F.lower("a").startswith("итого")).over(above)
    lines = lines.withColumns({"_marker": leased, "account": F.when(F.max(leased).over(above), LEASED).otherwise(OWN), "_ended": ended})
    skipped = F.col("_ended") | F.col("_marker") | ((F.col("a") == "01") & (F.col("b") == BOOK)) | ((F.col("b") == BOOK) & F.col("a").rlike(_DAY))
    items = lines.where(~skipped & (F.col("a") != "") & (F.col("b") == F.when(F.col("account") == OWN, BOOK).otherwise(TAX)))
    cad = F.get(cad_numbers(F.col("a")), F.lit(0))
    fragment = F.concat(F.lit(":"), F.nullif(F.regexp_extract("a", r"(?U):(\d{3,5})\b", 1), F.lit("")))
    money = {c: F.coalesce(number(F.col(c)), F.lit(0.0)) for c in ("debit_start", "debit_end", "turn_credit")}
    items = items.withColumns(money)
    disposed = (F.col("account") == OWN) & (F.col("debit_end") < 1) & (F.col("turn_credit") > 0)
    return items.select(
        "archive", "sheet", "row", "entity_name", F.col("_p.period_from").alias("period_from"), F.col("_p.period_to").alias("period_to"), F.coalesce(annual_factor(F.col("_p.period_from"), F.col("_p.period_to")), F.lit(1.0)).alias("factor"), "account", F.col("a").alias("item_name"), inventory_number(F.col("a")).alias("inventory_number"),
        cad.alias("cad"), F.when(cad.isNull(), fragment).alias("cad_fragment"), F.when(F.col("account") == OWN, "right").otherwise("encumbrance").alias("category"), disposed.alias("is_disposed"), *money,
    )


def ledger_values(assets: DataFrame) -> DataFrame:
    """Up to three values of each asset: initial and residual, and a write-off or a year's lease."""
    value = lambda kind, when, amount, day: F.when(when, F.struct(F.lit(kind).alias("kind"), amount.alias("amount"), day.alias("day")))
    start, end, turn = F.col("debit_start"), F.col("debit_end"), F.col("turn_credit")
    values = F.array(
        value("initial", start > 0, start, F.col("period_from")), value("residual", end > 0, end, F.col("period_to")), value("writeoff", F.col("is_disposed"), turn, F.col("period_to")),
        value("lease_annual", (F.col("account") == LEASED) & (turn > 0), F.round(turn * F.col("factor"), 2), F.col("period_to")),
    )
    return assets.select("archive", "sheet", "row", "account", "item_name", "inventory_number", "cad", F.inline(F.filter(values, lambda v: v.isNotNull())))
