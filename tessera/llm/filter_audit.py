"""How filters interact: what each one removes at each place of each order, and its Shapley value, from counts of masks alone.

A document's mask says which filters it fails. The documents are reduced to counts by part and mask; a part then has at most
2^n rows, whatever its size. The removal polynomial of a part is the multilinear extension of "documents removed by a set of
filters": R(x) = sum over masks of c(mask) (1 - product over its filters of (1 - x_i)). At a corner (x_i = 1 for the filters
applied, else 0) it counts what they remove. A filter's Shapley value is the integral of its partial derivative along the
diagonal from 0 to 1, taken with exact rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

WORD = "[^ \\t-\\r]+"
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class RemovalPolynomial:
    """Coefficients by set of filters (bits): R(x) = sum of a(T) times the product of x_i over T."""

    def __init__(self, counts: dict[int, int], n: int):
        a = [0] * (1 << n)
        for mask, c in counts.items():
            a[mask] += c
        for i in range(n):  # documents that fail at least T
            for t in range(1 << n):
                if not t >> i & 1:
                    a[t] += a[t | 1 << i]
        self.total = a[0]
        self.a = {t: c if t.bit_count() % 2 else -c for t, c in enumerate(a) if t and c}

    def corner(self, applied: int) -> int:
        """Documents that the applied filters remove."""
        return sum(c for t, c in self.a.items() if t & applied == t)

    def shapley(self, i: int) -> Fraction:
        """Integral from 0 to 1 of dR/dx_i at x = (t, ..., t)."""
        by_power: dict[int, int] = {}
        for t, c in self.a.items():
            if t >> i & 1:
                by_power[t.bit_count() - 1] = by_power.get(t.bit_count() - 1, 0) + c
        return sum((Fraction(c, power + 1) for power, c in by_power.items()), Fraction(0))


def _rows(letters: str):
    """All orders and steps of one part from its counts of masks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, orders = len(letters), factorial(len(letters))
        every = (1 << n) - 1
        whole, good, toxic = (RemovalPolynomial(pdf.groupby("mask")[c].sum().astype(object).to_dict(), n) for c in ("n", "good", "toxic"))
        scaled = [whole.shapley(i) * orders for i in range(n)]
        if any(s.denominator != 1 for s in scaled):
            raise ArithmeticError("a value over all orders is a whole number")
        alone, unique = [whole.corner(1 << i) for i in range(n)], [whole.corner(every) - whole.corner(every & ~(1 << i)) for i in range(n)]
        at = {s: (whole.corner(s), good.corner(s), toxic.corner(s)) for s in range(1 << n)}
        out = []
        for order in permutations(range(n)):
            name, applied = "".join(letters[i] for i in order), 0
            for step, i in enumerate(order, 1):
                before, applied = at[applied], applied | 1 << i
                removed, good_lost, toxic_lost = (b - a for a, b in zip(before, at[applied], strict=True))
                out.append((pdf["part"].iloc[0], name, step, whole.total - at[applied][0], removed, alone[i] - removed, unique[i], good_lost, toxic_lost, int(scaled[i])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def mask_counts(df: DataFrame, labels: DataFrame, failures: dict[str, Column], repeated: bool = True, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic. Bit i stands for the i-th failure; repeated adds one more bit.

    That last bit says that a smaller id has the same text. It needs no join: of the rows of a text those with the smallest id
    are the ones without it, so what they are is counted apart from all.
    """
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(failures.values())), F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    # rows repeated as a whole become one with a count, before anything is joined
    docs = docs.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    docs = docs.join(judged, "doc_id", "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    docs = docs.select("key", "doc_id", "part", "mask", *flags, "n")
    kind = ["part", "mask", "good", "toxic"]
    if not repeated:
        counts = docs.groupBy(*kind).agg(F.sum("n").alias("n"))
    else:
        rows = docs.where("doc_id is not null").groupBy("key", "doc_id").agg(F.collect_list(F.struct(*kind, "n")).alias("rows"))
        first = rows.groupBy("key").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
        last, known = 1 << len(failures), docs.where("doc_id is not null")
        signed = [
            docs.where("doc_id is null").select(*kind, "n"),
            first,
            known.select("part", (F.col("mask") + last).alias("mask"), "good", "toxic", "n"),
            first.select("part", (F.col("mask") + last).alias("mask"), "good", "toxic", (-F.col("n")).alias("n")),
        ]
        counts = signed[0]
        for more in signed[1:]:
            counts = counts.unionByName(more)
        counts = counts.groupBy(*kind).agg(F.sum("n").alias("n")).where("n > 0")
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def audit(df: DataFrame, labels: DataFrame, failures: dict[str, Column], repeated: str | None = "E", **columns: str) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times n!).

    failures: letter -> condition under which a row fails; a null condition doesn't. repeated: the letter of the filter that
    rows fail whose text a smaller id has too; equal ids and null ids fail it not, as none of them is smaller. Null texts are
    empty, null parts the empty string. A doc_id with several labels is good or toxic if one of them says so. Each row is a
    document of its own, also where rows are repeated. Very long texts are read where they lie; only their hash travels. An
    empty table gives no rows.
    """
    counts = mask_counts(df, labels, failures, bool(repeated), **columns)
    return counts.groupBy("part").applyInPandas(_rows("".join(failures) + (repeated or "")), _OUT)


def text_failures(text_col: str = "text") -> dict[str, Column]:
    """A: under 100 words. B: under 80 % of the words distinct. C: over 10 % capital letters. D: a character of #$%&*|."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_failures())
