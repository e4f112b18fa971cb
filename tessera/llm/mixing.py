"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is spread evenly over its lengths: each length gets
its share rounded down, and one document more where the largest remainders are, until a bounded part of the budget is
left. A bounded-knapsack dynamic programme over the counts that remain fits that rest to the word. The documents of a
length are chosen by a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2
#: Largest budget that the dynamic programme sees: words.
EXACT_BUDGET = 1 << 16
PART_ROWS = 20_000


def water_fill(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of total by weight; none above limit times its size, the excess reshared by weight until none is above."""
    targets = [0.0] * len(sizes)
    active, left = [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while active:
        weight = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in active:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(limit * sizes[i])
        left -= sum(targets[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return targets


def _mixed(n: int) -> int:
    """An order of lengths that isn't one of size; no two are equal."""
    return (n * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def fit_budget(counts: dict[int, int], budget: int, exact: int = EXACT_BUDGET) -> dict[int, int]:
    """How many documents of each length to take (at most counts) for a sum near budget and not above it."""
    whole = sum(n * c for n, c in counts.items())
    if budget >= whole:
        return dict(counts)
    took = {n: c * budget // whole for n, c in counts.items()}
    left = budget - sum(n * c for n, c in took.items())
    # no length is favoured: what is left is less than one document of each
    for n in sorted(counts, key=lambda n: (-(counts[n] * budget % whole), _mixed(n))):
        if left <= exact:
            break
        if n <= left and took[n] < counts[n]:
            took[n] += 1
            left -= n
    # sums that can be reached, as the bits of one number; one state for each power-of-two batch of a length
    states, items, reach, mask = [], [], 1, (1 << (left + 1)) - 1
    # one document of each length, lengths in no order of size, then two of each, then four, until the rest is met
    free, batch = {n: counts[n] - took[n] for n in sorted(counts, key=_mixed) if counts[n] > took[n] and n <= left}, 1
    while free and not reach >> left & 1:
        for n in list(free):
            use = min(batch, free[n])
            states.append(reach)
            items.append((n, use))
            reach |= (reach << (n * use)) & mask
            free[n] -= use
            if not free[n] or 2 * batch * n > left:
                del free[n]
            if reach >> left & 1:
                break
        batch *= 2
    at = reach.bit_length() - 1
    for before, (n, use) in zip(reversed(states), reversed(items), strict=True):
        if not before >> at & 1:
            took[n] += use
            at -= n * use
    return took


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
    took = fit_budget({n: c for n, c in counts.items() if n > 0}, int(pdf["extra"].iloc[0]))
    return pdf[["src", "size", "n"]].assign(take=[took.get(n, 0) for n in pdf["size"]])


def source_targets(hist: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> list[tuple[str, int, float]]:
    """(source key, source size, target) for each source; the table of sources is small and is gathered."""
    rows = [(r.src, r.words) for r in hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    rows.sort(key=lambda r: (r[0] == "n", r[0]))  # str order is by code point; the key of null is 'n', of others 's' and the name
    cycle = [weights[i % len(weights)] for i in range(len(rows))]
    targets = water_fill([w for _, w in rows], cycle, share * sum(w for _, w in rows), limit)
    return [(s, w, t) for (s, w), t in zip(rows, targets, strict=True)]


def words(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 17, part_rows: int = PART_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, size, source_size, target, taken (0, 1 or 2 times size) and the columns named in keep.

    Null text has size 0; null source is a source of its own, last in order. Documents without words take nothing. Equal
    rows are told apart by an order of their own inside their hash, so a part of them may be taken. A very long text is a
    length of its own. The table of sources is gathered, a row for each. An empty table gives no rows.
    """
    spark = df.sparkSession
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 33)  # 31 bits
    rows = materialise(df.select(F.col(id_col).cast("long").alias("doc_id"), words(text_col).alias("size"), src.alias("src"), draw.alias("draw"), *keep), "sizes")
    hist = rows.groupBy("src", "size").agg(F.count("*").alias("n"))
    targets = source_targets(hist, weights, share, limit)
    budgets = [(s, w, t, int(round(t)) >= w, int(round(t)) - (w if round(t) >= w else 0)) for s, w, t in targets]
    schema = T.StructType([T.StructField("src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("all_once", T.BooleanType()), T.StructField("extra", T.LongType())])
    budget = spark.createDataFrame(budgets, schema)
    fitted = hist.join(budget.select("src", "extra"), "src").groupBy("src").applyInPandas(_fit, "src string, size long, n long, take long")
    plan = materialise(fitted.join(budget.drop("extra"), "src"), "plan")
    planned = rows.join(plan, ["src", "size"])
    # the first `take` rows of a length by draw: parts of the range of draws keep each sorted group small
    parts = F.ceil(F.col("n") / part_rows).cast("long")
    ranked = planned.withColumn("part", F.shiftrightunsigned(F.col("draw") * parts, 31).cast("int"))
    counts = ranked.groupBy("src", "size", "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "size", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("src", "size", "part").orderBy("draw", F.col("doc_id").asc_nulls_last())
    chosen = ranked.join(offsets, ["src", "size", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(order))
    copies = F.col("all_once").cast("long") + (F.col("rank") <= F.col("take")).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *keep)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document, sources weighing 5, 2, 1, repeating."""
    return mix(table(spark, sf_dir, "documents"))
