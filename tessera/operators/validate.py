"""Checks that give rows of violations (VAL-01..10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import is_iso_date
from tessera.functions.text import speaks_of_consent

#: Which types may stand for each other.
AFFINITY = {"string": "text", "int": "number", "bigint": "number", "smallint": "number", "tinyint": "number", "double": "number", "float": "number", "date": "time", "timestamp": "time", "timestamp_ntz": "time", "boolean": "flag"}


def schema_violations(spark: SparkSession, tables: dict[str, DataFrame], contract: dict[str, dict[str, str]]) -> DataFrame:
    """VAL-01/02: (table, column, problem): missing tables and columns, types of another kind; more columns are fine."""
    rows = []
    for table, columns in contract.items():
        if table not in tables:
            rows.append((table, None, "missing table"))
            continue
        have = dict(tables[table].dtypes)
        for column, kind in columns.items():
            if column not in have:
                rows.append((table, column, "missing column"))
            elif AFFINITY.get(have[column], have[column]) != AFFINITY.get(kind, kind):
                rows.append((table, column, f"{have[column]} for {kind}"))
    return spark.createDataFrame(rows, "table string, column string, problem string")


def ddl_columns(ddl: DataFrame, text: str) -> DataFrame:
    """VAL-02: (table, column) of CREATE TABLE texts."""
    table = F.regexp_extract(F.col(text), r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([a-z_]+)", 1)
    body = F.regexp_extract(F.col(text), r"(?is)create\s+table[^(]*\((.*)\)", 1)
    items = F.transform(F.split(F.regexp_replace(body, r"\([^()]*\)", ""), ","), lambda x: F.lower(F.regexp_extract(F.trim(x), r"^\"?([A-Za-z_]+)", 1)))
    flat = ddl.select(F.lower(table).alias("table"), F.explode(items).alias("column"))
    return flat.where("column <> '' and column not in ('primary', 'unique', 'foreign', 'check', 'constraint')")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """VAL-03..10: (key, rule) for each rule that a row breaks; a rule that is NULL isn't broken."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def file_violations(manifest: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """VAL-03: manifest(name, sha256, size) against files(name, content): missing, another size, another hash."""
    have = files.select(name, F.sha2("content", 256).alias("_h"), F.octet_length("content").alias("_n"), F.lit(True).alias("_f"))
    return violations(manifest.join(have, name, "left"), name, {"missing": F.col("_f").isNull(), "size": F.col("_n") != F.col("size"), "sha256": F.col("_h") != F.col("sha256")})


#: Kinds of documents and the beginnings of their ids.
KINDS = {"extract": "ext_", "contract": "con_", "act": "act_", "order": "ord_", "report": "rep_", "letter": "let_"}


def document_rules(key: str = "doc_id", kind: str = "kind", day: str = "doc_date", effects: str = "effects") -> dict[str, Column]:
    """VAL-04: id by kind, a real day, effects with a known operation and a target that reads as a path."""
    prefix = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col(kind))
    known = F.col(kind).isin(*KINDS)
    path = r"^[a-z_]+\[[a-z_]+=[^\]]+\]\.[a-z_]+$"
    return {
        "kind": ~known,
        "id_prefix": known & ~F.col(key).startswith(prefix),
        "doc_date": ~is_iso_date(F.col(day)),
        "op": F.exists(F.col(effects), lambda e: ~F.coalesce(e["op"].isin("add", "remove", "change"), F.lit(False))),
        "target": F.exists(F.col(effects), lambda e: ~F.coalesce(e["target"].rlike(path), F.lit(False))),
    }


def enum_rule(column: str, allowed: list[str]) -> Column:
    return ~F.col(column).isin(*allowed)


def range_rule(column: str, low: float, high: float) -> Column:
    return ~F.col(column).between(low, high)


def id_rule(column: str, pattern: str = r"^[A-Za-z0-9_:.\-]{1,256}$") -> Column:
    """VAL-05."""
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-05: keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Numbers of digits of requisites.
DIGITS = {"inn": (10, 12), "kpp": (9,), "ogrn": (13, 15), "bik": (9,), "account": (20,), "corr_account": (20,), "okpo": (8, 10)}


def requisite_rules(columns: list[str]) -> dict[str, Column]:
    """VAL-06: digits only, as many as the requisite has; NULL passes."""
    return {c: ~F.col(c).rlike("^(" + "|".join(rf"\d{{{n}}}" for n in DIGITS[c]) + ")$") for c in columns if c in DIGITS}


def tag_rules(namespaces: dict[str, list[str] | None], namespace: str = "namespace", value: str = "value") -> dict[str, Column]:
    """VAL-07: a known namespace, and a listed value where the namespace lists them."""
    listed = [(F.col(namespace) == n) & ~F.col(value).isin(*v) for n, v in namespaces.items() if v]
    return {"namespace": ~F.col(namespace).isin(*namespaces), "value": reduce(lambda a, b: a | b, listed, F.lit(False))}


def store_violations(objects: DataFrame, rights: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """VAL-08: (key, rule): personal data in a text, rights without an object."""
    personal = violations(objects, key, {f"personal:{c}": speaks_of_consent(F.col(c)) for c in texts})
    orphan = rights.join(objects.select(key), key, "left_anti").select(key, F.lit("orphan right").alias("rule"))
    return personal.unionByName(orphan)


def fact_rules(dates: list[str], lot: str) -> dict[str, Column]:
    """VAL-10: at least one date, and a lot id that reads so."""
    return {"no date": F.coalesce(*dates).isNull(), "lot id": ~F.coalesce(F.col(lot).rlike(r"^lot_[a-z0-9_]+$"), F.lit(False))}
