"""Readers of registry sources (SRC-01..28): files into rows, rows into the conformed columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dates import date_any, term
from tessera.functions.numbers import leading_number, stable_hash, year
from tessera.functions.text import cad_number, first_of, group, holder_type, pairs
from tessera.functions.values import cleaned, is_masked


def optional_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> DataFrame:
    """SRC-01: the table, or no rows of its schema where there is none."""
    if path is not None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.parquet(path)
        except AnalysisException:
            return spark.createDataFrame([], schema)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def files(spark: SparkSession, folder: str, suffix: str, content: bool = True) -> DataFrame:
    """SRC-02: (path, modified, length, content) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))


def json_files(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """SRC-10/14/16: (path, stem, text) of whole JSON files."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder)
    path = F.input_file_name()
    return df.select(path.alias("path"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


#: Keys that tell what a JSON file is, in order.
KINDS = {"$.placemarks": "kml", "$.extract": "egrn", "$.features": "nspd", "$.person": "person", "$.ip_entity": "ip_entity", "$.legal_entity": "legal_entity", "$.kadbase": "kadbase", "$.certificate": "certificate"}


def file_kind(text: Column) -> Column:
    """SRC-03: by the first key that the document has; what isn't JSON is unknown."""
    return F.coalesce(*(F.when(F.get_json_object(text, k).isNotNull(), F.lit(v)) for k, v in KINDS.items()), F.lit("unknown"))


def xml_records(spark: SparkSession, folder: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-09: elements of XML files as rows; namespaces don't count."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).load(folder)


def storeys(total: Column, underground: Column) -> Column:
    """SRC-05: struct(above, below); 200 and more aren't storeys, above is the total without those below."""
    ok = lambda c: F.when(c.try_cast("int") < 200, c.try_cast("int"))
    below = F.coalesce(ok(underground), F.lit(0))
    return F.struct((ok(total) - below).alias("above"), below.alias("below"))


def ledger_rows(sheet: DataFrame, order: str, marker: str, name: str, sections: list[str]) -> DataFrame:
    """SRC-06: rows under their section's account; the rows that name a section fall away. One file is one order of rows."""
    found = F.when(F.col(marker).isin(*sections), F.col(marker))
    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = sheet.withColumn("account", F.last(found, ignorenulls=True).over(w))
    return out.where(F.col("account").isNotNull() & found.isNull() & F.col(name).isNotNull())


def valuations(rows: DataFrame, initial: str, residual: str, third: str, account: str, lease_account: str = "01.К") -> DataFrame:
    """SRC-06: up to three money rows an asset: initial, residual, and write-off or the year's lease."""
    kind = F.when(F.col(account) == lease_account, "lease_annual").otherwise("writeoff")
    cells = F.array(F.struct(F.lit("initial").alias("kind"), F.col(initial).alias("amount")), F.struct(F.lit("residual").alias("kind"), F.col(residual).alias("amount")), F.struct(kind.alias("kind"), F.col(third).alias("amount")))
    return rows.select("*", F.inline(F.filter(cells, lambda c: c["amount"].isNotNull())))


def ledger_triples(rows: DataFrame, order: str, label: str, amounts: list[str]) -> DataFrame:
    """SRC-26: rows БУ, НУ, ВР that follow each other as one record with three structs of amounts; accounts are carried on."""
    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("account", F.last("account", ignorenulls=True).over(w)).withColumn("record", F.sum(F.when(F.col(label) == "БУ", 1).otherwise(0)).over(w)).where("record > 0")
    pick = lambda v: F.max(F.when(F.col(label) == v, F.struct(*amounts)))
    return numbered.groupBy("file", "record").agg(F.first("account").alias("account"), F.max(F.when(F.col(label) == "БУ", F.col("name"))).alias("name"), pick("БУ").alias("book"), pick("НУ").alias("tax"), pick("ВР").alias("difference"))


def columns_by_keyword(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """SRC-24, SRC-07/08/25: columns named by the first keyword that a heading contains; what isn't found is NULL."""
    picked = {}
    for name, words in wanted.items():
        picked[name] = next((c for w in words for c in df.columns if w in c.lower()), None)
    return df.select(*(F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in picked.items()))


def placemarks(df: DataFrame, name: str, description: str, coordinates: str, kinds: dict[str, str]) -> DataFrame:
    """SRC-09/21: description pairs as a map, points of the outline, a kind by words in the name or, with four colons or more, a room."""
    points = F.transform(F.filter(F.split(F.trim(F.col(coordinates)), r"\s+"), lambda t: t.contains(",")), lambda t: F.transform(F.slice(F.split(t, ","), 1, 2), lambda x: x.try_cast("double")))
    low = F.lower(F.col(name))
    kind = F.coalesce(first_of(low, kinds), F.when(F.length(F.regexp_replace(F.col(name), "[^:]", "")) >= 4, F.lit("Помещение")))
    return df.withColumns({"attrs": pairs(F.col(description)), "ring": points, "kind": kind})


def unzip(files_df: DataFrame, inner: str = ".kml") -> DataFrame:
    """SRC-09: (path, name, content) of the entries of archives that end so. Archives of maps are small; one is read at a time."""
    import io
    import zipfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows += [(path, n, z.read(n)) for n in z.namelist() if n.lower().endswith(inner)]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files_df.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def attributes(df: DataFrame, key: str, attrs: str, aliases: dict[str, str]) -> DataFrame:
    """SRC-18/27: (key, field, value): attributes under their own names, empty and hidden ones dropped, the first alias wins."""
    names = df.sparkSession.createDataFrame([(a, f, i) for i, (a, f) in enumerate(aliases.items())], "alias string, field string, ord int")
    flat = df.select(key, F.explode(attrs).alias("alias", "value")).where(~is_masked(F.col("value")))
    return flat.join(F.broadcast(names), "alias").groupBy(key, "field").agg(F.min_by("value", "ord").alias("value"))


def portal_numbers(area: Column, built: Column, floors: Column) -> Column:
    """SRC-18: struct(area, year, floors) of portal texts."""
    return F.struct(leading_number(area).alias("area"), year(group(built, r"(\d{4})")).alias("year"), group(floors, r"(\d+)").try_cast("int").alias("floors"))


def registry_streams(extracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-19: extracts(number, day, cad, rights[category, number, type, holder]) as objects, rights and encumbrances."""
    flat = extracts.select("number", "day", "cad", F.inline("rights"))
    flat = flat.toDF("extract_number", "extract_date", "cad", "category", "right_number", "type", "holder")
    return extracts.select("cad", "number", "day").distinct(), flat.where("category = 'right'"), flat.where("category <> 'right'")


def heritage_encumbrances(objects: DataFrame, key: str, attrs: str, field: str = "heritage") -> DataFrame:
    """SRC-20: an encumbrance for each object whose attributes speak of heritage."""
    value = F.try_element_at(F.col(attrs), F.lit(field))
    return objects.where(~is_masked(value)).select(key, F.lit("cultural_heritage").alias("type"), value.alias("text"))


def certificates(df: DataFrame, cad: str, number_: str, holder: str, day: str) -> DataFrame:
    """SRC-22: an object keyed by id, else by a hash of the certificate, with one right."""
    key = F.coalesce(cad_number(F.col(cad)), F.concat(F.lit("cert::"), stable_hash(F.col(number_), F.col(day))))
    return df.withColumns({"object_key": key, "right_number": F.col(number_), "right_date": date_any(F.col(day)), "holder_type": holder_type(F.col(holder), F.lit(None).cast("string"))})


FOUNDERS = "array<struct<name:string,inn:string,ogrn:string,share:string,active:boolean>>"


def founders(df: DataFrame, key: str, field: str) -> DataFrame:
    """SRC-23/28: a row for each founder of an entity that isn't known to be inactive."""
    return df.select(F.col(key).alias("entity"), F.inline_outer(F.from_json(F.col(field), FOUNDERS))).where("name is not null and coalesce(active, true)")


def contour_records(df: DataFrame, text: str) -> DataFrame:
    """SRC-15: (cad, ring, label) of session files in either layout: a list of records, or a map from id to ring."""
    listed = df.select(F.inline(F.from_json(text, "array<struct<cn:string,contour:array<array<double>>,label:string>>"))).toDF("cad", "ring", "label")
    mapped = df.where(F.get_json_object(text, "$[0]").isNull()).select(F.explode(F.from_json(text, "map<string,array<array<double>>>")).alias("cad", "ring")).withColumn("label", F.lit(None).cast("string"))
    return listed.unionByName(mapped).where("ring is not null")


def keyed_json(df: DataFrame, text: str, stem: str) -> DataFrame:
    """SRC-16: (cad, body) of an enrichment file: one object, {objects: [...]} or a list; the file's name is the key of last resort."""
    many = F.coalesce(F.from_json(F.get_json_object(text, "$.objects"), "array<string>"), F.from_json(text, "array<string>"), F.array(text))
    rows = df.select(F.col(stem), F.explode(many).alias("body"))
    return rows.select(F.coalesce(F.get_json_object("body", "$.cad"), F.get_json_object("body", "$.cad_number"), F.col(stem)).alias("cad"), "body")


def exif_point(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """SRC-13: degrees of arrays of degrees, minutes and seconds."""
    from tessera.functions.numbers import dms

    return F.struct(dms(lat[0], lat[1], lat[2], lat_ref).alias("lat"), dms(lon[0], lon[1], lon[2], lon_ref).alias("lon"))


def lease_rows(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """SRC-25: a lease table's rows with cleaned values and a term."""
    out = columns_by_keyword(df, wanted)
    out = out.withColumns({c: cleaned(F.col(c)) for c in out.columns})
    return out.withColumn("term", term(F.col("term"))) if "term" in out.columns else out


def second_catalog(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """SRC-17: a table of another database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def union_streams(*streams: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
