"""Writers (SNK-01..09): graphs, dumps, bundles, KML, Markdown, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """SNK-01: nodes and edges as JSON lines; a graph of any size is a folder of files."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def graph_document(nodes: DataFrame, edges: DataFrame, centre: str, sort: tuple[str, ...] = ("id",)) -> DataFrame:
    """SNK-01: one JSON text for each centre, for the graphs of single objects."""
    n = nodes.groupBy(centre).agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != centre]))).alias("nodes"))
    e = edges.groupBy(centre).agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != centre]))).alias("edges"))
    return n.join(e, centre, "left").select(centre, F.to_json(F.struct("nodes", "edges")).alias("document"))


def dump(df: DataFrame, json_columns: list[str]) -> DataFrame:
    """SNK-02: each row as JSON; columns that hold JSON text become objects, malformed ones NULL."""
    return df.select(F.to_json(F.struct(*(F.try_parse_json(F.col(c)).alias(c) if c in json_columns else F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """SNK-03: a folder of CSV for each sheet of a workbook."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def table_digest(df: DataFrame) -> DataFrame:
    """SNK-04: (rows, digest): a SHA-256 that doesn't depend on the order of rows; equal rows count each.

    Rows are hashed as JSON, hashes put in order and hashed by their first six signs, those by three, and those as a whole: no
    group has more than a 4096th of what is below it, and tables agree in it only if they do in all rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    level = df.select(row.alias("h"), F.lit(1).cast("long").alias("n"))
    for signs in (6, 3, 0):
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
        mark = F.substring("h", 1, signs).alias("k")
        # the first signs of a group stay those of its hash, so that the next level can group by them
        level = level.groupBy(mark).agg(F.concat(F.first(F.substring("h", 1, signs)), joined).alias("h"), F.sum("n").alias("n")) if signs else level.agg(joined.alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return level.select(F.col("n").alias("rows"), F.col("h").alias("digest"))


def write_bundle(tables: dict[str, DataFrame], folder: str) -> str:
    """SNK-04: Parquet tables and a manifest; the bundle's id is the hash of the manifest."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        r = table_digest(spark.read.parquet(f"{folder}/{name}")).first()
        entries.append((name, r["rows"], r["digest"]))
    manifest = spark.createDataFrame(entries, "table string, rows long, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    import hashlib
    import json

    return hashlib.sha256(json.dumps(entries).encode()).hexdigest()


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(archive, content): files of (archive, chunk, data), for those of which one fits a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "data"))), lambda c: c["data"])
    return chunks.groupBy("archive").agg(F.aggregate(ordered, F.lit(b""), lambda a, d: F.concat(a, d)).alias("content"))


def write_profiles(df: DataFrame, project: str, folder: str) -> None:
    """SNK-05: profiles as JSON, a folder for each project."""
    df.write.mode("overwrite").partitionBy(project).json(folder)


def placemark(name: Column, description: Column, ring: Column) -> Column:
    """SNK-06: a KML placemark; markup in texts is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"), F.lit("0"))), " ")
    return F.concat(F.lit("<Placemark><name>"), safe(name), F.lit("</name><description>"), safe(description), F.lit("</description><Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-07: rows as lines of a Markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value"))


def append_audit(df: DataFrame, path: str) -> None:
    """SNK-08: JSON lines appended."""
    df.write.mode("append").json(path)


def folder_report(files: DataFrame, path: str, flags: dict[str, Column]) -> DataFrame:
    """SNK-09, AGG-09: (folder, files, counts): every file counts in each folder above it."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    flat = files.where(F.size(parts) > 1).select(F.explode(above).alias("folder"), *(c.alias(n) for n, c in flags.items()))
    return flat.groupBy("folder").agg(F.count("*").alias("files"), *(F.count_if(F.col(n)).alias(n) for n in flags))
