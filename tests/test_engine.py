import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import merge, temporal, validate
from tessera.sources import readers, sinks
from tessera.streaming import streams


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"extract": 1, "objects": [{"cad": "1:2"}, {"x": 1}]}))
    (tmp_path / "b.json").write_text("not json")
    files = readers.json_files(spark, str(tmp_path))
    kinds = {r.stem: r.k for r in files.select("stem", readers.file_kind(F.col("text")).alias("k")).collect()}
    assert kinds == {"a": "egrn", "b": "unknown"}
    assert {r.cad for r in readers.keyed_json(files.where("stem = 'a'"), "text", "stem").collect()} == {"1:2", "a"}
    assert readers.optional_table(spark, "no_such_table", T.StructType([T.StructField("a", T.LongType())])).count() == 0
    assert readers.optional_table(spark, "", T.StructType([T.StructField("a", T.LongType())]), str(tmp_path / "none")).columns == ["a"]
    assert readers.files(spark, str(tmp_path), ".json").count() == 2


def test_xml_and_text(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<a><Placemark><name>n</name></Placemark><Placemark><name>m</name></Placemark></a>")
    assert {x.name for x in readers.xml_records(spark, str(tmp_path), "Placemark", "name string").collect()} == {"n", "m"}


def test_ledgers(spark):
    sheet = spark.createDataFrame([("f", 1, "01.01", None, None), ("f", 2, None, "дом", 5.0), ("f", 3, "01.К", None, None), ("f", 4, None, "кафе", 7.0)], "file string, n int, a string, name string, v double")
    rows = readers.ledger_rows(sheet, "n", "a", "name", ["01.01", "01.К"])
    got = readers.valuations(rows.withColumn("z", F.lit(None).cast("double")), "v", "z", "v", "account").select("name", "kind", "amount").collect()
    assert sorted(map(tuple, got)) == [("дом", "initial", 5.0), ("дом", "writeoff", 5.0), ("кафе", "initial", 7.0), ("кафе", "lease_annual", 7.0)]
    t = spark.createDataFrame([("f", 1, "01", "БУ", "x", 1.0), ("f", 2, None, "НУ", None, 2.0), ("f", 3, None, "ВР", None, 3.0), ("f", 4, None, "БУ", "y", 4.0)], "file string, n int, account string, label string, name string, v double")
    got = {r.name: (r.account, r.book.v, r.tax and r.tax.v) for r in readers.ledger_triples(t, "n", "label", ["v"]).collect()}
    assert got == {"x": ("01", 1.0, 2.0), "y": ("01", 4.0, None)}
    wide = spark.createDataFrame([("a", "b")], "`Кадастровый номер` string, `Площадь, кв.м` string")
    assert readers.columns_by_keyword(wide, {"cad": ["кадастров"], "area": ["площадь"], "none": ["нет"]}).first() == ("a", "b", None)


def test_bundle(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    a = sinks.write_bundle({"t": df}, str(tmp_path / "a"))
    assert a == sinks.write_bundle({"t": df.repartition(3)}, str(tmp_path / "b"))
    assert a != sinks.write_bundle({"t": df.where("id > 0")}, str(tmp_path / "c"))
    kml = df.limit(1).select(sinks.placemark(F.lit("a<b"), F.lit(None).cast("string"), F.array(F.array(F.lit(1.0), F.lit(2.0)))).alias("k")).first().k
    assert "<name>a&lt;b</name>" in kml and "1.0,2.0,0" in kml


def test_merge_and_replay(spark):
    v = spark.createDataFrame([(1, "a", "x", "egrn", 4, 1), (1, "a", "y", "nspd", 3, 2), (1, "a", "x", "kml", 2, 3), (1, "b", "-", "egrn", 4, 4), (1, "b", "z", "kml", 2, 5)], "k int, f string, v string, s string, r int, q int")
    got = {x.f: (x.v, x.s, [tuple(y) for y in x.variants]) for x in merge.priority_merge(v, "k", "f", "v", "s", "r", "q").collect()}
    assert got == {"a": ("x", "egrn", [("y", "nspd")]), "b": ("z", "kml", [])}
    base = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, None)], "k int, items array<struct<id:int,value:string>>")
    eff = spark.createDataFrame([(1, 1, "remove", 1, None), (1, 2, "add", 3, "c"), (1, 3, "change", 2, "B"), (2, 1, "add", 9, "z")], "k int, o int, op string, m int, v string")
    got = {r.k: [tuple(x) for x in r["items"]] for r in temporal.replay(base, eff, "k", "items", ["o"], "op", "m", "v").collect()}
    assert got == {1: [(2, "B"), (3, "c")], 2: [(9, "z")]}


def test_validation(spark):
    ddl = spark.createDataFrame([("CREATE TABLE IF NOT EXISTS T (a INT, b DECIMAL(5,2), PRIMARY KEY (a))",)], "t string")
    assert sorted(map(tuple, validate.ddl_columns(ddl, "t").collect())) == [("t", "a"), ("t", "b")]
    m = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "name string, sha256 string, size int")
    f = spark.createDataFrame([("a", bytearray(b"q"))], "name string, content binary")
    assert sorted(map(tuple, validate.file_violations(m, f, "name").collect())) == [("a", "sha256"), ("b", "missing")]
    facts = spark.createDataFrame([("lot_a", None, None), ("Lot", "2024-01-01", None)], "lot string, a string, b string")
    assert sorted(map(tuple, validate.violations(facts, "lot", validate.fact_rules(["a", "b"], "lot")).collect())) == [("Lot", "lot id"), ("lot_a", "no date")]


def run_stream(spark, folder, rows, name, build, mode="append"):
    source = spark.readStream.schema("user long, ts timestamp_ntz, id long, kind string").parquet(folder)
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_streams_equal_their_batch_twins(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    rows = [(u, start + pd.Timedelta(minutes=7 * i * (u + 1)), 100 * u + i, ["error", "ok", "error", "error"][i % 4]) for u in range(3) for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["user", "ts", "id", "kind"])
    batch = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder = str(tmp_path / "in")
    batch.coalesce(1).write.parquet(folder)
    failed = F.col("kind") == "error"
    want = sorted(map(tuple, streams.debounce(batch, "user", "ts", "id", 1800.0).collect()))
    assert run_stream(spark, folder, rows, "deb", lambda s: streams.debounce_stream(s, "user", "ts", "id", 1800.0)) == want and want
    want = sorted(map(tuple, streams.limiter(batch, "user", "ts", "id", failed, 2, 3600.0, 7200.0).collect()))
    assert run_stream(spark, folder, rows, "lim", lambda s: streams.limiter_stream(s, "user", "ts", "id", failed, 2, 3600.0, 7200.0)) == want and any(x[2] for x in want)
    from tessera.operators.relational import changes

    want = sorted((r.user, r.id, r.kind) for r in changes(batch, "user", "kind", ["ts", "id"]).collect())
    assert run_stream(spark, folder, rows, "chg", lambda s: streams.change_stream(s, "user", "ts", "id", "kind")) == want


def test_upsert_stream(spark, tmp_path):
    schema = "k int, v string"
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    run = lambda: streams.upsert_batches(spark.readStream.schema(schema).parquet(folder), table, ["k"], [F.desc("v")], checkpoint, buckets=4).awaitTermination()
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), *((i, "x") for i in range(10, 30))], schema).coalesce(1).write.parquet(folder)
    run()
    first = streams.versions(spark, table)
    assert len(first) == 4 and set(first.values()) == {0}
    spark.createDataFrame([(2, "d"), (2, "e")], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert sorted(map(tuple, streams.load_last(spark, table, schema).collect())) == [(1, "b"), (2, "e"), *((i, "x") for i in range(10, 30))]
    assert sorted(streams.versions(spark, table).values()) == [0, 0, 0, 1]  # only the bucket of key 2 was written anew
    assert streams.versions(spark, table, 0) == first and streams.load_last(spark, str(tmp_path / "none"), schema).collect() == []
