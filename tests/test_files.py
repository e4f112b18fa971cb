"""Photos, archives and workbooks from their bytes, also damaged ones."""

import hashlib
import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from tessera.sources import archives, photos, sheets, sinks


def test_exif_of_damaged_photos(spark):
    """Any byte may be wrong and any length cut: no crash, and what is whole is right."""
    r = random.Random(1)
    whole = [photos.exif_bytes(-61.5, 170.25, 12.5, "2020:02:03 04:05:06", '{"app":"gpp","loc":{"path":"а/б","source":"local"}}', o) for o in "<>"]
    for photo in whole:
        for i in range(len(photo)):
            photos.exif(photo[:i])
            photos.exif(photo[:i] + bytes([r.randrange(256)]) + photo[i + 1 :])
    plain = photos.exif_bytes(None, 0.5, None, "0000:00:00 00:00:00", "free text")
    looped = whole[0].replace((0x8769).to_bytes(2, "little"), (0x8768).to_bytes(2, "little"))
    rows = [("le", whole[0]), ("be", whole[1]), ("plain", plain), ("none", None), ("empty", b""), ("png", b"\x89PNG"), ("looped", looped), ("zero", whole[0].replace((10_000).to_bytes(4, "little"), bytes(4)))]
    got = {x.name: x for x in photos.photo_facts(spark.createDataFrame([(n, bytearray(p) if p is not None else None) for n, p in rows], "name string, content binary"), "content").collect()}
    for n in ("le", "be"):
        a = got[n]
        assert (round(a.gps_lat, 6), round(a.gps_lon, 6), a.bearing, str(a.taken), a.loc_path, a.loc_source) == (-61.5, 170.25, 12.5, "2020-02-03 04:05:06", "а/б", "local")
    assert (got["plain"].gps_lat, got["plain"].gps_lon, got["plain"].taken, got["plain"].comment) == (None, 0.5, None, None)
    assert (got["looped"].taken, got["looped"].comment, round(got["looped"].gps_lat, 6)) == (None, None, -61.5) and got["zero"].gps_lat is None
    assert all(got[n].gps_lat is None and got[n].comment is None for n in ("none", "empty", "png"))


def test_location_keeps_what_a_comment_says():
    assert json.loads(photos.with_location('{"note":"x","v":3}', "a/b", "local")) == {"app": "gpp", "note": "x", "v": 3, "loc": {"path": "a/b", "source": "local"}}
    assert json.loads(photos.with_location("not json", "a")) == {"app": "gpp", "v": 2, "loc": {"path": "a"}}


def test_archives(spark):
    rows = [("a", "x/б.txt", "é" * 5000), ("a", "y.txt", None), ("b", "z.txt", ""), ("a", "w.txt", "1")]
    df = spark.createDataFrame(rows, "name string, path string, text string").repartition(3)
    chunks = archives.zip_entries(df, "name", "path", "text")
    files = {x.archive: bytes(x.content) for x in sinks.joined_chunks(chunks).collect()}
    with zipfile.ZipFile(io.BytesIO(files["a"])) as z:
        assert z.testzip() is None and z.namelist() == ["w.txt", "x/б.txt", "y.txt", "manifest.json"] and z.read("x/б.txt").decode() == "é" * 5000
        assert json.loads(z.read("manifest.json"))["files"][0] == {"path": "w.txt", "sha256": hashlib.sha256(b"1").hexdigest(), "bytes": 1}
    again = {x.archive: bytes(x.content) for x in sinks.joined_chunks(archives.zip_entries(df.repartition(1), "name", "path", "text")).collect()}
    assert files == again
    changed = io.BytesIO()
    with zipfile.ZipFile(changed, "w") as z:
        z.writestr("w.txt", "2")
        z.writestr("manifest.json", json.dumps({"files": [{"path": "w.txt", "sha256": "0"}, {"path": "gone", "sha256": "0"}]}))
    damaged = bytearray(files["a"])
    damaged[36] ^= 0xFF
    whole = spark.createDataFrame([("a", 0, bytearray(files["a"])), ("c", 0, changed.getvalue()), ("d", 0, damaged), ("e", 0, bytearray(b"no")), ("f", 0, None)], "archive string, chunk int, data binary")
    got = {(x.archive, x.path): (x.problem or "").split(":")[0] for x in archives.read_entries(whole).collect()}
    assert got[("a", "w.txt")] == "" and got[("c", "w.txt")] == "not as the manifest says" and got[("c", "gone")] == "missing"
    assert all(got[(n, None)] == "not readable" for n in "def")
    assert archives.read_entries(archives.zip_entries(df.limit(0), "name", "path", "text")).collect() == []


def test_archives_of_tables_of_unlike_sizes(spark):
    """Adaptive execution joins the partitions of each grouped table by its own sizes; an archive still is one stream."""
    tables = {"few": spark.range(300).withColumnRenamed("id", "k"), "many": spark.range(9000).select((F.col("id") % 300).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))}
    entries = None
    for name, df in tables.items():
        rows = df.groupBy(F.col("k").cast("string").alias("archive")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))), "\n").alias("content")).withColumn("path", F.lit(f"{name}.jsonl"))
        entries = rows if entries is None else entries.unionByName(rows)
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        for given in (entries, archives.slices(tables, "k").withColumn("content", F.col("content").cast("string"))):
            got = archives.read_entries(archives.zip_entries(given, "archive", "path", "content")).collect()
            assert len(got) == 600 and all(x.problem is None for x in got)
    finally:
        for k in small:
            spark.conf.unset(k)


def test_digest_of_tables(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    digest = lambda df: tuple(sinks.table_digest(df).first())
    assert digest(a) == digest(a.repartition(5)) == digest(a.select("y", "x")) and digest(a)[0] == 3
    assert len({digest(df)[1] for df in (a, a.distinct(), a.limit(0), a.fillna("None"), spark.createDataFrame([(1, "a"), (2, None), (2, None)], a.schema))}) == 5
    assert len(digest(a)[1]) == 64


def test_workbooks(spark):
    """Shared, rich and inline strings, booleans, cells without a place, merged areas; a broken file is told."""
    main, rel = sheets.MAIN, sheets.RELATIONS
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Л &amp; 1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t> a </t></si><si><r><t>b</t></r><r><t>c</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AA2" t="inlineStr"><is><t>in</t></is></c></row><row><c t="b"><v>1</v></c><c><v>1.50</v></c><c r="D3"/></row></sheetData><mergeCells><mergeCell ref="B2:B4"/><mergeCell ref="F1:G1"/></mergeCells></worksheet>',
    }
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    files = spark.createDataFrame([("ok", bytearray(raw.getvalue())), ("bad", bytearray(b"PK")), ("empty", None)], "path string, content binary")
    read = lambda fill: sorted(tuple(x) for x in sheets.read_cells(files.where("path = 'ok'"), "path", "content", fill).collect())
    plain = [("ok", "Л & 1", 2, 2, " a "), ("ok", "Л & 1", 2, 3, "bc"), ("ok", "Л & 1", 2, 27, "in"), ("ok", "Л & 1", 3, 1, "TRUE"), ("ok", "Л & 1", 3, 2, "1.50")]
    assert read(False) == plain
    assert read(True) == sorted([*plain[:-1], ("ok", "Л & 1", 3, 2, " a "), ("ok", "Л & 1", 4, 2, " a ")])
    assert sheets.read_cells(files, "path", "content").where("sheet is null and value like 'not readable%'").count() == 2
    assert [sheets.place(sheets.letters(i) + "7") for i in (1, 26, 27, 702, 703)] == [(7, i) for i in (1, 26, 27, 702, 703)]


def test_a_workbook_written_and_read(spark):
    r = random.Random(2)
    rows = [("w", i, r.choice(["<a>&\"'", " x ", "", None, "1"]), r.choice([None, 1.5, -2.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "book string, n int, text string, amount double")
    files = sinks.joined_chunks(sheets.write_workbooks(sheets.grid_of(df, "book", "a/b & c", [F.desc("n")], ["n", "text", "amount"])))
    got = sheets.table_rows(sheets.read_cells(files, "archive", "content"), "a/b & c", {"n": 1, "text": 2, "amount": 3}, 2, "n").collect()
    assert [(int(x.n), x.text, None if x.amount is None else float(x.amount)) for x in sorted(got, key=lambda x: x.row)] == [(n, t or None, a) for _, n, t, a in reversed(rows)]


def test_a_workbook_is_a_stream(spark, monkeypatch):
    """It leaves in chunks, its shared texts are bounded, and it is read row by row; rows out of order are put in order."""
    import pyarrow as pa

    monkeypatch.setattr(sheets, "_SHARED", 5)
    monkeypatch.setattr(archives, "CHUNK", 1000)
    r = random.Random(5)
    grid = [(a, s, i, j, r.choice(["<a>", " x "]) if r.random() < 0.3 else str(r.random()), j == 3) for a in "ab" for s in ("S&1", "S2") for i in range(1, 400) for j in (1, 3, 30)]
    columns = [pa.array(c) for c in zip(*grid, strict=True)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.nulls(len(grid), pa.string())], names=["archive", "sheet", "row", "col", "value", "numeric", "until"])
    chunks = [x for b in sheets._workbooks(iter([batch.slice(0, 1000), batch.slice(1000)])) for x in b.to_pylist()]
    for a in "ab":
        mine = [x["data"] for x in chunks if x["archive"] == a]
        assert len(mine) > 1 and max(map(len, mine)) < 100_000
        with zipfile.ZipFile(io.BytesIO(b"".join(mine))) as z:
            assert z.testzip() is None and z.read("xl/sharedStrings.xml").count(b"<si>") == 5
            assert list(sheets.cells(z)) == [x[1:5] for x in grid if x[0] == a]
            turned = io.BytesIO()
            with zipfile.ZipFile(turned, "w") as t:
                for n in z.namelist():
                    body = z.read(n).decode()
                    rows = body.split("<row ")
                    t.writestr(n, "<row ".join([rows[0], *reversed(["".join(rows[-1].partition("</row>")[:2]), *rows[1:-1]])]) + rows[-1].partition("</row>")[2] if "worksheets" in n else body)
    got = sheets.read_cells(spark.createDataFrame([("b", bytearray(turned.getvalue()))], "path string, content binary"), "path", "content").collect()
    assert [tuple(x) for x in got] == [x[:5] for x in grid if x[0] == "b"]


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence>
 <xs:element name="a" type="Code" minOccurs="0" maxOccurs="2"/><xs:choice maxOccurs="unbounded"><xs:element name="b" type="xs:integer"/><xs:element name="c"><xs:complexType><xs:simpleContent><xs:extension base="Code"><xs:attribute name="id" use="required"/></xs:extension></xs:simpleContent></xs:complexType></xs:element></xs:choice>
 <xs:element name="d" minOccurs="0"><xs:complexType><xs:all><xs:element name="x" type="xs:date"/><xs:element name="y" type="xs:string" minOccurs="0"/></xs:all></xs:complexType></xs:element>
 </xs:sequence><xs:attribute name="v"/></xs:complexType></xs:element>
 <xs:simpleType name="Code"><xs:restriction base="Short"><xs:enumeration value="k1"/><xs:enumeration value="k22"/></xs:restriction></xs:simpleType>
 <xs:simpleType name="Short"><xs:restriction base="xs:string"><xs:maxLength value="2"/></xs:restriction></xs:simpleType></xs:schema>"""


def test_elements_of_many_documents_leave_together():
    """Batches don't follow the documents, and each element keeps its document's columns."""
    import pyarrow as pa

    from tessera.operators import schema

    texts = ["<r/>", "<r>", "<r>" + "<b>1</b>" * 25_000 + "</r>", None, *['<r x="1"><b/></r>'] * 9_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    out = list(schema._nodes("t")(iter([batch])))
    rows = [x for b in out for x in b.to_pylist()]
    assert len(out) == 3 and [x["k"] for x in rows] == [0, 1, *[2] * 25_001, 3, *[k for k in range(4, 9_004) for _ in range(2)]]
    assert [x["path"] for x in rows[:4]] == ["/r", None, "/r", "/r/b"] and rows[-2]["attributes"] == [("x", "1")] and rows[-1]["place"] == 1
    assert {path: usual for path, *_, usual in schema.Schema(XSD).rules} == {"/r": "b c ", "/r/a": "", "/r/b": "", "/r/c": "", "/r/d": "x ", "/r/d/x": "", "/r/d/y": ""}


def test_documents_against_a_schema(spark):
    from tessera.operators import schema

    good = ["<r><b>1</b></r>", '<r v="1"><a>k1</a><a>k1</a><c id="1">k1</c><b> -2 </b><d><y/><x>2020-02-03</x></d></r>', '<n:r xmlns:n="u"><n:b>7</n:b><!-- x --></n:r>', "<r><b>1</b><d><x>2020-02-03</x></d></r>"]
    bad = {
        "<r/>": [("/r", "children")], "<r><a>k1</a></r>": [("/r", "children")], "<r><a>k1</a><a>k1</a><a>k1</a><b>1</b></r>": [("/r", "children")], "<r><b>1</b><e/></r>": [("/r", "children")], "<r><b>x</b></r>": [("/r/b", "text")],
        "<r><a>k22</a><b>1</b></r>": [("/r/a", "length")], "<r><a>k3</a><b>1</b></r>": [("/r/a", "listed")], "<r><c>k1</c></r>": [("/r/c", "attribute missing: id")], '<r w="1"><b>1</b></r>': [("/r", "attribute: w")],
        "<r><b>1</b><d><y/></d></r>": [("/r/d", "children")], "<r><b>1</b><d><x>2020-02-03</x><x>2020-02-03</x></d></r>": [("/r/d", "children")], "<r><b>1</b><d><x>2020-02-30</x></d></r>": [], "<r><b>1</b><d><x>2020-13-03</x></d></r>": [("/r/d/x", "text")],
        "<q/>": [("/q", "root")], "<r>": [(None, "not well-formed")], "": [(None, "not well-formed")], "<r><b>1</b><b><b/></b></r>": [("/r/b", "children")],
    }
    texts = [*good, *bad, None]
    got = {}
    for x in schema.breaches(spark.createDataFrame(list(enumerate(texts)), "id int, xml string"), "xml", XSD).collect():
        got.setdefault(x.id, []).append((x.path, x.rule))
    want = {i: bad.get(t, []) for i, t in enumerate(texts)} | {len(texts) - 1: [(None, "not well-formed")]}
    assert {i: sorted(map(str, w)) for i, w in got.items()} == {i: sorted(map(str, w)) for i, w in want.items() if w}


def test_a_type_that_holds_itself(spark):
    import pytest

    from tessera.operators import schema

    with pytest.raises(ValueError, match="holds itself"):
        schema.Schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="T"/><xs:complexType name="T"><xs:sequence><xs:element name="r" type="T" minOccurs="0"/></xs:sequence></xs:complexType></xs:schema>')


def test_entity_documents(spark):
    """Missing parts, other layouts of a field, documents that aren't JSON or have no entity."""
    from tessera.sources import entities

    full = {
        "entity": {"ogrn": "", "inn": "", "name_full": "", "name_short": "  ООО Б ", "okved_main": {"code": "1", "name": "x"}, "okved_additional": [{"code": "2", "name": "y"}], "contacts": {"phones": ["1"]}, "directors": [{"fio": "И", "position": None}]},
        "raw_data": {"Учред": {"ИнОрг": [{"НаимПолн": "A", "Страна": {"Наим": "Кипр"}}, {"Наим": "B", "Страна": "Мальта"}], "РФ": [{"Доля": {"Процент": 5}, "ОргОсущПрав": []}], "ФЛ": [{}, {}]}, "ДержРеестрАО": {"ИНН": "7", "НаимСокр": "Реестр"}, "Подразд": {"Филиал": [{"Наим": "Ф", "Адрес": ""}]}},
    }
    texts = [json.dumps(full, ensure_ascii=False), '{"entity": {}}', "{}", "not json", None, '{"entity": {"inn": "77"}, "raw_data": null}']
    got = {x.id: x for x in entities.legal_entities(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").collect()}
    a = got[0]
    assert a.key.startswith("legal::name::") and (a.activity, a.activities, a.phones, a.registrar.name, a.licences) == ("1 — x", ["2 — y"], ["1"], "Реестр", [])
    assert [(x.kind, x.name, x.country, x.persons) for x in a.founders] == [("foreign", "A", "Кипр", None), ("foreign", "B", "Мальта", None), ("person", None, None, 2)]
    assert [x.label for x in a.addresses] == ["Юридический адрес"] and a.pledges == []
    assert got[5].key == "legal::inn::77" and got[5].founders == [] and not {2, 3, 4} & set(got)
    person = entities.persons(spark.createDataFrame([('{"entity":{"name_full":"Я"},"raw_data":{"Учред":[{"Статус":"НЕ ДЕЙСТВУЕТ с 2020"},{"НаимСокр":"К","НаимПолн":"Компания"}]}}',)], "text string"), "text").first()
    assert person.key.startswith("person::") and len(person.founded) == 2 and [x.name for x in person.links] == ["К"]
    registry = {"tables": {"extracts": [{"extract_number": "1", "organ": "a"}, {"extract_number": "1", "organ": "b"}], "building_objects": [{"cad_number": "1:2", "area": 5.5, "name": ""}], "land_objects": [{"cad_number": "1:2", "object_type": "land"}, {"cad_number": None}], "rights": [{"right_category": None, "right_number": "Р 1", "right_type_code": "X"}, {"right_category": "RIGHT", "right_number": "р1", "right_type_code": "x", "source_extract_number": "1"}]}}
    objects, rights = entities.registry_documents(spark.createDataFrame([(1, json.dumps(registry)), (2, "{"), (3, '{"tables": {}}')], "id int, text string"), "text")
    assert [(x.id, x.cad, x.kind, x.attrs) for x in objects.collect()] == [(1, "1:2", "Земельный участок", {"cad_number": "1:2", "object_type": "Земельный участок"})]
    r = sorted(rights.collect(), key=lambda x: x.is_right)
    assert [(x.is_right, x.extract_number, x.organ) for x in r] == [(False, None, None), (True, "1", "b")] and r[0].dedup_key == r[1].dedup_key


def test_tables_of_documents(spark):
    """Cells over several columns and rows, text of several runs, tables in cells, broken files."""
    from tessera.sources import documents

    cell = lambda text, facts="": f"<w:tc>{'<w:tcPr>' + facts + '</w:tcPr>' if facts else ''}<w:p><w:r><w:t>{text}</w:t></w:r><w:r><w:tab/><w:t>+</w:t></w:r></w:p></w:tc>"
    down, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [cell("Номер", '<w:gridSpan w:val="2"/>') + cell("Арендатор"), cell("a", down) + cell("b") + cell("c"), cell("", on) + cell("d") + "<w:tc><w:p/></w:tc>"]
    body = f'<w:document xmlns:w="{documents.WORD}"><w:body><w:p/><w:tbl>{"".join(f"<w:tr>{r}</w:tr>" for r in rows)}</w:tbl></w:body></w:document>'
    raw, other = io.BytesIO(), io.BytesIO()
    for b, parts in ((raw, {"word/document.xml": body}), (other, {"x": "1"})):
        with zipfile.ZipFile(b, "w") as z:
            for n, c in parts.items():
                z.writestr(n, c)
    files = spark.createDataFrame([("ok", bytearray(raw.getvalue())), ("bad", bytearray(b"PK")), ("other", bytearray(other.getvalue())), ("null", None)], "path string, content binary")
    grid = documents.read_tables(files, "path", "content")
    assert sorted(tuple(x)[2:] for x in grid.where("archive = 'ok'").collect()) == [(1, 1, "Номер\t+"), (1, 2, "Номер\t+"), (1, 3, "Арендатор\t+"), (2, 1, "a\t+"), (2, 2, "b\t+"), (2, 3, "c\t+"), (3, 1, "a\t+"), (3, 2, "d\t+")]
    assert grid.where("table is null and value like 'not readable%'").count() == 3
    got = documents.rows_by_keyword(grid, {"who": ["арендатор"], "what": ["кадастр", "номер"], "none": ["нет"]}).orderBy("row").collect()
    assert [(x.row, x.who, x.what, x.none) for x in got] == [(2, "c\t+", "a\t+", None), (3, None, "a\t+", None)]


def test_ledger_layout(spark):
    """Markers, totals, records that count and others, fragments of ids, a title without a period."""
    from tessera.sources import ledgers

    lines = {
        1: ["ООО Дон"], 2: ["за 9 месяцев 2025 г"], 6: ["заголовок", "БУ"], 7: ["01", "БУ", 1], 8: ["Дом :1234 (123456)", "БУ", "1 000,5", None, None, 0, 7], 9: ["", "НУ", 3], 10: ["Дом", "ВР", 9], 11: ["2020-01-01 00:00:00", "БУ", 5],
        12: ["Списан инв. 77", "БУ", 0, None, None, 20, 0.5], 13: ["01.К", "НУ", 1], 14: ["01.К", "", 1], 15: ["Свой", "БУ", 8], 16: ["Аренда 61:44:0050706:31", "НУ", 0, None, None, 273, 0], 17: ["ИТОГО", "БУ", 1], 18: ["После", "НУ", 1],
    }
    cells = [("f", "s", r, c, str(v)) for r, row in lines.items() for c, v in enumerate(row, 1) if v is not None and v != ""] + [("g", "s", 7, 1, "X"), ("g", "s", 7, 2, "БУ"), ("g", "s", 7, 6, "2")]
    assets = ledgers.ledger_assets(spark.createDataFrame(cells, "archive string, sheet string, row int, col int, value string"))
    got = [(x.row, x.account, x.item_name, x.inventory_number, x.cad, x.cad_fragment, x.is_disposed) for x in assets.where("archive = 'f'").orderBy("row").collect()]
    assert got == [(8, "01.01", "Дом :1234 (123456)", "123456", None, ":1234", False), (12, "01.01", "Списан инв. 77", "77", None, None, True), (16, "01.К", "Аренда 61:44:0050706:31", None, "61:44:0050706:31", None, False)]
    values = [(x.archive, x.row, x.kind, x.amount, str(x.day)) for x in ledgers.ledger_values(assets).orderBy("archive", "row", "kind").collect()]
    assert values == [("f", 8, "initial", 1000.5, "2025-01-01"), ("f", 8, "residual", 7.0, "2025-09-30"), ("f", 12, "residual", 0.5, "2025-09-30"), ("f", 12, "writeoff", 20.0, "2025-09-30"), ("f", 16, "lease_annual", 365.0, "2025-09-30"), ("g", 7, "writeoff", 2.0, "None")]
