"""Extracts in XML, store versions, folds, chains and ranks against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.functions import address, text
from tessera.operators import graph as G
from tessera.operators import matching, merge
from tessera.operators import relational as R
from tessera.sources import extracts, pages, tax_extracts
from tessera.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_extract_with_prefixes_entities_and_gaps(spark):
    xml = """<?xml version="1.0"?><!-- x --><ns:extract_about_property_build xmlns:ns="urn:x">
      <ns:group_top_requisites><ns:organ_registr_rights>  Филиал &amp; Ко </ns:organ_registr_rights></ns:group_top_requisites>
      <ns:cad_number>61:44:0050706:31</ns:cad_number><ns:params><ns:area>10,5</ns:area><ns:name/><ns:floors>3</ns:floors></ns:params>
      <ns:old_number><ns:number_type><ns:value>Условный номер</ns:value></ns:number_type><ns:number>61-1</ns:number></ns:old_number>
      <ns:old_numbers><ns:old_number><ns:number_type><ns:value>Инвентарный номер</ns:value></ns:number_type><ns:number>143/2</ns:number></ns:old_number><ns:old_number><ns:number>отсутствуют</ns:number></ns:old_number></ns:old_numbers>
      <ns:right_record><ns:right_type>Собственность</ns:right_type><ns:right_number>n1</ns:right_number><ns:right_holder><ns:organization><ns:name>А</ns:name></ns:organization></ns:right_holder><ns:right_holder/></ns:right_record>
      <ns:restrict_record><ns:restrictions_encumbrances_data><ns:restriction_encumbrance_type><ns:value>Нечто</ns:value></ns:restriction_encumbrance_type></ns:restrictions_encumbrances_data></ns:restrict_record>
    </ns:extract_about_property_build>"""
    r = extracts.read_extracts(spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string"), "x").orderBy(F.desc("cad_number")).collect()
    a = r[0]
    assert (a.object_type, a.organ, a.area, a.name, a.floors_above_ground, a.quarter_cad_number, a.old_numbers) == ("building", "Филиал & Ко", 10.5, None, 3, "61:44:0050706", "Инвентарный номер 143/2")
    assert [(x.right_type_code, x.right_number, [h.name for h in x.holders]) for x in a.rights] == [("ownership", "n1", ["А"])]
    assert sorted((x.object_type, x.cad_number, x.problem.split(":")[0]) for x in r[1:]) == [(None, None, "no text"), (None, None, "not well-formed")]


def test_extract_by_a_parser(spark):
    """References, CDATA, comments, names in any case, elements nested in those of their own name, first by depth or by child."""
    root = "extract_about_property_land"
    xml = f"""<{root}><!-- <cad_number>0:0:0:0</cad_number> --><Group_Top_Requisites><organ_registr_rights>&#171;А&#xBB; &lt;Б&gt;</organ_registr_rights></Group_Top_Requisites>
      <land_record><record_info><registration_date>2015-03-04</registration_date></record_info><CAD_NUMBER><![CDATA[61:44:0050706:31]]></CAD_NUMBER>
        <area><area><value>1</value></area><value>12,5</value></area><cost><!-- 5 --><value> 7 </value></cost></land_record>
      <prev_cad_number><x><cad_number>61:44:0050706:1</cad_number></x></prev_cad_number><prev_cad_number/><prev_cad_number><cad_number>61:44:0050706:2</cad_number></prev_cad_number>
      <permitted_use_established><by_document>Сад</by_document></permitted_use_established><permitted_use_established><by_document>Сад</by_document></permitted_use_established>
      <right_record><number>7</number><right_type><value>Аренда (особая)</value></right_type><registration_date>01.02.2016</registration_date><duration><a>с 01.02.2016</a><b>по 01.02.2017</b></duration><share><numerator>1</numerator><denominator>x</denominator></share></right_record>
      <right_record><right_type/><record_info><registration_date>02.02.2016</registration_date></record_info><right_holders><right_holder><person><inn>123456789012</inn><name>N</name></person></right_holder><right_holder><subject_rf/></right_holder></right_holders></right_record>
      <restrict_record><restrictions_encumbrances_data><restriction_encumbrance_number>r1</restriction_encumbrance_number><restriction_encumbrance_type>Арест</restriction_encumbrance_type><period><start_date/><starting_date>2020-01-01</starting_date></period></restrictions_encumbrances_data>
        <right_holders><right_holder><undefined>x</undefined></right_holder></right_holders><underlying_document><document_name>Акт</document_name><document_number>-</document_number><document_issuer>Суд</document_issuer></underlying_document></restrict_record>
      <restriction_encumbrance><number><number>z1</number></number><reg_number_border>b</reg_number_border><content_restrict_encumbrances>Памятник</content_restrict_encumbrances></restriction_encumbrance>
      <restriction_encumbrance><number>z2</number><reg_number_border>b2</reg_number_border></restriction_encumbrance><restriction_encumbrance><reg_number_border>b2</reg_number_border></restriction_encumbrance>
    </{root}>"""
    bad = [f"<{root}><cad_number>1:2:3:4</cad_number>", f"<{root}><a></b></{root}>", f"<{root}>&nosuch;</{root}>", f"<x:{root}/>", "<html><cad_number>1:2:3:4</cad_number></html>", f"<{root}/>"]
    windows = f'<?xml version="1.0" encoding="windows-1251"?><{root}><cad_number>1:2:3:4</cad_number><readable_address>ул. Мира</readable_address></{root}>'.encode("cp1251")
    text = [(0, xml), *((i, b) for i, b in enumerate(bad, 1))]
    r = extracts.read_extracts(spark.createDataFrame(text, "id long, x string"), "x").orderBy("id").collect()
    a = r[0]
    assert (a.problem, a.object_type, a.organ, a.cad_number, a.registration_date, a.area, a.cadastral_value) == (None, "land", "«А» <Б>", "61:44:0050706:31", "2015-03-04", 12.5, 7.0)
    assert (a.predecessor_cad_numbers, a.permitted_uses, a.name) == ("61:44:0050706:1; 61:44:0050706:2", "Сад; Сад", "Земельный участок 61:44:0050706:31, 12.5 кв.м")
    got = [(x.right_category, x.right_type_code, x.right_number, x.right_date, x.share_numerator, x.valid_from, x.valid_until, x.basis, [(h.holder_type, h.name, h.inn) for h in x.holders]) for x in a.rights]
    assert got[0] == ("restriction", "other", "7", "2016-02-01", 1, "2016-02-01", "2017-02-01", None, [])
    assert got[1] == ("encumbrance", "other", None, "2016-02-02", None, None, None, None, [("individual", None, "123456789012"), ("public", "Российская Федерация", None)])
    assert got[2] == ("restriction", "arrest", "r1", None, None, "2020-01-01", None, "Акт, Суд", [])
    assert [(x.type, x.registry_number) for x in a.object_restrictions] == [("okn_territory", "z1"), ("czuit_zone", "b2")]
    assert [x.problem.split(":")[0] for x in r[1:]] == ["not well-formed"] * 4 + ["not an extract", "no cadastral number"] and all(x.cad_number is None and x.rights is None for x in r[1:])
    b = extracts.read_extracts(spark.createDataFrame([(bytearray(windows),)], "x binary"), "x", ("cad_number", "address")).first()
    assert tuple(b) == (None, "1:2:3:4", "ул. Мира")


def test_address_of_many_parts(spark):
    c = one(spark, address.components(F.lit("г. Казань, ул. Мира, корп. 2, стр. 3, секц. 4")))
    assert (c.locality, c.street, c.building, c.house, c.room) == ("г. Казань", "ул. Мира", "корп. 2", "стр. 3", "секц. 4")
    c = one(spark, address.components(F.lit("Ростовская обл., д. 5, д. Иваново, ЦАО")))
    assert (c.region, c.house, c.locality, c.municipality) == ("Ростовская обл.", "д. 5", "д. Иваново", "ЦАО")


def test_order_of_organisation_forms(spark):
    name = F.lit("Закрытое акционерное общество «Дон»")
    assert one(spark, text.short_form(name)) == "Закрытое АО «Дон»"  # the shorter form stands before it in the list
    assert one(spark, text.short_form_exact(F.lit("ГОСУДАРСТВЕННОЕ УНИТАРНОЕ ПРЕДПРИЯТИЕ Х"))) == "ГУП Х"
    assert one(spark, text.legal_form(F.lit("АНО Школа"))) == "Автономная некоммерческая организация"


def test_folds_against_plain_python(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, None]), r.randrange(5000), i, r.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, s long, i long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    kept, blocked, state = [], [], {}
    for k, t, i, bad in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        at, n, first, until = state.get(k, (None, 0, None, 0))
        if at is None or t - at >= 100:
            at = t
            kept.append((k, i))
        if not bad:
            n, first, until = 0, None, 0
        else:
            if first is None or t - first > 60:
                n, first, until = 0, t, 0
            n += 1
            until = t + 200 if n >= 3 else until
            blocked.append((k, i, until > t))
        state[k] = at, n, first, until
    assert sorted(map(str, map(tuple, streams.debounce(df, "k", "ts", "i", 100.0).collect()))) == sorted(map(str, kept))
    assert sorted(map(str, map(tuple, streams.limiter(df, "k", "ts", "i", F.col("bad"), 3, 60.0, 200.0).collect()))) == sorted(map(str, blocked))


def test_chain_of_a_hundred_and_a_cycle(spark):
    rows = [(i, i - 1 if i else None, i == 0) for i in range(101)] + [(200, 201, False), (201, 202, False), (202, 200, False), (300, 999, False), (301, 300, None), (400, 400, False)]
    df = spark.createDataFrame(rows, "n long, up long, hit boolean")
    got = {x.start: (x.found, x.depth, x.path) for x in G.chains(df, df, "n", "up", "hit").collect()}
    assert got == {i: (0, i, list(range(i, -1, -1))) for i in range(101)}
    two = spark.createDataFrame([(1, 2, False), (1, 3, False), (2, 4, False), (3, 4, False), (4, None, True), (3, None, False)], "n long, up long, hit boolean")
    assert sorted(x.path for x in G.chains(two, two.where("n = 1"), "n", "up", "hit").collect()) == [[1, 2, 4], [1, 3, 4]]


def test_tokens_against_all_pairs(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), " ".join(["the", *(r.choice("pqrstuv") for _ in range(r.randrange(1, 6)))])) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, b string, n string")
    got = {(x.l_id, x.r_id): round(x.score, 9) for x in matching.by_tokens(df, df, "b", "i", "i", "n", "n").collect()}
    sets = {i: (b, set(n.split())) for i, b, n in rows}
    want = {(i, j): round(len(x & y) / max(len(x), len(y)), 9) for i, (a, x) in sets.items() for j, (b, y) in sets.items() if a == b and len(x & y) / max(len(x), len(y)) >= 0.6}
    assert got == want


def test_equal_names_stand_as_one(spark):
    """Equal names meet others once, and are expanded in squares of bounded size."""
    df = spark.range(5000).select(F.col("id").alias("i"), F.lit("b").alias("b"), F.when(F.col("id") < 10, "New rod").otherwise("rod  new").alias("n"))
    groups = [x.l_ids for x in matching._members(df.select("b", F.col("i").alias("_id"), F.lit("x").alias("_s")), "b", "l").collect()]
    assert sorted(i for g in groups for i in g) == list(range(5000)) and max(map(len, groups)) < 1300
    got = matching.by_tokens(df, df, "b", "i", "i", "n", "n").where("l_id < 20").agg(F.count("*"), F.count_distinct("l_id", "r_id"), F.min("score"), F.max("score")).first()
    assert tuple(got) == (100_000, 100_000, 1.0, 1.0)


def test_ranks_of_all_rows(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(50)) for i in range(1000)]
    got = {x.i: x.place for x in R.ranked(spark.createDataFrame(rows, "i long, v long").repartition(7), [F.desc("v"), F.col("i")], "place").collect()}
    assert got == {i: p + 1 for p, (i, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert R.ranked(spark.createDataFrame([], "i long, v long"), [F.col("v")], "place").collect() == []


def test_versions_hold_what_changed(spark, tmp_path):
    """Only new and changed rows are written; a version that breaks off leaves the one before; a retry overwrites it."""
    folder = str(tmp_path / "store")
    empty = {"extracts": spark.createDataFrame([], "extract_number string, cad long, extract_date string"), "objects": spark.createDataFrame([], "cad long, area double, content_hash string"), "rights": spark.createDataFrame([], "right_id string, cad long, right_number string"), "holders": spark.createDataFrame([], "right_id string, holder_type string, name string, inn string")}

    def documents(*cads):
        rows = [(c, f"{c}-{v}") for c, v in cads]
        frame = lambda rs, schema: spark.createDataFrame(rs, schema)
        return {
            "extracts": frame([(n, c, "2020") for c, n in rows], empty["extracts"].schema), "objects": frame([(c, float(c), n) for c, n in rows], empty["objects"].schema),
            "rights": frame([(f"{c}/1", c, f"r{c}") for c, _ in rows] + [(f"{n}/2", c, None) for c, n in rows], "ref string, cad long, right_number string"),
            "holders": frame([(f"{c}/1", "legal_entity", "Общество с ограниченной ответственностью А", None) for c, _ in rows] * 2, "ref string, holder_type string, name string, inn string"),
        }

    read = lambda: merge.last_committed(spark, folder, {"objects": "cad"})
    state = lambda store: {n: sorted(map(str, map(tuple, df.collect()))) for n, df in store.items()}
    merge.commit(merge.parsed_changes(empty, documents((1, 1), (2, 1)), "cad"), folder, 1)
    want = merge.merge_parsed(read(), documents((2, 2), (3, 1), (1, 1)), "cad")
    want, before = state(want), state(read())
    changes = merge.parsed_changes(read(), documents((2, 2), (3, 1), (1, 1)), "cad")
    changes["objects"].limit(1).withColumn("_version", F.lit(2)).write.parquet(f"{folder}/v2/objects")  # broken off
    assert state(read()) == before
    merge.commit(changes, folder, 2)
    assert state(read()) == want and len(want["objects"]) == 3 and len(want["holders"]) == 3
    written = {n: spark.read.parquet(f"{folder}/v2/{n}").count() for n in empty}
    assert written == {"extracts": 2, "objects": 2, "rights": 4, "holders": 1}
    assert [x for x in want["holders"] if "'ООО А'" not in x] == []



def test_upsert_policies(spark):
    schema = "k long, a string, b string, h string"
    old = spark.createDataFrame([(1, "x", None, "h1"), (2, "y", "q", None), (3, "z", None, "h3")], schema)
    new = spark.createDataFrame([(1, "X", "B", "h2"), (2, "Y", "Q", None), (4, "w", None, "h4")], schema)
    rows = lambda df: {r.k: (r.a, r.b, r.action) for r in df.collect()}
    assert rows(merge.upsert(old, new, "k", "h")) == {1: ("X", "B", "replaced"), 2: ("y", "q", "skipped"), 3: ("z", None, "kept"), 4: ("w", None, "inserted")}
    assert rows(merge.upsert(old, new, "k", "h", "enrich", ["b"]))[1] == ("x", "B", "enriched")
    agreed = spark.createDataFrame([(1, "a")], "k long, field string")
    assert rows(merge.upsert(old, new, "k", "h", "ask_enrich", accepted=agreed))[1] == ("X", None, "enriched")
    events = {r.k: (r.event, list(r.fields)) for r in merge.upsert_events(old, new, "k", "h", [], ["a", "b"]).collect()}
    assert events == {4: ("created", []), 1: ("modified", ["a", "b"])}


def test_printed_extract(spark):
    """Sections by page, labels with values below them, blocks of any length, across pages, with consent blocks taken out."""
    first = "\n".join(["Выписка об основных характеристиках", "12.01.2021 г. № КУВИ-002/2021-5", "Раздел 1", "Лист № 1 раздела 1", "Всего листов выписки: 4", "полное наименование органа", "Здание", "вид объекта недвижимости", "Кадастровый номер: 61:44:0050706:31",
        "Местоположение: данные отсутствуют", "Адрес:", "  г. Ростов  ", "Площадь, м2: 1 250,7", "Назначение: Нежилое", "Наименование: Склад", "Наименование: Другое", "Количество этажей, в том числе подземных этажей: 2023", "Год завершения строительства: 1987"])
    second = "\n".join(["Лист № 1 раздела 2", "Сведения о зарегистрированных правах", "1.1 Правообладатель: Иванов", "Сведения о возможности предоставления третьим лицам персональных данных: согласие", "вид: Ипотека", "2 Вид, номер, дата", "2.1 Общая долевая собственность, 3/7", "61-61/001/2020-1", "01.02.2020 10:20:30",
        "2.2 Аренда", "дата 05.06.2020", "61-61/001/2020-2", "4 вид: Публичный сервитут", "номер государственной регистрации: 61-9", "срок, на который установлено ограничение: с 01.02.2020 по 29.02.2020", "лицо, в пользу которого установлено", "ограничение прав и обременение объекта недвижимости: Общество с ограниченной ответственностью «Дон»,"])
    third = "\n".join(["ИНН: 7700000001", "основание государственной регистрации: Договор", "№ 5 от вчера", "2.3 Собственность", "61-61/001/2020-3", "вид: Арест", "дата государственной регистрации: 03.04.2020", "вид: Запрещение", "номер государственной регистрации: 61-9", "Правопритязания", "вид: после конца"])
    plan = "Лист № 1 раздела 3\nвид: план\nСобственность\n61-0"
    whole = "Кадастровый номер: 61:44:0050706:7\nСведения о зарегистрированных правах\nСобственность\n61-7\nОсобые отметки: данные отсутствуют"
    rows = [("a", 1, first), ("a", 2, second), ("a", 3, third), ("a", 4, plan), ("b", 1, whole), ("c", 1, "письмо"), ("d", 1, None), ("e", 1, "")]
    lines = pages.printed_lines(spark.createDataFrame(rows, "d string, p int, t string").repartition(3), "d", "p", "t")
    objects = {x.document: x for x in pages.printed_objects(lines).collect()}
    a = objects["a"]
    assert set(objects) == {"a", "b"} and (a.template, a.extract_number, a.extract_date, a.total_sheets, a.object_type, a.cad_number) == ("brief", "КУВИ-002/2021-5", "2021-01-12", 4, "building", "61:44:0050706:31")
    assert (a.address, a.area, a.purpose, a.name, a.floors_total, a.year_built) == ("г. Ростов", 1250.7, "Нежилое", "Склад", None, 1987)
    got = [(x.document, x.right_category, x.right_type_code, x.right_number, x.right_date, x.share_denominator, x.valid_until, x.beneficiary_name, x.beneficiary_inn, x.basis) for x in pages.printed_rights(lines).orderBy("document", "at").collect()]
    assert got == [
        ("a", "right", "shared", "61-61/001/2020-1", "2020-02-01 10:20:30", 7, None, None, None, None),
        ("a", "right", "lease", "61-61/001/2020-2", None, None, None, None, None, None),
        ("a", "encumbrance", "pub_easement", "61-9", None, None, "2020-02-29", "ООО «Дон»", "7700000001", "Договор № 5 от вчера"),
        ("a", "right", "ownership", "61-61/001/2020-3", None, None, None, None, None, None),
        ("a", "restriction", "arrest", None, "2020-04-03", None, None, None, None, None),
        ("a", "restriction", "other", None, None, None, None, None, None, None),
        ("b", "right", "ownership", "61-7", None, None, None, None, None, None),
    ]
    assert pages.printed_restrictions(lines).count() == 0


def test_tax_extract(spark):
    """Blocks that others close, a pledge without a founder, two pledges of one share, lines repeated inside and outside of blocks."""
    person = "ГРН и дата внесения в ЕГРЮЛ сведений о данном лице"
    lines = [
        ("Сокращенное наименование на русском языке", ""), ("Сокращенное наименование на русском языке", "ООО «Б»"), ("Дата регистрации", "11.12.2001"), ("Сведения о договоре залога", "Номер договора залога: 9"),
        (person, "1"), ("Полное наименование", "АО"), ("ОГРН", "1 1"), ("ОГРН", "1 2"), ("Размер доли", "33,3 %"),
        ("Сведения об обременении", ""), ("Сведения о договоре залога", "номер договора залога: А 1 Дата договора залога: 1.2.2003"), ("Сведения о залогодержателе", ""), (person, "2"), ("ИНН", "5"), ("Полное наименование на русском языке", "ООО «Большое»"),
        ("Сведения об обременении", ""), ("Сведения о нотариусе (договор залога)", "ИВАНОВ ИВАН"), (person, "3"), ("Фамилия, имя, отчество", "СИДОРОВ\nСИДОР"), ("Номинальная стоимость доли", "—"), ("Номинальная стоимость доли", "1 000"),
        ("КПП юридического лица", "6 1"), ("ОГРН", "1 7"), ("Должность", "вне блока"), (person, "4"), ("Полное наименование", "без доли"), (person, "5"), ("Должность", "Директор"), ("ОГРН", "8"), ("", ""),
    ]
    rows = [("a", i, f, v) for i, (f, v) in enumerate(lines)] + [("b", 1, "Способ образования", None), ("b", 2, None, None)]
    r = {x.document: x for x in tax_extracts.legal_entities(spark.createDataFrame(rows, "d string, n int, f string, v string").repartition(3), "d", "n", "f", "v").collect()}
    a = r["a"]
    assert (a.name_short, a.name_full, a.reg_date, a.ogrn, a.kpp, a.activity_main) == (None, "ООО «Большое»", "2001-12-11", "17", "61", None)
    assert [(x.kind, x.name, x.position, x.ogrn) for x in a.directors] == [("director", None, "Директор", None)]
    assert [(x.kind, x.name, x.ogrn, x.share_percent, x.share_nominal) for x in a.founders] == [("legal", "АО", "12", 33.3, None), ("person", "Сидоров Сидор", None, None, 1000.0)]
    assert [(p.contract_number, p.contract_date, p.notary, p.holder.inn, p.holder.name) for p in a.founders[0].pledges] == [("А1", "2003-02-01", None, "5", None), (None, None, "ИВАНОВ ИВАН", None, None)]
    assert (r["b"].ogrn, r["b"].founders, r["b"].directors) == (None, [], [])
    text = "Сведения о держателе реестра акционеров\nОГРН 1027700000001\nИНН 7700000001\nПолное наименование АО «Реестр»\nДон ГРН и дата\n Сведения о лице"
    k = one(spark, tax_extracts.registrar(F.lit(text)))
    assert tuple(k) == ("1027700000001", "7700000001", "АО «Реестр» Дон") and one(spark, tax_extracts.register(F.lit("Выписка из Единого государственного реестра индивидуальных предпринимателей"))) == "ip"
