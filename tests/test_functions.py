from pyspark.sql import functions as F

from tessera.functions import address, dates, geometry, numbers, text, values
from tessera.operators import matching


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v):
    return F.lit(v)


def test_dates(spark):
    cases = {
        dates.date_ru: [("30.02.2024", None), ("от 01.02.2024г. и 03.04.2025", "2024-02-01"), ("x", None)],
        dates.date_any: [("2002-12-30T00:00:00+03:00", "2002-12-30"), ("2002-12-30 01:02:03", "2002-12-30 01:02:03"), ("30.12.2002 12:26:19", "2002-12-30 12:26:19"), ("дата 30.12.2002", "2002-12-30"), ("", None)],
        dates.filename_date: [("a_05-06-2021.pdf", "2021-06-05")],
    }
    for f, pairs in cases.items():
        for given, want in pairs:
            assert one(spark, f(lit(given)).cast("string")) == want, (f, given)
    assert one(spark, dates.add_years(lit("2024-02-29").cast("date"), lit(1))) is None
    t = one(spark, dates.term(lit("с 29.02.2020 сроком на 49 лет")))
    assert (str(t.valid_from), t.valid_until, t.years) == ("2020-02-29", None, 49)
    assert one(spark, dates.term(lit("на неопределённый срок"))).description == "бессрочно"
    p = one(spark, dates.ledger_period(lit("ОСВ за 4 квартал 2025 г")))
    assert (str(p.period_from), str(p.period_to)) == ("2025-10-01", "2025-12-31")
    assert one(spark, dates.ledger_period(lit("без периода"))).period_from is None


def test_text(spark):
    assert one(spark, text.cad_number(lit("№ 61:44: 0050706:31"))) == "61:44:0050706:31"
    assert one(spark, text.cad_quarter(lit("61:44:0050706:31"))) == "61:44:0050706"
    assert one(spark, text.right_type(lit("Общая долевая собственность"))) == "ownership"
    assert one(spark, text.influence(lit("Ипотека в силу закона"))).startswith("не препятствует")
    assert one(spark, text.influence(lit("")))is None
    assert one(spark, text.short_form(lit("ПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО Банк"))) == "ПАО Банк"
    assert one(spark, text.other_layout(lit("ghbdtn"))) == "привет"
    assert one(spark, text.slug(lit("Щука-Ёж №5"))) == "schuka_ezh_5"
    assert one(spark, text.token_url(text.url_token(lit("https://a.b/c?d=e")))) == "https://a.b/c?d=e"
    assert one(spark, text.url_token(lit("javascript:alert(1)"))) is None
    assert one(spark, text.token_url(lit("%%%"))) is None
    assert one(spark, text.pairs(lit("a: 1; b: x:y; a: 2"))) == {"a": "2", "b": "x:y"}
    assert one(spark, text.without_consent(lit("Иванов\nСведения о возможности предоставления третьим лицам персональных данных: да\nИНН: 1"))) == "Иванов\n\nИНН: 1"
    f = one(spark, text.floors(lit("комнаты №№25, 26 третьего этажа, антресоль 4")))
    assert (f.above, f.below) == (4, 0)
    assert one(spark, text.edge_group(lit("Часть земельного участка"))).kind == "part"
    assert one(spark, text.lease_key(lit("Кафе дог.аренды №5 от 01.02.2020 :123"))) == "кафе"
    assert one(spark, text.ledger_entity(lit("ОСВ_ООО_АБВГ 01.2025.xlsx"))).name == "ООО АБВГ"
    assert one(spark, text.folder_tag(lit("кв. 12, 14"))) == "Кв_12_14"
    assert one(spark, text.document_kind(lit("ЕГРЮЛ-ЕГРИП"), lit("fl-1.pdf"), lit(None).cast("string"), {})) == "egrip"
    assert one(spark, text.permitted_uses(F.array(lit(" a "), lit(""), lit("b")))) == "a; b"


def test_addresses(spark):
    a, b = lit("г. Ростов-на-Дону, ул. Садовая, д. 5/2"), lit("Ростов-на-Дону, улица Садовая, дом 5")
    assert one(spark, address.likeness(a, b)) >= 0.7
    assert one(spark, address.likeness(a, lit("ул. Садовая, д. 6"))) == 0.0
    c = one(spark, address.components(lit("г. Москва, д. Иваново, ЦАО, ул. Мира, 12А, корп. 3, кв. 9")))
    assert (c.region, c.locality, c.street, c.house, c.building, c.room, c.municipality) == ("г. Москва", "г. Москва", "ул. Мира", "д. Иваново", "корп. 3", "кв. 9", "ЦАО")
    assert one(spark, F.array_sort(address.folder_tokens(lit("ул. Мира-5, 2006, корп 7")))) == ["7", "мира-5"]


def test_numbers(spark):
    assert one(spark, numbers.number(lit("1 234,5 руб"))) == 1234.5
    assert one(spark, numbers.number(lit("1.2.3"))) is None
    assert one(spark, numbers.leading_number(lit("12 345,6 кв.м"))) == 12345.6
    assert one(spark, numbers.year(lit("1699"))) is None
    assert one(spark, numbers.values_differ(lit(100.0), lit(100.005))) is False
    assert one(spark, numbers.values_differ(lit(None).cast("double"), lit(1.0))) is True
    assert one(spark, numbers.stable_hash(lit("a"), lit(None))) == __import__("hashlib").sha1(b"a\0\0").hexdigest()[:16]
    labels = [x.label for x in one(spark, numbers.levels(lit(2), lit(2)))]
    assert labels == ["Подвал 2", "Подвал 1", "Этаж 1", "Этаж 2"]


def test_values_and_geometry(spark):
    assert one(spark, values.target_path(lit("objects[id=x 1].rights"))).value == "x 1"
    assert one(spark, values.lists_differ(lit('["a","b"]'), lit('["b","a"]'))) is False
    assert one(spark, values.lists_differ(lit(None).cast("string"), lit("[]"))) is False
    assert one(spark, values.is_masked(lit("***"))) is True and one(spark, values.is_masked(lit(None).cast("string"))) is True
    ring = geometry.polygon(lit("39.0 47.0, 39.001 47.0, 39.001 47.001, 39.0 47.001"))
    area = one(spark, geometry.area(ring))
    assert abs(area - 0.001 * 111_320 * 0.68199 * 0.001 * 110_540) < 5
    many = F.transform(F.sequence(lit(0), lit(99)), lambda i: F.array(F.cos(i / 10.0), F.sin(i / 10.0)))
    assert len(one(spark, geometry.normalised(many)).points) <= 25
    assert one(spark, geometry.contours(lit('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[2,2],[3,2],[3,3]]]]}')))[1][0] == [2.0, 2.0]


def test_matching(spark):
    left = spark.createDataFrame([("ghbdtn vbh",), ("берёзовый сад",), ("zzzzzz",)], "a string")
    right = spark.createDataFrame([("Привет мир",), ("Березовый_Сад 2",), ("далеко",)], "b string")
    got = {r.l: (r.r, round(r.score, 2)) for r in matching.by_name(left, right, "a", "b").collect()}
    assert got["ghbdtn vbh"] == ("Привет мир", 1.0) and got["берёзовый сад"][0] == "Березовый_Сад 2" and len(got) == 2
    a = spark.createDataFrame([(1, "г. Ростов-на-Дону, ул. Садовая, д. 5"), (2, "ул. Мира")], "i int, a string")
    b = spark.createDataFrame([(7, "улица Садовая, дом 5", 2), (8, "ул. Садовая, д. 5, кв. 1", 1), (9, "пер. Мира, 1", 1)], "j int, b string, rank int")
    assert [(r.i, r.j) for r in matching.by_address(a, b, "i", "j", "a", "b", "rank").collect()][0] == (1, 8)
