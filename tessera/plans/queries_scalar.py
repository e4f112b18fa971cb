"""Dates, texts, numbers, hashes and polygons: expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import address, dates, geometry, inflection, numbers, text, values
from tessera.operators import matching
from tessera.operators import relational as R
from tessera.plans.registry import Tables, query

D = "strftime(o_orderdate, '%Y-%m-%d')"


def _ru(c: str = "o_orderdate"):
    return F.date_format(c, "dd.MM.yyyy")


@query(f"""
SELECT o_orderkey, {D} AS ru, CASE WHEN o_orderkey % 2 = 0 THEN {D} ELSE {D} || ' 12:30:00' END AS any_text, {D} || ' 09:08:07' AS moment FROM orders""")
def parse_dates(t: Tables) -> DataFrame:
    """DAT-01/02/03: written out and read again."""
    k = F.col("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    wording = F.when(k % 4 == 0, F.concat(iso, F.lit("T00:00:00+03:00"))).when(k % 4 == 2, F.concat(F.lit("от "), _ru(), F.lit("г."))).otherwise(F.concat(iso, F.lit("T12:30:00Z")))
    return t.orders.select(
        "o_orderkey",
        dates.date_ru(F.concat(F.lit("дата "), _ru(), F.lit("г. и 01.01.2001"))).cast("string").alias("ru"),
        dates.date_any(wording).alias("any_text"),
        F.date_format(dates.datetime_ru(F.concat(F.lit("x "), _ru(), F.lit("  09:08:07"))), "yyyy-MM-dd HH:mm:ss").alias("moment"),
    )


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3, 4) THEN {D} END AS valid_from,
 CASE o_orderkey % 6 WHEN 1 THEN '2010-05-06' WHEN 2 THEN CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE strftime(o_orderdate + INTERVAL 5 YEAR, '%Y-%m-%d') END
  WHEN 3 THEN CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE strftime(o_orderdate + INTERVAL 7 YEAR, '%Y-%m-%d') END END AS valid_until,
 CASE o_orderkey % 6 WHEN 2 THEN 5 WHEN 3 THEN 7 END AS years, CASE o_orderkey % 6 WHEN 0 THEN 'бессрочно' WHEN 5 THEN 'по соглашению' END AS description FROM orders""")
def parse_terms(t: Tables) -> DataFrame:
    """DAT-04/05."""
    k = F.col("o_orderkey") % 6
    wording = (
        F.when(k == 0, "срок: бессрочно")
        .when(k == 1, F.concat(F.lit("с "), _ru(), F.lit(" по 06.05.2010")))
        .when(k == 2, F.concat(F.lit("с "), _ru(), F.lit(" сроком на 5 лет")))
        .when(k == 3, F.concat(F.lit("с "), _ru(), F.lit(" 7 лет")))
        .when(k == 4, F.concat(F.lit("с "), _ru()))
        .otherwise(" по соглашению ")
    )
    out = t.orders.select("o_orderkey", dates.term(wording).alias("t"))
    return out.select("o_orderkey", F.col("t.valid_from").cast("string").alias("valid_from"), F.col("t.valid_until").cast("string").alias("valid_until"), F.col("t.years").alias("years"), F.col("t.description").alias("description"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') WHEN 1 THEN year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-01-01' ELSE '-07-01' END ELSE year(o_orderdate) || '-01-01' END AS period_from,
 CASE o_orderkey % 4 WHEN 0 THEN strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 1 THEN year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-06-30' ELSE '-12-31' END WHEN 2 THEN year(o_orderdate) || '-09-30' ELSE year(o_orderdate) || '-12-31' END AS period_to FROM orders""")
def ledger_periods(t: Tables) -> DataFrame:
    """DAT-06."""
    k, y = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    half = F.when(F.month("o_orderdate") <= 6, "1").otherwise("2")
    title = F.when(k == 0, F.concat_ws(" ", F.lit("ОСВ за"), F.quarter("o_orderdate").cast("string"), F.lit("квартал"), y, F.lit("г"))).when(k == 1, F.concat_ws(" ", F.lit("за"), half, F.lit("полугодие"), y)).when(k == 2, F.concat_ws(" ", F.lit("за 9 месяцев"), y)).otherwise(F.concat_ws(" ", F.lit("за"), y, F.lit("г")))
    p = dates.ledger_period(title)
    return t.orders.select("o_orderkey", p["period_from"].cast("string").alias("period_from"), p["period_to"].cast("string").alias("period_to"))


@query("SELECT o_custkey, round(365.0 / (date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) + 1), 6) AS factor FROM orders GROUP BY 1")
def annualize(t: Tables) -> DataFrame:
    """DAT-07."""
    ends = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return ends.select("o_custkey", dates.annual_factor(F.col("a"), F.col("b")).alias("factor"))


@query("""
SELECT event_id, strftime(ts, '%d.%m.%Y') || CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN '' ELSE strftime(ts, ' %H:%M:%S') END AS shown, strftime(ts, '%Y-%m-%d') AS from_name, event_id % 2 = 0 AS strict, event_id % 120 > 60 AS apart FROM events""")
def show_dates(t: Tables) -> DataFrame:
    """DAT-08/09/10/11."""
    k = F.col("event_id")
    return t.events.select(
        "event_id",
        dates.show_ru(F.col("ts")).alias("shown"),
        dates.filename_date(F.concat(F.lit("report_"), F.date_format("ts", "dd-MM-yyyy"), F.lit(".pdf"))).cast("string").alias("from_name"),
        dates.is_iso_date(F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("2023-02-29")).alias("strict"),
        dates.moments_differ(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=k % 120)).alias("apart"),
    )


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1999-03-04' ELSE {D} END AS day FROM orders")
def document_dates(t: Tables) -> DataFrame:
    """DAT-13: the kind's own pattern, else the first date."""
    k = F.col("o_orderkey") % 3
    kind, wording = F.when(k == 0, "act").otherwise("letter"), F.concat(_ru(), F.lit(" Дата составления: 04.03.1999"))
    return t.orders.select("o_orderkey", dates.document_date(kind, wording, {"act": "Дата составления:"}).cast("string").alias("day"))


@query("""
SELECT p_partkey, '61:44:00' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || ':' || p_size AS cad, '61:44:00' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS quarter, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS inn, lpad(CAST(p_partkey AS VARCHAR), 13, '1') AS ogrn, CASE WHEN p_partkey % 2 = 0 THEN 'legal_entity' ELSE 'individual' END AS holder FROM part""")
def registry_ids(t: Tables) -> DataFrame:
    """TXT-01/02/03."""
    k = F.col("p_partkey").cast("string")
    cad = F.concat_ws(":", F.lit("61"), F.lit("44"), F.concat(F.lit("00"), F.lpad(k, 5, "0")), F.col("p_size").cast("string"))
    inn = F.when(F.col("p_partkey") % 2 == 0, F.lpad(k, 10, "0")).otherwise(F.lpad(k, 12, "0"))
    line = F.concat(F.lit("объект "), cad, F.lit(", ИНН: "), inn, F.lit(" ОГРН "), F.lpad(k, 13, "1"))
    found = text.cad_numbers(F.concat(line, F.lit("; снова "), cad))[0]
    return t.part.select("p_partkey", found.alias("cad"), text.cad_quarter(found).alias("quarter"), text.tax_id(line).alias("inn"), text.registration_id(line).alias("ogrn"), text.holder_type(F.col("p_name"), text.tax_id(line)).alias("holder"))


@query("""
SELECT p_partkey, '61:44:0050706:' || p_size || ',61:44:0050706:' || (p_size + 1) || '/2,61:44:0050706:' || lpad(CAST(p_size AS VARCHAR), 3, '1') AS ids FROM part""")
def id_spellings(t: Tables) -> DataFrame:
    """TXT-35: colons, underscores and digits in a row."""
    n = F.col("p_size").cast("string")
    line = F.concat(F.lit("план 61:44:0050706:"), n, F.lit(" и 61_44_0050706_"), (F.col("p_size") + 1).cast("string"), F.lit("__2.pdf, 61440050706"), F.lpad(n, 3, "1"))
    return t.part.select("p_partkey", F.array_join(text.any_cad_numbers(line), ",").alias("ids"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ООО "' ELSE 'ПАО "' END || c_name || '"' AS short, CASE WHEN c_custkey % 2 = 0 THEN 'ооо' ELSE 'публичноеао' END || lower(c_name) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'ownership' ELSE 'mortgage' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'okn_territory' ELSE 'czuit_zone' END AS zone FROM customer""")
def holder_names(t: Tables) -> DataFrame:
    """TXT-05/06/07/14/15."""
    even = F.col("c_custkey") % 2 == 0
    long = F.concat(F.when(even, "Общество с ограниченной ответственностью").otherwise("ПУБЛИЧНОЕ АКЦИОНЕРНОЕ ОБЩЕСТВО"), F.lit(' "'), "c_name", F.lit('"'))
    return t.customer.select("c_custkey", text.squeezed(text.short_form(F.concat(F.lit("  "), long))).alias("short"), text.holder_key(long).alias("key"), text.right_type(F.when(even, " Общая долевая собственность").otherwise("Ипотека в силу закона")).alias("kind"), text.restriction_type(F.when(even, "Памятник архитектуры").otherwise("Охранная зона"), F.col("c_name")).alias("zone"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN greatest(p_size, 1) WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS above, CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END AS below FROM part""")
def floor_texts(t: Tables) -> DataFrame:
    """TXT-13."""
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, "помещение №25, 1-3 этажи").when(k == 1, F.concat(F.lit("Этаж № "), F.greatest("p_size", F.lit(1)).cast("string"))).when(k == 2, "комната второго этажа").when(k == 3, "подвал № 7").otherwise("мансарда")
    f = text.floors(line)
    return t.part.select("p_partkey", f["above"].alias("above"), f["below"].alias("below"))


@query("""
SELECT p_partkey, 'ростовская обл г ростов-на-дону ул садовая д ' || p_size AS norm, 'садовая' AS street, CAST(p_size AS VARCHAR) AS house, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM part""")
def addresses(t: Tables) -> DataFrame:
    """TXT-08..11."""
    n = F.col("p_size").cast("string")
    a = F.concat(F.lit("344000, Россия, Ростовская область, город Ростов-на-Дону, улица Садовая, дом "), n)
    b = F.concat(F.lit("г. Москва, ул. Садовая, д. "), F.when(F.col("p_size") % 2 == 0, n).otherwise(F.concat(n, F.lit("7"))))
    both = t.part.select("p_partkey", address.facts(a).alias("a"), address.facts(b).alias("b"))
    return both.select("p_partkey", "a.norm", "a.street", "a.house", address.likeness_of(F.col("a"), F.col("b")).alias("score"))


@query("""
SELECT p_partkey, 'Ростовская обл.' AS region, 'г. Ростов-на-Дону' AS locality, 'ул. Садовая' AS street, CASE WHEN p_partkey % 2 = 0 THEN 'д. ' || p_size ELSE CAST(p_size AS VARCHAR) END AS house, 'Кировский район' AS municipality, CASE WHEN p_partkey % 3 = 0 THEN 'кв. 5' END AS room FROM part""")
def address_components(t: Tables) -> DataFrame:
    """TXT-12."""
    n = F.col("p_size").cast("string")
    raw = F.concat_ws(", ", F.lit("Ростовская обл."), F.lit("г. Ростов-на-Дону"), F.lit("Кировский район"), F.lit("ул. Садовая"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("д. "), n)).otherwise(n), F.when(F.col("p_partkey") % 3 == 0, "кв. 5"))
    c = address.components(raw)
    return t.part.select("p_partkey", *(c[x].alias(x) for x in ("region", "locality", "street", "house", "municipality", "room")))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'room' WHEN 1 THEN 'building' WHEN 2 THEN 'land' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'Фасад' WHEN 1 THEN 'Этаж_' || p_size END AS tag, CASE p_partkey % 2 WHEN 0 THEN 'egrul' ELSE 'tehpasp' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'кирпичное' ELSE p_type END AS wall, CASE WHEN p_partkey % 3 = 0 THEN 'ЕЗП' WHEN p_partkey % 3 = 1 THEN 'МКУ' ELSE 'ЗУ' END AS layout FROM part""")
def classifiers(t: Tables) -> DataFrame:
    """TXT-17/19/36/37/38."""
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        text.category(F.when(k % 4 == 0, "нежилое помещение в здании").when(k % 4 == 1, "Здание школы").when(k % 4 == 2, "ЗУ 5").otherwise("прочее")).alias("category"),
        text.folder_tag(F.when(k % 3 == 0, "фасад_главный").when(k % 3 == 1, F.concat(F.lit("этаж "), F.col("p_size").cast("string"))).otherwise("Фото")).alias("tag"),
        text.document_kind(F.when(k % 2 == 0, "ЕГРЮЛ").otherwise("документы"), F.when(k % 2 == 0, "x.pdf").otherwise("техпаспорт.pdf"), F.lit(""), {}).alias("kind"),
        text.wall_material(F.when(k % 2 == 0, "Кирпичные стены").otherwise(F.col("p_type"))).alias("wall"),
        text.land_layout(F.when(k % 3 == 0, "Единое землепользование").otherwise("участок"), F.lit("61:44"), F.when(k % 3 == 1, 2), F.array().cast("array<string>")).alias("layout"),
    )


@query("""
SELECT c_custkey, lower(replace(c_name, '#', '')) AS slug, 'https://x.org/' || c_custkey AS url, lower(c_mktsegment) AS named, CAST(c_nationkey AS VARCHAR) AS first_value, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'И' || c_custkey END AS inv FROM customer""")
def text_forms(t: Tables) -> DataFrame:
    """TXT-22/25/26/30/32."""
    k = F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    url = F.concat(F.lit("https://x.org/"), k)
    return t.customer.select(
        "c_custkey",
        text.slug(F.replace("c_name", F.lit("#"), F.lit(""))).alias("slug"),
        text.token_url(text.url_token(url)).alias("url"),
        text.name_key(F.concat(F.substring("c_mktsegment", 1, 3), F.lit(" -"), F.col("c_mktsegment").substr(4, 20))).alias("named"),
        F.try_element_at(text.pairs(F.concat(F.lit("a: "), F.col("c_nationkey").cast("string"), F.lit("; b: c: d"))), F.lit("a")).alias("first_value"),
        text.inventory_number(F.concat(F.lit("Стол инв. № "), F.when(even, F.col("c_name")).otherwise(F.concat(F.lit("И"), k)))).alias("inv"),
    )


@query("SELECT n_nationkey, lower(n_name) AS back, n_nationkey % 2 = 0 AS anagram FROM nation")
def keyboard_layouts(t: Tables) -> DataFrame:
    """TXT-24/25, JON-21: typed on the other layout and back; letters in another order."""
    low = F.lower(F.regexp_replace("n_name", "[^A-Z]", ""))
    typed = text.other_layout(low)
    shuffled = F.when(F.col("n_nationkey") % 2 == 0, F.reverse(low)).otherwise(F.concat(low, F.lit("q")))
    return t.nation.select("n_nationkey", F.when(text.other_layout(typed) == low, F.lower("n_name")).alias("back"), (text.anagram_key(shuffled) == text.anagram_key(low)).alias("anagram"))


@query("SELECT n_name AS l, (SELECT min(o.n_name) FROM nation o WHERE list_sort(string_split(replace(o.n_name, '_', ''), '')) = list_sort(string_split(replace(nation.n_name, '_', ''), ''))) AS r, 1.0::DOUBLE AS score FROM nation")
def name_matching(t: Tables) -> DataFrame:
    """JON-21: the best name; anagrams are equal, so the smallest of them is taken."""
    return matching.by_name(t.nation, t.nation.select(F.col("n_name").alias("other")), "n_name", "other")


@query("""
WITH n AS (SELECT DISTINCT p_name AS l FROM part), k AS (SELECT l, list_sort(string_split(replace(l, ' ', ''), '')) AS k FROM n)
SELECT k.l, min(o.l) AS r, 1.0::DOUBLE AS score FROM k JOIN k o USING (k) GROUP BY k.l""")
def part_name_matching(t: Tables) -> DataFrame:
    """JON-21 over the names of all parts."""
    return matching.by_name(t.part, t.part.select(F.col("p_name").alias("other")), "p_name", "other")


@query("""
WITH c AS (SELECT DISTINCT c_name, length(c_name) AS n FROM customer)
SELECT c_name || 'x' AS l, c_name AS r, 2.0::DOUBLE * n / (2 * n + 1) AS score FROM c""")
def customer_name_matching(t: Tables) -> DataFrame:
    """JON-21 over names that are all of one form: none has an equal, and each finds its own among those that differ in digits."""
    return matching.by_name(t.customer.select(F.concat("c_name", F.lit("x")).alias("typed")), t.customer, "typed", "c_name")


@query("SELECT s_suppkey, s_suppkey AS other, 1.0::DOUBLE AS score FROM supplier")
def address_matching(t: Tables) -> DataFrame:
    """JON-13: the right street's name contains the left one's."""
    k = F.col("s_suppkey").cast("string")
    street = F.concat(F.lit("садовая"), F.translate(k, "0123456789", "абвгдежзик"), F.lit("ю"))
    left = t.supplier.select("s_suppkey", F.concat(F.lit("ул "), street, F.lit(" д "), k).alias("a"))
    right = t.supplier.select(F.col("s_suppkey").alias("other"), F.concat(F.lit("ул ново"), street, F.lit(" д "), k).alias("b"), F.lit(1).alias("rank"))
    return matching.by_address(left, right, "s_suppkey", "other", "a", "b", "rank").withColumn("score", F.when(F.col("score") >= 0.7, 1.0).otherwise(F.col("score")))


@query("""
SELECT p_partkey, round(p_retailprice, 2) AS number, CAST(p_size AS DOUBLE) AS lead, CASE WHEN 1690 + p_size BETWEEN 1700 AND 2100 THEN 1690 + p_size END AS year, substr(sha1(p_name || chr(0) || chr(0)), 1, 16) AS h, round(p_size / p_retailprice, 6) AS scale, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * round(p_size + 30 / 60.0 + 36 / 3600.0, 6) AS deg FROM part""")
def numbers_parsed(t: Tables) -> DataFrame:
    """MTH-01/02/03/05/09/10."""
    n = F.col("p_size")
    return t.part.select(
        "p_partkey",
        numbers.number(F.concat(F.lit("цена "), F.replace(F.round("p_retailprice", 2).cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" руб"))).alias("number"),
        numbers.leading_number(F.concat(n.cast("string"), F.lit(" кв. м, 2 этажа"))).alias("lead"),
        numbers.year((n + 1690).cast("string")).alias("year"),
        numbers.stable_hash(F.col("p_name"), F.lit(None).cast("string")).alias("h"),
        numbers.scale_correction(n.cast("double"), F.col("p_retailprice")).alias("scale"),
        F.round(numbers.dms(n, F.lit(30), F.lit(36), F.when(n % 2 == 0, "S").otherwise("N")), 6).alias("deg"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN -3.0 * greatest(p_size % 4, 1) WHEN 1 THEN (p_size - 1) * 3.0 WHEN 2 THEN p_size * 3.0 WHEN 3 THEN (p_size + 1) * 3.0 ELSE (p_size - 1) * 3.0 + 2 END AS z, p_size + 2 AS levels FROM part""")
def level_heights(t: Tables) -> DataFrame:
    """MTH-07/08."""
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    kind = F.when(k == 0, "подвал").when(k == 1, "этаж").when(k == 2, "мансарда").when(k == 3, "технический этаж").otherwise("антресоль")
    label = F.when(k == 0, F.concat(F.lit("Подвал "), F.greatest(n % 4, F.lit(1)).cast("string"))).when(k == 1, F.concat(F.lit("Этаж "), n.cast("string"))).when(k == 4, F.concat(F.lit("Антресоль "), n.cast("string"), F.lit(" этажа"))).otherwise(kind)
    return t.part.select("p_partkey", numbers.level_height(kind, label, k == 0, n).alias("z"), F.size(numbers.levels(n, F.lit(2))).alias("levels"))


@query("SELECT p_partkey, p_size % 10 > 5 OR (p_size % 10 = 5 AND p_partkey % 10 > 3) AS newer FROM part")
def version_order(t: Tables) -> DataFrame:
    """MTH-11."""
    v = F.concat(F.lit("v"), (F.col("p_size") % 10).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    return t.part.select("p_partkey", (numbers.version_key(v) > numbers.version_key(F.lit("v5.3"))).alias("newer"))


@query("""
SELECT p_partkey, round(p_size * 0.5, 6) AS cx, round(p_size * 1.0, 6) AS cy, round(p_size * 2.0 * p_size, 4) AS area, round(p_size * 0.5, 6) AS mx, 5 AS points FROM part""")
def polygon_metrics(t: Tables) -> DataFrame:
    """GEO-01..06: rectangles written as text, read and measured in their own units."""
    n = F.col("p_size").cast("double")
    line = F.concat_ws(" ", F.lit("0.0 0.0,"), F.concat(n.cast("string"), F.lit(" 0.0,")), F.concat_ws(" ", n.cast("string"), F.concat((2 * n).cast("string"), F.lit(","))), F.concat(F.lit("0.0 "), (2 * n).cast("string")))
    # a column for what the next step uses many times keeps the expressions small
    rings = t.part.select("p_partkey", geometry.polygon(line).alias("ring"))
    ring = F.col("ring")
    parts = rings.select("p_partkey", geometry.bbox_centre(ring).alias("c"), geometry.ring_centroid(ring).alias("m"), geometry.signed_area(ring).alias("a"), geometry.normalised(ring).alias("n"))
    return parts.select("p_partkey", F.round(F.col("c")[0], 6).alias("cx"), F.round(F.col("c")[1], 6).alias("cy"), F.round(F.abs("a"), 4).alias("area"), F.round(F.col("m")[0], 6).alias("mx"), F.size("n.points").alias("points"))


@query("""
SELECT c_custkey, round((5 + 3 * sqrt(rn)) * cos((rn - 1) * 2.399963229728653) / 111320, 9) AS lon, round((5 + 3 * sqrt(rn)) * sin((rn - 1) * 2.399963229728653) / 111320, 9) AS lat FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)""")
def spiral(t: Tables) -> DataFrame:
    """WIN-09, GEO-08: places around a point on the equator."""
    placed = R.numbered(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], [F.col("c_custkey")], "rn")
    p = geometry.spiral(F.array(F.lit(0.0), F.lit(0.0)), F.col("rn") - 1)
    return placed.select("c_custkey", F.round(p[0], 9).alias("lon"), F.round(p[1], 9).alias("lat"))


@query("""
SELECT p_partkey, 'POLYGON((0.0 0.0, ' || p_size || '.0 0.0, 1.0 1.0, 0.0 0.0))' AS wkt, CASE WHEN p_size % 2 = 0 THEN round(degrees(200.0 * p_size / 6378137.0), 8) ELSE 0.5 END AS lon, 1 AS rings, CASE WHEN p_size % 10 < 5 THEN 'far above' END AS reason FROM part""")
def geometry_forms(t: Tables) -> DataFrame:
    """GEO-07/09/10, FLT-16."""
    n = F.col("p_size").cast("double")
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(n, F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    metres = geometry.from_mercator(F.when(F.col("p_size") % 2 == 0, F.array(n * 200.0, F.lit(100.0))).otherwise(F.array(F.lit(0.5), F.lit(0.5))))
    return t.part.select("p_partkey", geometry.wkt(ring).alias("wkt"), F.round(metres[0], 8).alias("lon"), F.size(geometry.contours(geometry.geojson(ring))).alias("rings"), geometry.area_sane(F.when(F.col("p_size") % 10 < 5, 500.0).otherwise(5.0), F.lit(1.0)).alias("reason"))


@query("""
SELECT p_partkey, p_partkey % 3 = 0 AS masked, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS clean, CASE WHEN p_size < 10 THEN 'small' WHEN p_size = 10 THEN 'ten' ELSE 'other' END AS label, p_partkey % 2 = 0 AS differ, CASE WHEN p_size > 0 THEN p_size END AS num FROM part""")
def value_forms(t: Tables) -> DataFrame:
    """PRJ-02, FLT-11/12, COL-01, TXT-04."""
    k = F.col("p_partkey")
    marked = F.when(k % 3 == 0, F.lit("не указано")).otherwise(F.col("p_name"))
    code = F.when(F.col("p_size") < 10, "s").when(F.col("p_size") == 10, "t").otherwise("?")
    a, b = F.lit('["x","y"]'), F.when(k % 2 == 0, F.lit('["y"]')).otherwise(F.lit('["y", "x"]'))
    share = values.parse_share(F.concat(F.lit("доля "), F.col("p_size").cast("string"), F.lit(" / 100")))
    return t.part.select("p_partkey", values.is_masked(marked).alias("masked"), values.cleaned(marked).alias("clean"), values.decode(code, {"s": "small", "t": "ten"}, F.lit("other")).alias("label"), values.lists_differ(a, b).alias("differ"), share["numerator"].alias("num"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mails, regexp_extract(text, '[0-9]{4,}', 0) AS first_long FROM documents""")
def text_extract(t: Tables) -> DataFrame:
    """Patterns of numbers and addresses over whole free texts."""
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t.documents.select("doc_id", n("[0-9]+").alias("numbers"), n("[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("mails"), F.regexp_extract("text", "[0-9]{4,}", 0).alias("first_long"))


@query("""
SELECT c_custkey, 'c' || c_custkey || ';n' || c_nationkey AS entries, lower(c_mktsegment) AS kept FROM customer""")
def map_forms(t: Tables) -> DataFrame:
    """PRJ-06/07, COL-07: personal and technical keys dropped; parallel arrays as structs."""
    attrs = F.create_map(F.lit("_src"), F.lit("x"), F.lit("Phone"), F.lit("1"), F.lit("kind"), F.lower("c_mktsegment"))
    kept = values.without_technical(values.without_keys(attrs, ["phone"]))
    links = values.links(F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")), F.array(F.lit("c"), F.lit("n")))
    return t.customer.select("c_custkey", F.array_join(F.transform(links, lambda x: F.concat(x["kind"], x["id"])), ";").alias("entries"), F.array_join(F.map_values(kept), ",").alias("kept"))


#: Phrases in the six cases.
_INFLECTED = [
    ("Земельный участок", "Земельного участка", "Земельному участку", "Земельный участок", "Земельным участком", "Земельном участке"),
    ("нежилое здание", "нежилого здания", "нежилому зданию", "нежилое здание", "нежилым зданием", "нежилом здании"),
    ("центральная часть города", "центральной части города", "центральной части города", "центральную часть города", "центральной частью города", "центральной части города"),
    ("Производственная территория ООО", "Производственной территории ООО", "Производственной территории ООО", "Производственную территорию ООО", "Производственной территорией ООО", "Производственной территории ООО"),
    ("склад и административное помещение", "склада и административного помещения", "складу и административному помещению", "склад и административное помещение", "складом и административным помещением", "складе и административном помещении"),
    ("транспортная доступность, общая площадь", "транспортной доступности, общей площади", "транспортной доступности, общей площади", "транспортную доступность, общую площадь", "транспортной доступностью, общей площадью", "транспортной доступности, общей площади"),
    ("в центральной части", "в центральной части", "в центральной части", "в центральной части", "в центральной части", "в центральной части"),
    ("подъездная дорога № 2", "подъездной дороги № 2", "подъездной дороге № 2", "подъездную дорогу № 2", "подъездной дорогой № 2", "подъездной дороге № 2"),
]


@query("WITH f(i, nom, gen, dat, acc, ins, loc) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in f) + ")" for i, f in enumerate(_INFLECTED)) + ") SELECT p_partkey, nom, gen, dat, acc, ins, loc FROM part JOIN f ON i = p_partkey % 8")
def inflected_phrases(t: Tables) -> DataFrame:
    """TXT-28: a lot's phrases in six cases."""
    phrase = F.element_at(F.array(*(F.lit(f[0]) for f in _INFLECTED)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", inflection.inflected(phrase, *inflection.CASES).alias("f")).select("p_partkey", "f.*")
