"""Wordings, orders, checks, cascades and streams over the driver's tables, on inputs that vary from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import address, dates, geometry, text, values
from tessera.operators import relational as R
from tessera.operators import validate as V
from tessera.operators import views
from tessera.plans.registry import Tables, query
from tessera.scratch import scratch_path
from tessera.streaming import streams


def _s(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _pick(index: Column, *items: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (index + 1).cast("int"))


@query("""
SELECT p_partkey, ['не препятствует продаже; прекращается при исполнении условий торгов', 'ограничивает использование на срок действия договора аренды', 'ограниченное право пользования смежными лицами; сохраняется при смене собственника', NULL][p_partkey % 4 + 1] AS influence,
 nullif(array_to_string(list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END], lambda x: x IS NOT NULL), '; '), '') AS uses, ['building_to_premises', 'land_to_building', 'part', 'ezp', 'other'][p_partkey % 5 + 1] AS edge, CASE p_partkey % 3 WHEN 0 THEN 'кафе' WHEN 1 THEN 'пляж' END AS unit, p_partkey % 3 = 1 AS outdoor FROM part""")
def wordings(t: Tables) -> DataFrame:
    """TXT-16/18/20/21."""
    k = F.col("p_partkey")
    name = F.concat(_pick(k % 3, "Кафе «", "Летний ПЛЯЖ «", "Склад «"), "p_brand", F.lit("»"))
    return t.part.select(
        "p_partkey",
        text.influence(_pick(k % 4, "Ипотека в силу закона", "аренда", "сервитут", "что-то иное")).alias("influence"),
        text.permitted_uses(F.array(F.concat(F.lit(" "), "p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "))).alias("uses"),
        text.edge_group(_pick(k % 5, "Помещения в здании", "Список объектов недвижимости", "Часть земельного участка", "Состав ЕЗП", "Прочее"))["kind"].alias("edge"),
        text.business_unit_hint(name).alias("unit"),
        text.is_outdoor(name).alias("outdoor"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ООО ' ELSE 'АО ' END || replace(c_name, '#', '') AS entity, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS inn, 'Имя: ' || c_name || CASE WHEN c_custkey % 2 = 1 THEN chr(10) ELSE '' END || chr(10) || 'ИНН: 1' AS consent, c_custkey % 2 = 1 AS speaks, 'Лот ' || c_custkey || ': ' || c_mktsegment || ', ' AS lot, c_mktsegment AS label,
 lower(c_mktsegment) || ' ' || c_nationkey AS lease, lower('Report_' || c_custkey) AS report, lower(c_mktsegment) AS tokens FROM customer""")
def name_parts(t: Tables) -> DataFrame:
    """TXT-23/27/29/31/33/34/39."""
    k = F.col("c_custkey")
    even = k % 2 == 0
    ledger = F.concat(F.lit("ОСВ_"), F.when(even, "Общество с ограниченной ответственностью ").otherwise("Акционерное общество "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("_"), F.lpad(_s(k), 10, "0"), F.lit(" 12.2023.xlsx"))
    entity = text.ledger_entity(ledger)
    page = F.concat(F.lit("Имя: "), "c_name", F.when(~even, F.concat(F.lit("\n"), F.lit(text.CONSENT), F.lit(" имеются\nда"))).otherwise(""), F.lit("\nИНН: 1"))
    return t.customer.select(
        "c_custkey",
        entity["name"].alias("entity"),
        entity["inn"].alias("inn"),
        text.without_consent(page).alias("consent"),
        text.speaks_of_consent(page).alias("speaks"),
        text.filled("Лот {id}: {kind}, {none}", id=k, kind=F.col("c_mktsegment"), none=F.lit(None).cast("string")).alias("lot"),
        text.label(F.concat(F.lit("<b>"), "c_mktsegment", F.lit("</b> · "), "c_name")).alias("label"),
        text.lease_key(F.concat("c_mktsegment", F.lit(" Договор №"), _s(k), F.lit(" от 01.02.2020 "), _s("c_nationkey"))).alias("lease"),
        text.report_key(F.concat(F.lit("Report_"), _s(k), F.when(even, "_sig.xml").otherwise(".PDF"))).alias("report"),
        F.array_join(address.folder_tokens(F.concat(F.lit("ул. "), "c_mktsegment", F.lit(", д. 1999, россия"))), " ").alias("tokens"),
    )


@query("""
SELECT p_partkey, 'zone=' || CASE WHEN p_partkey % 2 = 0 THEN 'ЗОУИТ' ELSE 'q' END AS labels, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_size END AS old_number, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 END AS listed, CASE WHEN p_partkey % 2 = 0 THEN 'c' || p_partkey END AS photo, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, 7) END AS note FROM part""")
def stored_values(t: Tables) -> DataFrame:
    """COL-03/04/05/08."""
    k = F.col("p_partkey")
    restrictions = F.array(F.struct(F.when(k % 2 == 0, "z").otherwise("q").alias("type"), F.lit("t").alias("text")))
    labels = F.array_join(F.transform(values.labelled(restrictions, {"z": "ЗОУИТ"}), lambda r: F.concat(F.lit("zone="), r["label"])), ";")
    old = F.array(F.struct(F.lit("Инвентарный номер").alias("type"), F.lit("i").alias("number")), F.struct(F.when(k % 3 == 0, "Условный номер").otherwise("Иной").alias("type"), F.concat(F.lit("u"), _s("p_size")).alias("number")))
    comment = F.to_json(F.struct(F.when(k % 2 == 0, "own").otherwise("other").alias("app"), F.concat(F.lit("c"), _s(k)).alias("cad"), F.col("p_name").alias("note")))
    photo = values.photo_payload(comment, "own", 7)
    return t.part.select("p_partkey", labels.alias("labels"), values.conditional_number(old).alias("old_number"), F.size(values.json_list(F.when(k % 4 == 0, "[broken").otherwise('["a", "b"]'))).alias("listed"), photo["cad"].alias("photo"), photo["note"].alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 40.0 + c_nationkey / 100.0 END AS lon, CASE WHEN c_custkey % 2 = 0 THEN 47.5 END AS lat FROM customer")
def text_points(t: Tables) -> DataFrame:
    """GEO-11/12: coordinates in a text, in the other order; what lies outside the box isn't a place."""
    line = F.concat(F.lit("координаты: 47.5, "), F.round(F.lit(40.0) + F.col("c_nationkey") / 100.0, 2).cast("string"), F.lit(" на карте"))
    point = geometry.coordinates_in_text(F.when(F.col("c_custkey") % 2 == 0, line).otherwise(F.concat(F.lit("размер 300.5, 200.5 "), "c_name")))
    flipped = geometry.flipped(F.array(point))[0]
    return t.customer.select("c_custkey", F.round(flipped[1], 6).alias("lon"), F.round(flipped[0], 6).alias("lat"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS registered, c_custkey % 3 = 0 AS closed, c_custkey % 5 <> 0 AS report FROM customer")
def object_states(t: Tables) -> DataFrame:
    """FLT-02/14/15: not deregistered; a text that speaks of it; files of photo reports left out."""
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 4 == 0, "deregistered").otherwise("active").alias("lifecycle_status"), F.when(k % 3 == 0, F.concat(F.lit("Снято с учета "), "c_name")).otherwise(F.col("c_name")).alias("status"), F.when(k % 5 == 0, F.concat(F.lit("Фотоотчет_"), _s(k))).otherwise(F.col("c_name")).alias("file"))
    live = views.registered(rows).select("c_custkey", F.lit(True).alias("registered"))
    kept = R.excluded_files(rows, "file", ["фотоотч[её]т"]).select("c_custkey", F.lit(True).alias("report"))
    out = rows.join(live, "c_custkey", "left").join(kept, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("registered", F.lit(False)).alias("registered"), views.is_deregistered(F.col("status")).alias("closed"), F.coalesce("report", F.lit(False)).alias("report"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, o_orderkey) AS place FROM orders""")
def overlay_places(t: Tables) -> DataFrame:
    """SRT-05: documents by day, registration (a missing one first) and id."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("doc_date"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("registered_at"), F.col("o_orderkey").alias("doc_id"))
    return R.numbered(rows, ["o_custkey"], views.overlay_order(), "place").select("o_orderkey", "place")


@query("""
WITH p AS (SELECT DISTINCT rtrim(regexp_replace(url, '^https?://', ''), '/') AS path FROM pages)
SELECT path, row_number() OVER (ORDER BY len(string_split(path, '/')), path) AS place FROM p""")
def tree_places(t: Tables) -> DataFrame:
    """SRT-07: all paths by depth, then by name, without one task that sees them all."""
    paths = t.pages.select(F.rtrim(F.regexp_replace("url", "^https?://", ""), F.lit("/")).alias("path")).distinct()
    return R.ranked(paths, R.tree_order("path"), "place").select("path", "place")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN o_orderdate <= TIMESTAMP '1996-06-01' ELSE o_orderdate > TIMESTAMP '1996-06-01' END AS open FROM orders")
def open_intervals(t: Tables) -> DataFrame:
    """DAT-12: since <= at < until; a missing bound is open."""
    k, at = F.col("o_orderkey") % 3, F.lit("1996-06-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", dates.open_at(F.when(k == 1, F.col("o_orderdate")), F.when(k == 2, F.col("o_orderdate")), at).alias("open"))


@query("""
SELECT t.t AS "table", c.c AS "column" FROM (SELECT 't' || n_nationkey AS t, n_nationkey AS k FROM nation) t, (SELECT unnest(['a', 'b', 'c']) AS c) c WHERE c.c <> 'c' OR k % 2 = 0""")
def ddl_contract(t: Tables) -> DataFrame:
    """VAL-02: tables and columns that CREATE TABLE texts declare."""
    ddl = t.nation.select(F.concat(F.lit("CREATE TABLE IF NOT EXISTS T"), F.translate(_s("n_nationkey"), "0123456789", "abcdefghij"), F.lit(" (a INT, b DECIMAL(5,2)"), F.when(F.col("n_nationkey") % 2 == 0, ", c TEXT").otherwise(""), F.lit(", PRIMARY KEY (a))")).alias("text"))
    found = V.ddl_columns(ddl, "text")
    return found.select(F.concat(F.lit("t"), F.translate(F.substring("table", 2, 9), "abcdefghij", "0123456789")).alias("table"), "column")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' ELSE 'sha256' END AS rule FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'sha256' FROM customer WHERE c_custkey % 4 = 2")
def file_integrity(t: Tables) -> DataFrame:
    """VAL-03: files that are missing, of another size, of another content."""
    k = F.col("c_custkey")
    manifest = t.customer.select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"), F.octet_length("c_name").alias("size"))
    content = F.when(k % 4 == 2, F.concat("c_name", F.lit("!"))).when(k % 4 == 3, F.lower("c_name")).otherwise(F.col("c_name"))
    return V.file_violations(manifest, t.customer.where("c_custkey % 4 <> 1").select("c_custkey", content.cast("binary").alias("content")), "c_custkey")


@query("SELECT o_orderkey, 'no date' AS rule FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'lot id' FROM orders WHERE o_orderkey % 5 = 0")
def fact_check(t: Tables) -> DataFrame:
    """VAL-10: facts with at least one date and a lot's id."""
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 5 == 0, F.concat(F.lit("Lot "), _s(k))).otherwise(F.concat(F.lit("lot_"), _s(k))).alias("lot"), F.when(k % 3 == 1, _s("o_orderdate")).alias("a"), F.when(k % 3 == 2, _s("o_orderdate")).alias("b"))
    return V.violations(rows, "o_orderkey", V.fact_rules(["a", "b"], "lot"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def run_store(t: Tables) -> DataFrame:
    """STM-07: a stream kept as the last row of each key, loaded whole."""
    path = scratch_path(t.spark, "runs")
    schema = t.events.select("user_id", "event_id").schema
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    streams.upsert_batches(rows.select("user_id", "event_id"), f"{path}/table", ["user_id"], [F.desc("event_id")], f"{path}/checkpoint").awaitTermination()
    return streams.load_last(t.spark, f"{path}/table", schema)


@query("""
SELECT 'object' AS kind, 's' || s_suppkey AS cad_number, NULL AS right_number, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'z' || s_suppkey END, 'zone') AS registry_number, s_name AS description, CASE WHEN s_suppkey % 3 = 0 THEN 'act' END AS basis_type FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'right', 'o' || o_orderkey, CAST(o_orderkey AS VARCHAR), NULL, o_orderpriority, NULL FROM orders WHERE o_orderstatus = 'P'""")
def all_restrictions(t: Tables) -> DataFrame:
    """COL-02: restrictions of objects from their JSON lists, and of rights; a malformed list has none."""
    k = F.col("s_suppkey")
    entry = F.struct(F.lit("zone").alias("type"), F.col("s_name").alias("description"), F.when(k % 2 == 0, F.concat(F.lit("z"), _s(k))).alias("registry_number"), F.when(k % 3 == 0, F.struct(F.lit("act").alias("type"))).alias("basis_doc"))
    objects = t.supplier.select(F.concat(F.lit("s"), _s(k)).alias("cad_number"), F.when(k % 5 != 0, F.to_json(F.array(entry))).when(k % 2 == 0, "[broken").alias("object_restrictions"))
    rights = t.orders.select(F.concat(F.lit("o"), _s("o_orderkey")).alias("object_key_value"), F.when(F.col("o_orderstatus") == "P", "restriction").otherwise("right").alias("right_category"), _s("o_orderkey").alias("right_number"), F.col("o_orderpriority").alias("right_type"), *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_until", "beneficiary_inn", "beneficiary_name", "basis")))
    out = views.restrictions({"land_objects": objects.where("cad_number like '%1'"), "building_objects": objects.where("cad_number not like '%1'"), "rights": rights})
    return out.select("kind", "cad_number", "right_number", "registry_number", "description", "basis_type")


@query("""
WITH e AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION ALL SELECT 'AUTOMOBILE WORKS AND SONS'),
 s AS (SELECT c_custkey AS k, upper('group ' || c_mktsegment || ' ' || c_custkey) AS f FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT p_partkey + 1000000, upper(p_type) FROM part UNION ALL SELECT 5000000, 'AUTOMOBILE WORLD')
SELECT name, (SELECT min(k) FROM s WHERE contains(f, upper(name)) OR starts_with(f, substr(upper(name), 1, 10))) AS key FROM e""")
def enterprise_subjects(t: Tables) -> DataFrame:
    """JON-23: the first legal subject whose name contains the enterprise's, or begins as it does."""
    k = F.col("c_custkey")
    own = t.customer.select(k.alias("key"), F.concat(F.lit("group "), "c_mktsegment", F.lit(" "), _s(k)).alias("full"), F.lit(None).cast("string").alias("short"), F.when(k % 3 == 0, "person").alias("kind"))
    more = t.part.select((F.col("p_partkey") + 1_000_000).alias("key"), F.lit(None).cast("string").alias("full"), F.col("p_type").alias("short"), F.lit("legal").alias("kind"))
    one = t.spark.createDataFrame([(5_000_000, "AUTOMOBILE WORLD", None, None)], "key long, full string, short string, kind string")
    subjects = own.unionByName(more).unionByName(one).withColumn("seq", F.col("key"))
    names = t.customer.select(F.col("c_mktsegment").alias("name")).distinct().unionByName(t.spark.createDataFrame([("AUTOMOBILE WORKS AND SONS",)], "name string"))
    return R.enterprise_match(names, "name", subjects, "key", "full", "short", "kind", "seq")


@query("""
WITH o AS (SELECT c_custkey AS id, 'k' || c_custkey AS cad, c_custkey % 4 <> 0 AS placed FROM customer),
 p AS (SELECT o_orderkey AS photo, o_custkey AS c, o_orderkey % 4 AS m FROM orders)
SELECT photo, NULL AS cad, 'exif' AS source FROM p WHERE m = 0 UNION ALL SELECT photo, cad, 'object' FROM p JOIN o ON o.id = c WHERE m = 1 AND placed UNION ALL SELECT photo, cad, 'equipment' FROM p JOIN o ON o.id = c WHERE m = 2 AND placed
UNION ALL SELECT photo, CASE WHEN c % 4 <> 0 THEN 'k' || c ELSE 'k' || (c + 1) END, 'unit' FROM p WHERE m = 3 AND c < (SELECT max(c_custkey) FROM customer)""")
def photo_cascade(t: Tables) -> DataFrame:
    """JON-22: a photo's own place, else the object of its folder: itself, of the equipment, or the unit's first with a place."""
    m, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    last = t.customer.agg(F.max("c_custkey").alias("last"))
    photos = t.orders.select(F.col("o_orderkey").alias("photo"), _pick(m, "cad", "cad", "eq", "bu").alias("kind"), F.concat(_pick(m, "k", "k", "e", "u"), _s(c)).alias("key"), F.when(m == 0, 1.0).alias("lat"))
    objects = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("k"), _s("c_custkey")).alias("cad"), (F.col("c_custkey") % 4 != 0).alias("has_place"))
    equipment = t.customer.select(F.concat(F.lit("e"), _s("c_custkey")).alias("inv"), F.lit(1).alias("seq"), F.col("c_custkey").alias("object_id")).unionByName(t.customer.select(F.concat(F.lit("e"), _s("c_custkey")).alias("inv"), F.lit(2).alias("seq"), F.lit(1).cast("long").alias("object_id")))
    units = t.customer.join(F.broadcast(last), F.col("c_custkey") < F.col("last")).select(F.concat(F.lit("id"), _s("c_custkey")).alias("unit"), F.concat(F.lit("u"), _s("c_custkey")).alias("slug"), F.col("c_custkey").alias("seq"), F.array(F.col("c_custkey"), F.col("c_custkey") + 1).alias("object_ids"))
    return R.photo_objects(photos, objects, equipment, units)


@query("""
WITH f AS (SELECT o_orderkey AS file, o_custkey AS c, o_orderkey % 6 AS m FROM orders), g AS (SELECT c_custkey AS c, 'node' || c_custkey AS node FROM customer WHERE c_custkey % 2 = 0),
 d AS (SELECT f.*, CASE m WHEN 0 THEN 'a' || file WHEN 1 THEN CASE WHEN c % 3 = 0 THEN 'x' || c END END AS doc_id FROM f)
SELECT file, doc_id, CASE WHEN doc_id IS NOT NULL THEN 'doc::' || doc_id WHEN m IN (1, 2) THEN coalesce(node, 'k' || d.c) WHEN m = 3 THEN coalesce(node, 'legal::inn::' || d.c) WHEN m = 4 THEN coalesce(node, 'legal::ogrn::' || d.c) END AS node,
 CASE WHEN doc_id IS NOT NULL THEN 'doc' WHEN m IN (1, 2) THEN 'cad' WHEN m = 3 THEN 'inn' WHEN m = 4 THEN 'ogrn' END AS node_by FROM d LEFT JOIN g ON g.c = d.c""")
def document_cascade(t: Tables) -> DataFrame:
    """JON-25: a file's document by its name, else by object and kind; its node by document, object, tax id, registration id."""
    m, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    files = t.orders.select(F.col("o_orderkey").alias("file"), F.when(m.isin(1, 2), F.concat(F.lit("k"), _s(c))).alias("cad"), _pick(m, "egrn", "egrn", "photo", "photo", "photo", "egrul").alias("kind"), F.when(m == 3, _s(c)).alias("inn"), F.when(m == 4, _s(c)).alias("ogrn"))
    artifacts = t.orders.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("a"), _s("o_orderkey")).alias("doc_id"))
    k = F.col("c_custkey")
    by_extract = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("k"), _s(k)).alias("cad"), F.lit("egrn_extract").alias("kind"), F.concat(F.lit("x"), _s(k)).alias("doc_id"))
    graph = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("k"), _s(k)).alias("cad"), _s(k).alias("inn"), _s(k).alias("ogrn"), F.concat(F.lit("node"), _s(k)).alias("node"))
    return R.document_nodes(files, artifacts, by_extract, graph.select("cad", "node"), graph.select("inn", "node"), graph.select("ogrn", "node"))


@query("""
SELECT p_partkey, ['Москва', 'Ростовская обл.', 'Республика Крым', NULL][p_partkey % 4 + 1] AS region, CASE p_partkey % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'г. ' || p_brand WHEN 2 THEN 'пгт ' || p_brand ELSE 'д. ' || p_brand END AS locality, ['ул. ', 'пр-кт ', 'б-р ', 'наб. '][p_size % 4 + 1] || p_type AS street,
 CASE p_size % 5 WHEN 0 THEN 'д. ' || p_size WHEN 1 THEN p_size || 'А/2' WHEN 2 THEN 'поз. ' || p_size WHEN 3 THEN 'стр. 7' ELSE 'уч. ' || p_size END AS house, 'корп. ' || p_size AS building, CASE p_size % 3 WHEN 0 THEN 'секц. ' || p_size WHEN 1 THEN 'офис 3' END AS room, CASE p_partkey % 3 WHEN 0 THEN 'ЮЗАО' WHEN 1 THEN 'Кировский район' END AS municipality FROM part""")
def address_parts(t: Tables) -> DataFrame:
    """TXT-12: regions, places, streets, houses, buildings and rooms of many kinds."""
    k, n = F.col("p_partkey"), F.col("p_size")
    region = _pick(k % 4, "Москва", "Ростовская обл.", "Республика Крым", "")
    locality = F.when(k % 4 == 0, "").otherwise(F.concat(_pick(k % 4, "", "г. ", "пгт ", "д. "), "p_brand"))
    house = F.when(n % 5 == 0, F.concat(F.lit("д. "), _s(n))).when(n % 5 == 1, F.concat(_s(n), F.lit("А/2"))).when(n % 5 == 2, F.concat(F.lit("поз. "), _s(n))).when(n % 5 == 3, "стр. 7").otherwise(F.concat(F.lit("уч. "), _s(n)))
    room = F.when(n % 3 == 0, F.concat(F.lit("секц. "), _s(n))).when(n % 3 == 1, "офис 3").otherwise("")
    raw = F.concat_ws(", ", region, locality, _pick(k % 3, "ЮЗАО", "Кировский район", ""), F.concat(_pick(n % 4, "ул. ", "пр-кт ", "б-р ", "наб. "), "p_type"), F.concat(F.lit("корп. "), _s(n)), house, room)
    c = address.components(raw)
    return t.part.select("p_partkey", *(c[x].alias(x) for x in ("region", "locality", "street", "house", "building", "room", "municipality")))


@query("""
SELECT c_custkey, 'ПАО ' || c_name AS extract_form, 'Публичное АО ' || c_name AS workbook_form, CASE WHEN c_custkey % 2 = 0 THEN 'Публичное акционерное общество' ELSE 'Товарищество собственников жилья' END AS ledger_form FROM customer""")
def organisation_forms(t: Tables) -> DataFrame:
    """TXT-06: the same name by the lists of extracts, workbooks and ledgers, of which the order decides."""
    long = F.concat(F.lit("Публичное акционерное общество "), "c_name")
    return t.customer.select("c_custkey", text.short_form(long).alias("extract_form"), text.short_form_exact(long).alias("workbook_form"), text.legal_form(F.concat(F.when(F.col("c_custkey") % 2 == 0, "ПАО «").otherwise('тсж "'), "c_name")).alias("ledger_form"))
