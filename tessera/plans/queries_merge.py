"""Merges, upserts, provenance, bundles and checks over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import content_hash
from tessera.operators import merge as M
from tessera.operators import schema as X
from tessera.operators import validate as V
from tessera.plans.registry import Tables, query
from tessera.sources import sinks


@query("""
WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_acctbal * 1.00005 ELSE s_acctbal * 1.01 END AS bal, CASE WHEN s_suppkey % 4 = 0 THEN s_name || ' x' WHEN s_suppkey % 7 = 0 THEN ' ' || s_name ELSE s_name END AS name FROM supplier)
SELECT s_suppkey, 's_acctbal' AS field FROM supplier JOIN n USING (s_suppkey) WHERE bal IS NOT NULL AND abs(s_acctbal - bal) / greatest(abs(s_acctbal), abs(bal), 1e-9) > 0.0001
UNION ALL SELECT s_suppkey, 's_name' FROM supplier JOIN n USING (s_suppkey) WHERE trim(s_name) <> trim(name)""")
def diff_fields(t: Tables) -> DataFrame:
    """MRG-17, MTH-04."""
    k = F.col("s_suppkey")
    new = t.supplier.select("s_suppkey", F.when(k % 5 == 0, None).when(k % 3 == 0, F.col("s_acctbal") * 1.00005).otherwise(F.col("s_acctbal") * 1.01).alias("s_acctbal"), F.when(k % 4 == 0, F.concat("s_name", F.lit(" x"))).when(k % 7 == 0, F.concat(F.lit(" "), "s_name")).otherwise(F.col("s_name")).alias("s_name"))
    return M.field_diff(t.supplier.select("s_suppkey", "s_acctbal", "s_name"), new, "s_suppkey", ["s_acctbal"], ["s_name"]).select("s_suppkey", "field")


_UPSERT = """
WITH o AS (SELECT c_custkey, c_name, c_mktsegment, md5(c_name || c_mktsegment) AS h FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg, c_mktsegment FROM customer) WHERE c_custkey % 3 <> 0),
 n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '!' END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_custkey IS NULL THEN 'inserted' WHEN o.h = md5(n.c_name || n.c_mktsegment) THEN 'skipped' ELSE 'replaced' END AS action,
 CASE WHEN n.c_custkey IS NULL THEN o.c_name WHEN o.c_custkey IS NULL THEN n.c_name WHEN o.h = md5(n.c_name || n.c_mktsegment) THEN o.c_name ELSE n.c_name END AS c_name
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"""


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.md5(F.concat("c_name", "c_mktsegment").cast("binary")))


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    old = _hashed(c.where("c_custkey % 3 <> 0"))
    new = _hashed(c.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("!")))))
    return old, new


@query(_UPSERT)
def upsert_actions(t: Tables) -> DataFrame:
    """MRG-01, policy replace."""
    return M.upsert(*_old_new(t), "c_custkey", "h").select("c_custkey", "action", "c_name")


@query(_UPSERT.replace("'replaced'", "'enriched'").replace("ELSE n.c_name END AS c_name", "WHEN o.c_custkey % 3 = 1 THEN n.c_name ELSE o.c_name END AS c_name"))
def upsert_agreed(t: Tables) -> DataFrame:
    """MRG-01, policy ask_enrich: only the fields that were agreed to."""
    agreed = t.customer.where("c_custkey % 3 = 1").select("c_custkey", F.lit("c_name").alias("field"))
    return M.upsert(*_old_new(t), "c_custkey", "h", "ask_enrich", accepted=agreed).select("c_custkey", "action", "c_name")


@query(_UPSERT[: _UPSERT.index("SELECT coalesce(o.c_custkey")] + """
SELECT n.c_custkey, 'created' AS event, '' AS fields FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)
UNION ALL SELECT n.c_custkey, 'modified', 'c_name' FROM n JOIN o ON o.c_custkey = n.c_custkey WHERE o.c_name <> n.c_name""")
def upsert_events(t: Tables) -> DataFrame:
    """MRG-01: what an upsert says it did."""
    old, new = _old_new(t)
    return M.upsert_events(old, new, "c_custkey", "h", [], ["c_name", "c_mktsegment"]).select("c_custkey", "event", F.array_join("fields", ",").alias("fields"))


@query("""
WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber <> 2 THEN l_orderkey || '-' || l_linenumber END AS number FROM lineitem)
SELECT 'extracts' AS "table", count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'objects', count(*), count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'rights', count(DISTINCT coalesce(number, o || '/' || n)), count(DISTINCT number) FROM r UNION ALL SELECT 'holders', count(DISTINCT l_orderkey || '-' || l_linenumber || 'ООО s' || l_suppkey), count(DISTINCT l_suppkey) FROM lineitem""")
def parsed_results(t: Tables) -> DataFrame:
    """MRG-15: parsed documents into a store that holds a part of them already, written as a version of what they change and read back."""
    from tessera.scratch import scratch_path

    number = F.when(F.col("l_linenumber") != 2, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    extracts = t.orders.select(F.col("o_orderkey").cast("string").alias("extract_number"), F.col("o_orderkey").alias("cad"), F.col("o_orderdate").cast("string").alias("extract_date"))
    objects = t.orders.select(F.col("o_orderkey").alias("cad"), "o_totalprice", F.md5(F.col("o_totalprice").cast("string").cast("binary")).alias("content_hash"))
    rights = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("ref"), F.col("l_orderkey").alias("cad"), number.alias("right_number"))
    holders = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("ref"), F.lit("legal_entity").alias("holder_type"), F.concat(F.lit("Общество с ограниченной ответственностью s"), F.col("l_suppkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("inn"))
    parsed = {"extracts": extracts, "objects": objects, "rights": rights, "holders": holders}
    empty = {"extracts": extracts.limit(0), "objects": objects.limit(0), "rights": rights.limit(0).select(F.lit("").alias("right_id"), "cad", "right_number"), "holders": holders.limit(0).select(F.lit("").alias("right_id"), "holder_type", "name", "inn")}
    folder = scratch_path(t.spark, "store")
    # half of the orders first; then all of them, of which that half is known
    half = lambda df, key: df.where(F.pmod(F.element_at(F.split(F.col(key).cast("string"), "/"), 1).cast("long"), F.lit(2)) == 0)
    first = {"extracts": half(extracts, "cad"), "objects": half(objects, "cad"), "rights": half(rights, "ref").where("right_number is not null"), "holders": half(holders, "ref")}
    M.commit(M.parsed_changes(empty, first, "cad"), folder, 1)
    M.commit(M.parsed_changes(M.last_committed(t.spark, folder, {"objects": "cad"}), parsed, "cad"), folder, 2)
    out = M.last_committed(t.spark, folder, {"objects": "cad"})
    counted = lambda name, key: out[name].agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    holder = F.regexp_extract("name", r"^ООО (s\d+)$", 1)
    return reduce(DataFrame.unionByName, [counted("extracts", F.col("cad")), counted("objects", F.col("cad")), counted("rights", F.col("right_number")), counted("holders", F.nullif(holder, F.lit("")))])


@query(_UPSERT.replace("'replaced'", "'enriched'").replace("THEN o.c_name ELSE n.c_name END", "THEN o.c_name ELSE coalesce(o.c_name, n.c_name) END"))
def upsert_enrich(t: Tables) -> DataFrame:
    """MRG-01, policy enrich: only what is missing is filled."""
    return M.upsert(*_old_new(t), "c_custkey", "h", "enrich").select("c_custkey", "action", "c_name")


@query("""
WITH v AS (SELECT p_partkey AS k, 'name' AS field, p_name AS v, 'egrn' AS s, 4 AS p, 1 AS seq FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT p_partkey, 'name', upper(p_name), 'nspd', 3, 2 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'name', CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE p_brand END, 'kml', 2, 3 FROM part),
 u AS (SELECT * FROM v WHERE v IS NOT NULL AND v NOT IN ('', '-')), w AS (SELECT k, field, v, s, row_number() OVER (PARTITION BY k, field ORDER BY p DESC, seq) AS rn FROM u)
SELECT w.k, w.field, w.v AS value, w.s AS source, (SELECT count(*) FROM u WHERE u.k = w.k AND u.v <> w.v) AS variants FROM w WHERE rn = 1""")
def priority_merge(t: Tables) -> DataFrame:
    """MRG-03/06: three sources with gaps."""
    p = t.part.select(F.col("p_partkey").alias("k"), "p_name", "p_brand")
    src = lambda cond, v, kind, seq: p.where(cond).select("k", F.lit("name").alias("field"), v.alias("value"), F.lit(kind).alias("source"), M.priority(F.lit(kind)).alias("rank"), F.lit(seq).alias("seq"))
    rows = src("k % 3 <> 0", F.col("p_name"), "egrn", 1).unionByName(src("k % 2 = 0", F.upper("p_name"), "nspd", 2)).unionByName(src("true", F.when(F.col("k") % 7 == 0, "-").otherwise(F.col("p_brand")), "kml", 3))
    return M.priority_merge(rows, "k", "field", "value", "source", "rank", "seq").withColumn("variants", F.size("variants").cast("long"))


@query("""
WITH v AS (SELECT user_id AS k, event_type AS field, CAST(value AS VARCHAR) AS v, event_id AS seq, CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS score, ts FROM events)
SELECT k, field, seq AS source FROM (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY score DESC, ts DESC, seq) AS rn FROM v) WHERE rn = 1""")
def score_merge(t: Tables) -> DataFrame:
    """MRG-04: score, then the newest, then the one that stood before."""
    e = t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("source"), F.struct(F.when(F.col("event_type") == "view", 1).otherwise(2).alias("score"), "ts").alias("rank"), F.col("event_id").alias("seq"))
    return M.priority_merge(e, "k", "field", "value", "source", "rank", "seq").select("k", "field", "source")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, upper(p_name)) AS name, coalesce(CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END, CASE WHEN p_partkey % 5 <> 0 THEN 'b' END) AS brand,
 CASE WHEN (p_partkey % 3 = 0) OR (p_partkey % 2 = 0 AND p_partkey % 5 <> 0) THEN CASE WHEN p_partkey % 4 = 0 THEN 'osv' ELSE 'egrn | osv' END ELSE CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'egrn' END END AS source FROM part""")
def fill_missing(t: Tables) -> DataFrame:
    """MRG-02."""
    k = F.col("p_partkey")
    old = t.part.select("p_partkey", F.when(k % 3 != 0, F.col("p_name")).alias("name"), F.when(k % 2 != 0, F.col("p_brand")).alias("brand"), F.when(k % 4 != 0, "egrn").alias("source"))
    new = t.part.select("p_partkey", F.upper("p_name").alias("name"), F.when(k % 5 != 0, "b").alias("brand"), F.lit("osv").alias("source"))
    return M.fill_missing(old, new, "p_partkey", ["name", "brand"], "source")


@query("""
SELECT p_partkey, coalesce(nm, CASE WHEN p_partkey % 5 <> 0 THEN 'n' END) AS name, CASE WHEN p_partkey % 5 <> 0 AND nm IS NULL THEN 'name' ELSE '' END AS filled, CASE WHEN p_partkey % 5 = 0 THEN 'no source' WHEN nm IS NOT NULL THEN 'nothing to fill' END AS skipped
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS nm FROM part)""")
def gap_fill(t: Tables) -> DataFrame:
    """MRG-07."""
    old = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"))
    found = t.part.where("p_partkey % 5 <> 0").select("p_partkey", F.lit("n").alias("name"))
    return M.gap_fill(old, found, "p_partkey", ["name"]).withColumn("filled", F.array_join("filled", ","))


@query("SELECT c_custkey AS k, (c_custkey % 3 <> 0) AS noop FROM customer")
def noop_detection(t: Tables) -> DataFrame:
    """MRG-05."""
    before = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    return M.is_noop(before.withColumn("c_name", F.when(F.col("k") % 3 == 0, "x").otherwise(F.col("c_name"))), before, "k", ["c_name"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1")
def replace_rows(t: Tables) -> DataFrame:
    """MRG-08: the rows of restated keys are new ones only."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = rows.where("l_orderkey % 4 = 0 and l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return M.replace_rows(rows, fresh, "l_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'no_parent' WHEN o_orderkey % 3 = 0 OR rn > 1 THEN 'exists' ELSE 'insert' END AS outcome FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS rn FROM orders)""")
def bundle_import(t: Tables) -> DataFrame:
    """MRG-09: insert if absent, with a guard for parents."""
    rows = t.orders.select("o_orderkey", "o_custkey")
    return M.bundle_import(rows, rows.where("o_orderkey % 3 = 0"), ["o_orderkey"], t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", [F.col("o_custkey")]).select("o_orderkey", "outcome")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 7 = 0) GROUP BY 1, 2")
def insert_absent(t: Tables) -> DataFrame:
    """MRG-10/16."""
    e = t.events.select("user_id", "event_type", "event_id")
    return M.insert_absent(e.where("event_id % 7 = 0"), e, ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def register_entities(t: Tables) -> DataFrame:
    """MRG-11: absent ones are added, blank names filled."""
    old = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return M.register_entities(old, t.customer.select("c_custkey", F.upper("c_name").alias("name")), "c_custkey", "name")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'unified' WHEN c_custkey % 2 = 0 THEN 'plain' ELSE c_mktsegment END AS kind FROM customer""")
def guarded_update(t: Tables) -> DataFrame:
    """MRG-12: a unified parcel stays one."""
    k = F.col("c_custkey")
    old = t.customer.select("c_custkey", F.when(k % 6 == 0, "unified").otherwise(F.col("c_mktsegment")).alias("kind"))
    new = t.customer.select("c_custkey", F.when(k % 2 == 0, "plain").alias("kind"))
    return M.coalesce_update(old, new, "c_custkey", ["kind"], {"kind": ["unified"]})


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 'note' WHEN c_custkey % 3 = 0 THEN 'mine' END AS note FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 <> 0""")
def preserve_confirmed(t: Tables) -> DataFrame:
    """MRG-13."""
    k = F.col("c_custkey")
    old = t.customer.select("c_custkey", "c_name", F.when(k % 4 == 0, "note").when(k % 3 == 0, "mine").alias("note"), (k % 4 == 0).alias("ok"))
    new = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("ok"))
    return M.preserve_confirmed(old, new, "c_custkey", "ok", ["note"]).select("c_custkey", "c_name", "note")


@query("""
WITH r AS (SELECT CASE WHEN l_linenumber = 1 THEN 'cad:' || l_partkey WHEN l_linenumber = 2 THEN 'inv:' || l_suppkey ELSE 'name|' || lower(l_returnflag) || '|' || lower(l_linestatus) END AS asset, l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS seq, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END AS q, l_suppkey FROM lineitem)
SELECT asset, min_by(q, seq) FILTER (q IS NOT NULL) AS q, count(DISTINCT l_suppkey) AS holders FROM r GROUP BY 1""")
def accumulate_assets(t: Tables) -> DataFrame:
    """MRG-14."""
    n = F.col("l_linenumber")
    rows = t.lineitem.select(F.when(n == 1, F.col("l_partkey").cast("string")).alias("cad"), F.when(n == 2, F.col("l_suppkey").cast("string")).alias("inv"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("address"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity")).alias("q"), F.col("l_suppkey").alias("holder"), F.lit("osv").alias("source"))
    return M.accumulate_assets(rows, "cad", "inv", "name", "address", "seq", ["q"], "holder", "source").select("asset", "q", F.size("holders").cast("long").alias("holders"))


@query("""
SELECT o_custkey AS object, CASE WHEN o_orderkey % 2 = 0 THEN 'n:' || o_orderkey ELSE 't:' || substr(sha1(o_orderstatus || chr(0) || lower(o_orderpriority) || chr(0)), 1, 16) END AS k, count(DISTINCT o_orderpriority) AS holders FROM orders GROUP BY 1, 2""")
def merge_rights(t: Tables) -> DataFrame:
    """AGG-19, MRG-18, MTH-05."""
    key = M.right_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")))
    rows = t.orders.select(F.col("o_custkey").alias("object"), key.alias("k"), F.col("o_orderpriority").alias("holder"), F.lit("egrn").alias("source"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return M.merge_rights(rows, ["object", "k"], "holder", "source", "seq", ["o_orderstatus"]).select("object", "k", F.size("holders").cast("long").alias("holders"))


@query("""
SELECT c_custkey, coalesce('legal::ogrn::' || CASE WHEN c_custkey % 4 = 0 THEN c_custkey END, 'legal::inn::' || CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, 'person::' || substr(sha1(lower(trim(c_name)) || chr(0)), 1, 16)) AS k FROM customer""")
def beneficiary_keys(t: Tables) -> DataFrame:
    """MRG-19."""
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", M.beneficiary_key(F.when(k % 4 == 0, k.cast("string")), F.when(k % 3 == 0, F.col("c_nationkey").cast("string")), F.col("c_name")).alias("k"))


@query("SELECT p_partkey, sha256('=' || p_name || chr(31) || CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '=' || p_brand END || chr(31) || '=' || p_size) AS h FROM part")
def content_hashes(t: Tables) -> DataFrame:
    """MTH-06."""
    return t.part.select("p_partkey", content_hash(F.col("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.col("p_size")).alias("h"))


@query("""
SELECT 'customer' AS "table", 'c_phone' AS "column", 'missing column' AS problem UNION ALL SELECT 'customer', 'c_acctbal', 'double for string' UNION ALL SELECT 'partsupp', NULL, 'missing table'""")
def schema_check(t: Tables) -> DataFrame:
    """VAL-01."""
    return V.schema_violations(t.spark, {"customer": t.customer}, {"customer": {"c_custkey": "bigint", "c_phone": "string", "c_acctbal": "string"}, "partsupp": {"ps_partkey": "bigint"}})


@query("""
SELECT c_custkey, 'negative balance' AS rule FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 10000 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'name' FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0000000[0-9]+$')""")
def integrity_check(t: Tables) -> DataFrame:
    """VAL-05."""
    return V.violations(t.customer, "c_custkey", {"negative balance": V.range_rule("c_acctbal", 0, 10000), "segment": V.enum_rule("c_mktsegment", ["BUILDING", "MACHINERY"]), "name": V.id_rule("c_name", r"^Customer#0000000[0-9]+$")})


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return V.duplicates(t.lineitem, ["l_partkey", "l_suppkey"])


@query("""
SELECT s_suppkey, 'inn' AS rule FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'account' FROM supplier WHERE s_suppkey % 5 = 0""")
def requisites_check(t: Tables) -> DataFrame:
    """VAL-06: numbers of digits."""
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.lpad(k.cast("string"), F.when(k % 3 == 0, 11).otherwise(10), F.lit("0")).alias("inn"), F.lpad(k.cast("string"), F.when(k % 5 == 0, 19).otherwise(20), F.lit("0")).alias("account"))
    return V.violations(rows, "s_suppkey", V.requisite_rules(["inn", "account"]))


@query("""
SELECT o_orderkey, 'id_prefix' AS rule FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'doc_date' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'op' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'target' FROM orders WHERE o_orderkey % 11 = 0""")
def documents_check(t: Tables) -> DataFrame:
    """VAL-04, COL-06."""
    k = F.col("o_orderkey")
    effect = F.struct(F.when(k % 7 == 0, "drop").otherwise("add").alias("op"), F.when(k % 11 == 0, "objects.x").otherwise("objects[id=1].rights").alias("target"))
    rows = t.orders.select("o_orderkey", F.concat(F.when(k % 3 == 0, "doc_").otherwise("act_"), k.cast("string")).alias("doc_id"), F.lit("act").alias("kind"), F.when(k % 5 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("doc_date"), F.array(effect).alias("effects"))
    return V.violations(rows, "o_orderkey", V.document_rules("doc_id"))


@query("SELECT o_orderkey, 'orphan right' AS rule FROM orders WHERE o_custkey % 10 = 0")
def store_check(t: Tables) -> DataFrame:
    """VAL-08."""
    objects = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = V.store_violations(objects, t.orders.select("o_custkey"), "o_custkey", ["c_name"])
    return t.orders.select("o_orderkey", "o_custkey").join(found.distinct(), "o_custkey").select("o_orderkey", "rule")


@query("SELECT event_id, 'value' AS rule FROM events WHERE event_type = 'view' AND user_id % 2 = 1 UNION ALL SELECT event_id, 'namespace' FROM events WHERE event_type NOT IN ('view', 'click')")
def tag_check(t: Tables) -> DataFrame:
    """VAL-07."""
    tags = t.events.select("event_id", F.col("event_type").alias("namespace"), (F.col("user_id") % 2).cast("string").alias("value"))
    return V.violations(tags, "event_id", V.tag_rules({"view": ["0"], "click": None}))


@query("SELECT count(*) AS rows FROM orders")
def bundle_digest(t: Tables) -> DataFrame:
    """SNK-04: the digest doesn't depend on order or partitions; here two of them agree."""
    a, b = sinks.table_digest(t.orders), sinks.table_digest(t.orders.repartition(7))
    return a.join(b.select("digest"), "digest").select("rows")


@query("SELECT '| ' || c_custkey || ' | ' || CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '\\|x' ELSE '' END || ' | ' || c_name || ' |' AS value FROM customer")
def markdown_report(t: Tables) -> DataFrame:
    """SNK-07: rows as lines of a table; bars inside cells are escaped, missing values empty."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit("|x"))).alias("kind"), "c_name")
    return sinks.markdown_table(rows, ["c_custkey", "kind", "c_name"])


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS lenient FROM events""")
def json_props(t: Tables) -> DataFrame:
    """PRJ-04/05: a field of JSON text; malformed text gives NULL."""
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_variant_get(F.try_parse_json(broken), "$.k", "bigint").alias("lenient"))


@query("SELECT 'event' AS doc, CAST(event_id AS VARCHAR) AS k, json_extract_string(props, '$.k') AS inner, CASE WHEN event_id % 5 = 0 THEN 'null' END AS bad FROM events")
def dump_rows(t: Tables) -> DataFrame:
    """SNK-02: every event as JSON, its JSON text as an object, malformed text as null; read back by key."""
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.lit("{}"))
    lines = sinks.dump(t.events.select(F.lit("event").alias("doc"), "event_id", "props", broken.alias("bad")), ["props", "bad"])
    field = lambda p: F.get_json_object("value", p)
    return lines.select(field("$.doc").alias("doc"), field("$.event_id").alias("k"), field("$.props.k").alias("inner"), F.when(F.col("value").contains('"bad":null'), "null").alias("bad"))


@query("SELECT 'customer' AS doc, CAST(c_custkey AS VARCHAR) AS k FROM customer")
def dump_all_rows(t: Tables) -> DataFrame:
    """SNK-02: every row as JSON read back by key."""
    lines = sinks.dump(t.customer.select(F.lit("customer").alias("doc"), "c_custkey", F.lit('{"a":1}').alias("extra")), ["extra"])
    return lines.where(F.get_json_object("value", "$.extra.a") == "1").select(F.get_json_object("value", "$.doc").alias("doc"), F.get_json_object("value", "$.c_custkey").alias("k"))


@query("SELECT folder, count(*) AS files, count(*) FILTER (n > 1000) AS long FROM (SELECT unnest([source, source || '/' || lang]) AS folder, n_chars AS n FROM documents) GROUP BY 1")
def folder_report(t: Tables) -> DataFrame:
    """SNK-09, AGG-09: every file counts in each folder above it."""
    files = t.documents.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "n_chars")
    return sinks.folder_report(files, "path", {"long": F.col("n_chars") > 1000})


INVOICE = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
 <xs:simpleType name="Tin"><xs:restriction base="xs:string"><xs:pattern value="\\d{10}"/><xs:pattern value="\\d{12}"/></xs:restriction></xs:simpleType>
 <xs:complexType name="Party"><xs:choice><xs:element name="tin" type="Tin"/><xs:element name="name" type="xs:string"/></xs:choice></xs:complexType>
 <xs:element name="invoice"><xs:complexType><xs:sequence>
  <xs:element name="day" type="xs:date"/><xs:element name="seller" type="Party"/><xs:element name="buyer" type="Party" minOccurs="0"/>
  <xs:element name="line" maxOccurs="unbounded"><xs:complexType><xs:sequence>
   <xs:element name="quantity"><xs:simpleType><xs:restriction base="xs:decimal"><xs:minInclusive value="1"/><xs:maxInclusive value="40"/></xs:restriction></xs:simpleType></xs:element>
   <xs:element name="flag"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="A"/><xs:enumeration value="N"/></xs:restriction></xs:simpleType></xs:element>
  </xs:sequence><xs:attribute name="number" use="required"/></xs:complexType></xs:element>
 </xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS bad FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT k AS o_orderkey, '/invoice/day' AS path, 'text' AS rule FROM o WHERE bad = 1 UNION ALL SELECT k, '/invoice/seller', 'children' FROM o WHERE bad = 2 UNION ALL SELECT k, '/invoice', 'children' FROM o WHERE bad IN (3, 4)
UNION ALL SELECT k, '/invoice/seller/tin', 'text' FROM o WHERE bad = 5 UNION ALL SELECT k, NULL, 'not well-formed' FROM o WHERE bad = 6
UNION ALL SELECT l_orderkey, '/invoice/line/quantity', 'bounds' FROM lineitem JOIN o ON k = l_orderkey WHERE l_quantity > 40 AND bad <> 6 UNION ALL SELECT l_orderkey, '/invoice/line/flag', 'listed' FROM lineitem JOIN o ON k = l_orderkey WHERE l_returnflag = 'R' AND bad <> 6
UNION ALL SELECT l_orderkey, '/invoice/line', 'attribute missing: number' FROM lineitem JOIN o ON k = l_orderkey WHERE l_linenumber = 3 AND bad <> 6""")
def invoice_check(t: Tables) -> DataFrame:
    """VAL-09: an invoice for each order with its lines against a schema; each breach by path and rule."""
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("<line"), F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit(' number="'), text("l_linenumber"), F.lit('"'))), F.lit("><quantity>"), text("l_quantity"), F.lit("</quantity><flag>"), F.col("l_returnflag"), F.lit("</flag></line>"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(line), "").alias("lines"))
    bad = F.col("o_orderkey") % 7
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    party = lambda name, inside: F.concat(F.lit(f"<{name}>"), inside, F.lit(f"</{name}>"))
    tin = F.when(bad == 5, "12345").otherwise("1234567890")
    seller = party("seller", F.when(bad == 2, "<tin>1234567890</tin><name>A</name>").otherwise(F.concat(F.lit("<tin>"), tin, F.lit("</tin>"))))
    buyer = F.when(bad == 3, "<buyer><name>B</name></buyer><buyer><name>C</name></buyer>").when(bad == 0, "").otherwise("<buyer><name>B</name></buyer>")
    body = F.concat(F.when(bad == 4, "").otherwise(F.concat(F.lit("<day>"), F.when(bad == 1, F.concat(day, F.lit("T1"))).otherwise(day), F.lit("</day>"))), seller, buyer, "lines")
    documents = t.orders.join(lines, "o_orderkey").select("o_orderkey", F.concat(F.lit("<invoice>"), body, F.when(bad == 6, "").otherwise("</invoice>")).alias("xml"))
    return X.breaches(documents, "xml", INVOICE).select("o_orderkey", "path", "rule")
