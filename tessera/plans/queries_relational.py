"""Scans, joins, aggregates, windows and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import aggregates as A
from tessera.operators import matching
from tessera.operators import relational as R
from tessera.plans.registry import Tables, query


@query("""
SELECT 's' || s_suppkey AS id, 'supplier' AS class, s_name AS name, n_name AS nation, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, n_name, c_acctbal, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def v_all_objects(t: Tables) -> DataFrame:
    """SET-01, PRJ-01: two tables conformed to one schema."""
    n = F.broadcast(t.nation.select("n_nationkey", F.col("n_name").alias("nation")))  # a fixed list
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("class"), F.col("s_name").alias("name"), "nation", F.col("s_acctbal").alias("balance"))
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("class"), F.col("c_name").alias("name"), "nation", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return R.conformed(s, c)


@query("""
SELECT o_orderkey, l_linenumber, l_suppkey AS holder, coalesce(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '1') || '/' || coalesce(CAST(total AS VARCHAR), '1') AS share_text,
 CASE WHEN total <> 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '/' || CAST(total AS VARCHAR) END AS share_or_null
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1) ON k = o_orderkey""")
def v_rights_full(t: Tables) -> DataFrame:
    """JON-01, PRJ-03: rights with 0..n holders and their shares."""
    q = F.col("l_quantity").cast("long")
    total = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(q).alias("total"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", q.alias("q"))
    out = t.orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(total, F.col("o_orderkey") == F.col("k"), "left")
    return out.select("o_orderkey", "l_linenumber", F.col("l_suppkey").alias("holder"), values.share_text(F.col("q"), F.col("total")).alias("share_text"), values.share_or_null(F.col("q"), F.col("total")).alias("share_or_null"))


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_1_urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS n_5_low,
 CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_order, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, max(o_totalprice) AS top_price
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def dossier(t: Tables) -> DataFrame:
    """JON-05, AGG-02/03: subqueries per row as one pre-aggregation."""
    own = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("orders"),
        *A.counts_by("o_orderpriority", ["1-URGENT", "5-LOW"]),
        F.max("o_orderdate").cast("date").cast("string").alias("last_order"),
        F.array_join(A.sorted_set("o_orderpriority"), "; ").alias("priorities"),
        F.max("o_totalprice").alias("top_price"),
    )
    zero = ["orders", "n_1_urgent", "n_5_low"]
    return t.customer.select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").fillna(0, zero)


@query("""
SELECT o_orderkey, c_name, n_name, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'active' ELSE 'ended' END AS status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def lease_status(t: Tables) -> DataFrame:
    """JON-02, FLT-09: the lease list: rights, holders and objects; an end on the day itself is still valid."""
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    c = t.customer.select("c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    valid = R.still_valid(F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp_ntz"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name", F.when(valid, "active").otherwise("ended").alias("status"))


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, q / sum(q) OVER (PARTITION BY l_partkey) AS ratio FROM s)
SELECT l_partkey, l_suppkey, round(top, 6) AS ratio FROM (
 SELECT l_partkey, l_suppkey, max(ratio) OVER (PARTITION BY l_partkey) AS top, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN max_r - ratio <= 1e-9 THEN 0 ELSE 1 END, l_suppkey) AS rn
 FROM (SELECT *, max(ratio) OVER (PARTITION BY l_partkey) AS max_r FROM r)) WHERE rn = 1""")
def direct_owner(t: Tables) -> DataFrame:
    """AGG-04: the owner with the largest share; equal shares go to the smallest id."""
    q = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    whole = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))
    shares = q.join(whole, "l_partkey").withColumn("ratio", F.col("q") / F.col("total"))
    return A.direct_owner(shares, "l_partkey", "l_suppkey", "ratio").withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_partkey, round(1 - product(1 - least(greatest(l_discount, 0), 1)), 4) AS confidence FROM lineitem GROUP BY l_partkey")
def noisy_or_confidence(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(A.noisy_or(F.col("l_discount")).alias("confidence"))


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY 1")
def latest_extract(t: Tables) -> DataFrame:
    return A.latest(t.orders, "o_custkey", "o_orderdate").withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query("SELECT event_id, nullif(event_type, 'view') AS code FROM events WHERE nullif(event_type, 'view') NOT IN ('click', 'error')")
def nullable_not_in(t: Tables) -> DataFrame:
    """FLT-04: a NULL code falls away."""
    code = F.nullif("event_type", F.lit("view"))
    return t.events.select("event_id", code.alias("code")).where(~F.col("code").isin("click", "error"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%er#00000010%' OR lower(c_mktsegment) LIKE '%er#00000010%'")
def catalog_search(t: Tables) -> DataFrame:
    """FLT-07."""
    return R.contains_any(t.customer, "ER#00000010", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_list(t: Tables) -> DataFrame:
    """FLT-01/03."""
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE (p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%') AND split_part(p_name, ' ', -1) = (SELECT min(split_part(p_name, ' ', -1)) FROM part)")
def affix_filters(t: Tables) -> DataFrame:
    """FLT-05/06: two beginnings; the last part of a name as an equality."""
    tail = F.element_at(F.split("p_name", " "), -1)
    least = t.part.agg(F.min(tail).alias("least"))
    named = t.part.where(F.col("p_type").startswith("STANDARD") | F.col("p_type").startswith("SMALL")).withColumn("tail", tail)
    return named.join(F.broadcast(least), F.col("tail") == F.col("least")).select("p_partkey", "p_type")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS known FROM events
WHERE event_id % 3 = 0 OR ts <= TIMESTAMP '2024-01-10'""")
def as_of_bound(t: Tables) -> DataFrame:
    """FLT-08: no date passes."""
    known = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return t.events.where(R.as_of(known, F.lit("2024-01-10").cast("timestamp_ntz"))).select("event_id", F.date_format(known, "yyyy-MM-dd").alias("known"))


@query("""
WITH g AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'signup' THEN NULL ELSE ts + INTERVAL 5 DAY END AS expires FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM g WHERE user_id = c_custkey AND (expires IS NULL OR expires > TIMESTAMP '2024-01-20')) AND c_custkey NOT IN (3, 5)""")
def grants_filter(t: Tables) -> DataFrame:
    """FLT-13, JON-11."""
    grants = t.events.where(F.col("event_type").isin("signup", "purchase")).select(F.lit("u").alias("subject"), F.col("user_id").alias("resource_id"), F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("expires_at"))
    return R.allowed(t.customer, grants, "u", F.lit("2024-01-20").cast("timestamp_ntz"), "c_custkey", denied=[3, 5]).select("c_custkey", "c_name")


@query("""
SELECT r_name, n_name, count(c_custkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def nation_roles(t: Tables) -> DataFrame:
    """JON-03/04: roles of a small table joined by name."""
    n = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""
SELECT event_id, user_id, CASE WHEN user_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) THEN 'first' WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'second' ELSE 'unknown' END AS parent_kind FROM events""")
def parent_fallback(t: Tables) -> DataFrame:
    """JON-06: the parent in one table, else in another."""
    s = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"))
    c = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return R.with_fallback(t.events.select("event_id", "user_id"), "user_id", s, c, "k")


@query("""
WITH s AS (SELECT split_part(s_name, '#', 2) AS tail, min(s_name) AS matched, count(*) AS n FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN matched END AS matched FROM customer LEFT JOIN s ON tail = split_part(c_name, '#', 2)""")
def suffix_match(t: Tables) -> DataFrame:
    """JON-07."""
    c = t.customer.select("c_custkey", F.element_at(F.split("c_name", "#"), -1).alias("tail"))
    return R.by_tail(c, "tail", t.supplier, "s_name", "#").select("c_custkey", "matched")


@query("""
SELECT p_partkey, matched FROM part LEFT JOIN (SELECT split_part(p_name, ' ', -1) AS tail, min(p_name) AS matched FROM part WHERE p_size > 25 GROUP BY 1) ON tail = split_part(p_name, ' ', -1)""")
def first_suffix(t: Tables) -> DataFrame:
    """JON-08: no rule of uniqueness."""
    p = t.part.select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("tail"))
    return R.by_tail(p, "tail", t.part.where("p_size > 25"), "p_name", " ", unique=False).select("p_partkey", "matched")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def orphan_rows(t: Tables) -> DataFrame:
    """JON-09, SET-02."""
    return R.orphans(t.events.select("event_id", "user_id"), "user_id", (t.supplier.where("s_suppkey % 2 = 0"), "s_suppkey"), (t.customer.where("c_custkey % 3 = 0"), "c_custkey"))


@query("""
WITH a AS (SELECT DISTINCT c_mktsegment AS seg, o_custkey AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 <> 0), b AS (SELECT c_mktsegment AS seg, c_custkey AS k FROM customer WHERE c_custkey % 10 <> 0)
SELECT seg, k, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT seg, k, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def reconcile(t: Tables) -> DataFrame:
    """JON-10: what only one side has, by account."""
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"))
    a = t.orders.where("o_orderkey % 7 <> 0").join(c, F.col("o_custkey") == F.col("c_custkey")).select("seg", F.col("o_custkey").alias("k"))
    return R.reconcile(a, c.where("c_custkey % 10 <> 0").select("seg", F.col("c_custkey").alias("k")), "k", "seg")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS matched_event_id, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS matched_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_snapshot(t: Tables) -> DataFrame:
    """JON-12: the last view at or before each purchase."""
    p, v = (t.events.where(F.col("event_type") == k).select("user_id", "ts", "event_id") for k in ("purchase", "view"))
    out = R.as_of_join(p, v, "user_id", "ts", "ts", ["event_id"])
    return out.select("event_id", "user_id", "matched_event_id", F.date_format("matched_ts", "yyyy-MM-dd HH:mm:ss").alias("matched_ts"))


@query("""
WITH w AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(trim(p_name)), ' ')) AS w FROM part)
SELECT a.p_brand, a.p_partkey AS l_id, b.p_partkey AS r_id, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS score
FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.6""")
def fuzzy_match(t: Tables) -> DataFrame:
    """JON-13, SET-03: token overlap within a block."""
    return matching.by_tokens(t.part, t.part, "p_brand", "p_partkey", "p_partkey", "p_name", "p_name", digits=6).where("l_id < r_id")


@query("""
WITH s AS (SELECT a.p_partkey AS k, b.p_partkey AS c, CASE WHEN a.p_type = b.p_type THEN 100 ELSE 0 END + CASE WHEN abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) <= 0.01 THEN 20 WHEN abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) <= 0.05 THEN 10 ELSE 0 END AS score
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
SELECT k, c, score, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, c) AS rn FROM s WHERE score > 0) WHERE rn <= 5""")
def certificate_candidates(t: Tables) -> DataFrame:
    """JON-14, SRT-04: additive points within a block, the five best."""
    best = matching.certificate_best(t.part, ["p_brand", "p_size"], "p_partkey", "p_type", "p_retailprice")
    return best.select(F.col("p_partkey").alias("k"), F.col("candidate").alias("c"), "score", "place")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 END, c_nationkey) AS choice, c_custkey % 4 = 0 AS remembered FROM customer""")
def decision_memo(t: Tables) -> DataFrame:
    """JON-15."""
    stored = t.customer.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_custkey") * 10).alias("choice"))
    return R.remembered(t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("choice")), stored, "c_custkey", "choice").select("c_custkey", "choice", "remembered")


@query("""
SELECT s_suppkey, coalesce(a.v, b.v) AS found, CASE WHEN a.v IS NOT NULL THEN 's_suppkey' WHEN b.v IS NOT NULL THEN 's_nationkey' END AS found_by
FROM supplier LEFT JOIN (SELECT c_custkey AS k, min(c_name) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a ON a.k = s_suppkey LEFT JOIN (SELECT c_nationkey AS k, min(c_name) AS v FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1) b ON b.k = s_nationkey""")
def founder_lookup(t: Tables) -> DataFrame:
    """JON-17/19/22/25: lookups in order, with the one that answered."""
    by_id, by_nation = t.customer.where("c_custkey % 2 = 0"), t.customer.where("c_nationkey % 3 = 0")
    out = R.first_found(t.supplier.select("s_suppkey", "s_nationkey"), [("s_suppkey", by_id, "c_custkey", "c_name"), ("s_nationkey", by_nation, "c_nationkey", "c_name")], "found")
    return out.select("s_suppkey", "found", "found_by")


@query("""
SELECT o_orderkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY pos, ord) AS ids FROM (
 SELECT o_orderkey, k, min(l_linenumber) AS pos, min_by(l_suppkey, l_linenumber * 100000 + l_suppkey) AS ord FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN -l_suppkey ELSE l_suppkey END AS k FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def absorb_ids(t: Tables) -> DataFrame:
    """JON-18: local ids replaced, order kept, each once."""
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x.l_suppkey).alias("ids"))
    mapping = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old"), (-F.col("s_suppkey")).alias("new"))
    return R.absorb(lists, "ids", mapping, "old", "new", "o_orderkey").select("o_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
WITH c AS (SELECT user_id AS k, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS rule, CAST(floor(value) AS BIGINT) % 40 AS target FROM events),
 b AS (SELECT k, min(rule) AS rule FROM c GROUP BY 1)
SELECT c.k, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, c.rule AS evidence FROM c JOIN b ON c.k = b.k AND c.rule = b.rule GROUP BY c.k, c.rule""")
def evidence_cascade(t: Tables) -> DataFrame:
    """JON-24: the best rule's target, if it is one."""
    rule = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return R.evidence_cascade(t.events.select(F.col("user_id").alias("k"), rule.alias("rule"), (F.floor("value") % 40).alias("target")), "k", "target", "rule")


@query("""
SELECT p_partkey, m AS matched_c_name FROM part LEFT JOIN (SELECT k, m FROM (SELECT c_custkey // 2 AS k, c_name AS m, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn = 1) ON k = p_partkey""")
def last_writer(t: Tables) -> DataFrame:
    """JON-16."""
    return R.last_writer(t.part.select("p_partkey"), F.col("p_partkey"), t.customer, F.floor(F.col("c_custkey") / 2), [F.col("c_custkey")], "c_name")


@query("SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1")
def kind_map(t: Tables) -> DataFrame:
    """AGG-07."""
    return A.kind_counts(t.orders, "o_orderpriority").select(F.explode("counts").alias("kind", "n"))


@query("SELECT count(*) AS rows, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent, coalesce(bool_or(o_totalprice < 0), false) AS negative FROM orders")
def store_statistics(t: Tables) -> DataFrame:
    """AGG-08."""
    s = A.statistics(t.orders, "o_orderdate", {"urgent": F.col("o_orderpriority") == "1-URGENT", "negative": F.col("o_totalprice") < 0})
    return s.withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query("""
SELECT source, count(*) AS total, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS long, sum(CASE WHEN text LIKE '%|%' THEN 1 ELSE 0 END) AS tables, sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS mismatches FROM documents GROUP BY 1""")
def photo_stats(t: Tables) -> DataFrame:
    """AGG-09."""
    c = A.sums_where({"long": F.col("n_chars") > 2000, "tables": F.col("text").contains("|"), "mismatches": F.col("n_chars") != F.length("text")})
    return t.documents.groupBy("source").agg(F.count("*").alias("total"), *c)


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS seen FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2) GROUP BY 1""")
def first_seen_types(t: Tables) -> DataFrame:
    """AGG-10."""
    return t.events.groupBy("user_id").agg(F.array_join(A.first_seen("event_type", "event_id"), ",").alias("seen"))


@query("""
WITH g AS (SELECT coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), '— без адреса —') AS host, count(*) AS size FROM pages GROUP BY 1)
SELECT host, size, row_number() OVER (ORDER BY host = '— без адреса —', size DESC, host) AS place FROM g""")
def address_group(t: Tables) -> DataFrame:
    """AGG-11/12, SRT-06."""
    return A.grouped(t.pages, F.regexp_extract("url", "^https?://([^/]+)", 1), "host")


@query("SELECT c_nationkey, min(c_name) AS anchor FROM customer GROUP BY 1")
def anchor_keys(t: Tables) -> DataFrame:
    return A.anchors(t.customer, "c_nationkey", "c_name")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) AS facts, count(DISTINCT l_returnflag) AS distinct_values FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_returnflag) >= 2")
def conflicting_facts(t: Tables) -> DataFrame:
    """AGG-14."""
    return A.conflicts(t.lineitem.withColumn("path", F.col("l_orderkey").cast("string")), "path", F.col("l_returnflag"))


@query("""
WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS floors FROM orders), m AS (SELECT l_orderkey AS k, max(l_quantity) AS top FROM lineitem GROUP BY 1),
 w AS (SELECT m.k, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS who FROM m JOIN lineitem ON l_orderkey = m.k AND l_quantity = top GROUP BY 1)
SELECT p.k, CASE WHEN floors <= 0 THEN coalesce(CAST(top AS INTEGER), floors) ELSE floors END AS floors, CASE WHEN floors <= 0 THEN who END AS floors_from FROM p LEFT JOIN m USING (k) LEFT JOIN w USING (k)""")
def floors_from_parts(t: Tables) -> DataFrame:
    """AGG-15."""
    p = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(0).alias("floors"))
    parts = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return A.floors_from_parts(p, parts, "k", "floors", "l_orderkey", "q", "l_linenumber").withColumn("floors_from", F.array_join(F.transform("floors_from", lambda x: x.cast("string")), ","))


@query("""
SELECT p_partkey, CASE WHEN hi > lo THEN CAST(round(14 + 22 * (ln(p_retailprice) - lo) / (hi - lo)) AS INTEGER) ELSE 22 END AS size FROM part JOIN (SELECT p_brand, min(ln(p_retailprice)) AS lo, max(ln(p_retailprice)) AS hi FROM part GROUP BY 1) USING (p_brand)""")
def log_size(t: Tables) -> DataFrame:
    """AGG-16."""
    return A.log_size(t.part, "p_brand", "p_retailprice", "size").select("p_partkey", "size")


@query("""
WITH f AS (SELECT c_custkey, c_nationkey, bool_or(o_orderpriority = '1-URGENT') AS own, bool_or(o_orderstatus = 'P') AS share FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, CASE WHEN own AND share THEN 'both' WHEN own THEN 'object' WHEN share THEN 'shares' ELSE 'none' END AS kind, count(*) AS n FROM f GROUP BY 1, 2""")
def pledge_classes(t: Tables) -> DataFrame:
    """AGG-18."""
    f = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("own"), F.bool_or(F.col("o_orderstatus") == "P").alias("share"))
    kinds = t.customer.join(f, F.col("c_custkey") == F.col("o_custkey")).withColumn("kind", A.pledge_class(F.col("own"), F.lit(False), F.col("share")))
    return kinds.groupBy("c_nationkey", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT l_suppkey AS owner, l_orderkey AS unit, round(avg_p, 4) AS lon, round(avg_s, 4) AS lat FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
JOIN (SELECT k, avg(p_retailprice) AS avg_p, avg(p_size) AS avg_s FROM (SELECT DISTINCT l_orderkey AS k, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1) ON k = l_orderkey""")
def unit_points(t: Tables) -> DataFrame:
    """AGG-20."""
    units = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set("l_partkey").alias("objects"), F.collect_set("l_suppkey").alias("owners"))
    places = t.part.select("p_partkey", F.col("p_retailprice").alias("lon"), F.col("p_size").cast("double").alias("lat"))
    return A.unit_points(units, "unit", "objects", "owners", places, "p_partkey", "lon", "lat").withColumns({"lon": F.round("lon", 4), "lat": F.round("lat", 4)})


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def last_right(t: Tables) -> DataFrame:
    """WIN-01/02/05."""
    return R.top_one(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq FROM events")
def event_sequence(t: Tables) -> DataFrame:
    """WIN-03/08."""
    return R.numbered(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_seq").drop("ts")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND event_type = 'click') AS number FROM events e WHERE event_type = 'view'""")
def next_numbers(t: Tables) -> DataFrame:
    """WIN-03: numbers go on from the largest one."""
    old = R.numbered(t.events.where(F.col("event_type") == "click"), ["user_id"], [F.col("ts"), F.col("event_id")], "number")
    new = t.events.where(F.col("event_type") == "view").select("user_id", "event_id", "ts")
    return R.next_numbers(new, old, "user_id", "number", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "number")


@query("SELECT user_id, min_by(event_type, event_id) AS first_type FROM events GROUP BY 1")
def first_by_id(t: Tables) -> DataFrame:
    """WIN-04."""
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR event_type IS DISTINCT FROM before""")
def change_feed(t: Tables) -> DataFrame:
    """WIN-06, STM-04."""
    return R.changes(t.events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def section_marker(t: Tables) -> DataFrame:
    """WIN-07."""
    marked = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("marker"))
    return R.carried(marked, "user_id", "marker", ["ts", "event_id"], "section").select("event_id", "section")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def null_order(t: Tables) -> DataFrame:
    """SRT-01: NULL is the smallest."""
    return R.numbered(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.nullif("c_nationkey", F.lit(3)).alias("k")), ["c_mktsegment"], [F.col("k").asc_nulls_first(), F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], "place").select("c_custkey", "place")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS place FROM nation")
def nocase_order(t: Tables) -> DataFrame:
    """SRT-02: a fixed list of 25 rows in one order."""
    return R.numbered(t.nation.withColumn("_", F.lit(0)), ["_"], [F.lower("n_name"), F.col("n_nationkey")], "place").select("n_nationkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def largest_orders(t: Tables) -> DataFrame:
    """SRT-03: the limit is the question."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT p_partkey FROM part WHERE p_size < 10")
def missing_items(t: Tables) -> DataFrame:
    """SET-04."""
    return R.missing_items(t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("k")), t.part.where("p_size < 10").select(F.col("p_partkey").alias("k")), ["k"])


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_preferred(t: Tables) -> DataFrame:
    """SET-06: one document of each text, by source."""
    keyed = t.documents.select("doc_id", "source", F.md5(F.lower(F.trim("text")).cast("binary")).alias("k"))
    return R.preferred(keyed, ["k"], "source", ["src3", "src1"], [F.col("doc_id")]).select("doc_id", "source")


@query("""
SELECT c_custkey, list_aggregate(list_sort(list_distinct(list_concat(a, b))), 'string_agg', ',') AS both FROM (SELECT c_custkey, [c_mktsegment, 'X'] AS a, ['X', CAST(c_nationkey AS VARCHAR)] AS b FROM customer)""")
def list_unions(t: Tables) -> DataFrame:
    """SET-05/07, AGG-17."""
    a, b = F.array("c_mktsegment", F.lit("X")), F.array(F.lit("X"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", F.array_join(values.union_sorted(values.union_lists(a), b), ",").alias("both"))


@query("""
SELECT o_orderkey, members FROM orders JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || p_name, '; ' ORDER BY l_linenumber, l_partkey) AS members FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey""")
def lot_members(t: Tables) -> DataFrame:
    """JON-20, TMP-04: members of a lot in order."""
    from tessera.operators.temporal import lot_view

    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    view = lot_view(items, t.part.select("p_partkey", "p_name"), "o_orderkey", "p_partkey", "l_linenumber")
    return view.select("o_orderkey", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m.l_linenumber.cast("string"), m.p_name)), "; ").alias("members"))
