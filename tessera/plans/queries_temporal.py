"""As-of states, replay, conflicts, graphs, chains and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import temporal as P
from tessera.plans.registry import Tables, query
from tessera.streaming import streams as S

DAY = 86_400.0


def _moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) WHERE ts <= TIMESTAMP '2024-01-15' AND (until IS NULL OR until > TIMESTAMP '2024-01-15')""")
def active_intervals(t: Tables) -> DataFrame:
    """TMP-02, FLT-10: what holds at a moment; its end doesn't count."""
    from pyspark.sql import Window

    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return P.active_tags(t.events.withColumn("until", until), _moment("2024-01-15"), "ts", "until").select("user_id", "event_id", "event_type")


@query("""
WITH b AS (SELECT user_id, max(ts) AS base FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1),
 o AS (SELECT e.* FROM events e JOIN b USING (user_id) WHERE event_type IN ('purchase', 'error') AND ts > base AND ts <= TIMESTAMP '2024-01-20'),
 last_remove AS (SELECT o.user_id, o.event_id % 5 AS id, max(row(ts, event_id)) AS at FROM o WHERE event_type = 'error' GROUP BY 1, 2)
SELECT u.user_id, coalesce(sum(CASE WHEN o.event_id IS NOT NULL AND (r.at IS NULL OR row(o.ts, o.event_id) > r.at) THEN 1 ELSE 0 END), 0) AS items,
 CAST(coalesce(sum(CASE WHEN o.event_id IS NOT NULL AND (r.at IS NULL OR row(o.ts, o.event_id) > r.at) THEN o.event_id ELSE 0 END), 0) AS BIGINT) AS total
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN o ON o.user_id = u.user_id AND o.event_type = 'purchase' LEFT JOIN last_remove r ON r.user_id = o.user_id AND r.id = o.event_id % 5 GROUP BY 1""")
def overlay_replay(t: Tables) -> DataFrame:
    """TMP-01: effects after the last extract are replayed in order: purchases add an item, errors remove those of their id."""
    at, extract = _moment("2024-01-20"), F.col("event_type") == "signup"
    bases = P.latest_base(t.events, "user_id", "ts", extract, at)
    later = P.overlays(t.events.where(F.col("event_type").isin("signup", "purchase", "error")), bases, "user_id", "ts", extract, at)
    effects = later.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "add").otherwise("remove").alias("op"), (F.col("event_id") % 5).alias("match"), F.col("event_id").alias("v"))
    base = t.events.select("user_id").distinct().withColumn("items", F.array().cast("array<struct<id:bigint,value:bigint>>"))
    out = P.replay(base, effects, "user_id", "items", ["ts", "event_id"], "op", "match", "v")
    return out.select("user_id", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["value"]).alias("total"))


@query("""
WITH f AS (SELECT user_id || '/' || event_type AS path, CAST(floor(value) AS BIGINT) AS v, strftime(ts, '%Y-%m-%d') AS d, 1 + event_id % 2 AS level, event_id FROM events),
 n AS (SELECT *, max(d) OVER (PARTITION BY path) AS nd FROM f),
 g AS (SELECT path, count(*) AS c, count(DISTINCT v) AS vals, count(*) FILTER (d = nd) AS newest, count(*) FILTER (d = nd AND level = 1) AS reg, min_by(v, event_id) FILTER (d = nd) AS vn, min_by(v, event_id) FILTER (d = nd AND level = 1) AS vr FROM n GROUP BY 1)
SELECT path, CASE WHEN newest = 1 THEN vn WHEN reg = 1 THEN vr END AS winner, CASE WHEN newest = 1 THEN 'newer_wins' WHEN reg = 1 THEN 'registered_wins' ELSE 'unresolved' END AS resolution FROM g WHERE c >= 2 AND vals >= 2""")
def conflict_resolution(t: Tables) -> DataFrame:
    """TMP-05, AGG-14."""
    facts = t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.floor("value").alias("v"), F.date_format("ts", "yyyy-MM-dd").alias("d"), (1 + F.col("event_id") % 2).alias("level"), "event_id")
    return P.resolve_conflicts(facts, "path", "v", "d", "level", "event_id")


@query("""
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id ELSE -event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM events WHERE event_type IN ('purchase', 'error')""")
def material_balance(t: Tables) -> DataFrame:
    """TMP-07: levels are computed from flows."""
    flows = t.events.where(F.col("event_type").isin("purchase", "error"))
    return P.balance(flows, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "level")


@query("""
WITH k AS (SELECT o_custkey, year(o_orderdate) AS season, CASE WHEN o_orderkey % 2 = 0 THEN 'plan' ELSE 'fact' END AS kind, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderkey % 2 ORDER BY o_orderdate DESC, o_totalprice) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-01')
SELECT o_custkey, season, max(o_totalprice) FILTER (kind = 'plan') AS plan, max(o_totalprice) FILTER (kind = 'fact') AS fact FROM k WHERE rn = 1 GROUP BY 1, 2""")
def plan_and_fact(t: Tables) -> DataFrame:
    """TMP-08: seasons with plan and fact as known at a moment."""
    cycles = t.orders.select("o_custkey", P.season(F.col("o_orderdate")).cast("long").alias("season"), F.when(F.col("o_orderkey") % 2 == 0, "plan").otherwise("fact").alias("kind"), "o_totalprice", "o_orderdate")
    return P.plan_and_fact(cycles, ["o_custkey", "season"], "kind", "o_totalprice", "o_orderdate", _moment("1999-06-01"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def current_edges(t: Tables) -> DataFrame:
    """TMP-06."""
    e = t.lineitem.withColumn("superseded_at", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return P.current(e).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT user_id, event_id % 50 AS geo FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15'),
 p AS (SELECT event_id % 50 AS geo, event_id AS lat, row_number() OVER (PARTITION BY event_id % 50 ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-15')
, c AS (SELECT event_id % 50 AS geo, 'g' || event_id AS geometry, row_number() OVER (PARTITION BY event_id % 50 ORDER BY ts DESC, 'g' || event_id) AS rn FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-15' AND (event_id % 3 = 0 OR ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-15'))
SELECT user_id AS asset_id, l.geo AS geo_uuid, CAST(lat AS BIGINT) AS lat, geometry FROM l LEFT JOIN p ON p.geo = l.geo AND p.rn = 1 LEFT JOIN c ON c.geo = l.geo AND c.rn = 1""")
def geo_snapshot(t: Tables) -> DataFrame:
    """TMP-03: links with the last place that holds."""
    geo, none = (F.col("event_id") % 50).alias("geo_uuid"), F.lit(None).cast("timestamp_ntz")
    links = t.events.where(F.col("event_type") == "signup").select(F.col("user_id").alias("asset_id"), geo, F.lit("site").alias("role"), F.col("ts").alias("valid_from"), none.alias("valid_to"))
    points = t.events.where(F.col("event_type") == "view").select(geo, F.col("event_id").alias("lat"), F.lit(0).alias("lon"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("valid_to"))
    contours = t.events.where(F.col("event_type") == "click").select(geo, F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("geometry"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("valid_to"))
    return P.geo_snapshot(links, points, contours, _moment("2024-01-15")).select("asset_id", "geo_uuid", "lat", "geometry")


@query("""
SELECT c_custkey, coalesce(n, 0) AS rights, coalesce(m, 0) AS restrictions, strftime(e, '%Y-%m-%d') AS extract_date FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS m FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-10' GROUP BY 1) r ON r.user_id = c_custkey
LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) AS e FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1) x ON x.k = c_custkey""")
def object_view(t: Tables) -> DataFrame:
    """TMP-04: an object with what was known of it at a moment."""
    k = F.col("c_custkey")
    rights = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("day"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("holder"))
    restrictions = t.events.select(F.col("user_id").alias("c_custkey"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 3 DAY")).alias("valid_to"), F.col("event_type").alias("kind"))
    extracts = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("extract_date"))
    at, then = _moment("1998-01-01"), _moment("2024-01-10")
    view = P.as_of_view(t.customer.select(k), rights, restrictions.where("false"), extracts, at, "c_custkey").drop("restrictions")
    own = P.as_of_view(t.customer.select(k), rights.where("false"), restrictions, extracts.where("false"), then, "c_custkey").select("c_custkey", "restrictions")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return view.join(own, "c_custkey").select("c_custkey", count("rights"), count("restrictions"), F.date_format("extract_date", "yyyy-MM-dd").alias("extract_date"))


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = G.union_all(G.nodes(t.region, F.col("r_regionkey"), "region", 0, F.col("r_name")), G.nodes(t.nation, F.col("n_nationkey"), "nation", 1, F.col("n_name")), G.nodes(t.customer, F.col("c_custkey"), "customer", 2, F.col("c_name")))
    edges = G.union_all(
        G.edges(t.nation, F.col("n_regionkey"), "region", F.col("n_nationkey"), "nation", "contains"),
        G.edges(t.customer.where("c_custkey % 10 <> 0"), F.col("c_nationkey"), "nation", F.col("c_custkey"), "customer", "contains"),
        G.edges(t.orders, F.col("o_custkey"), "customer", F.col("o_orderkey"), "order", "owns"),
    )
    return nodes, edges


@query("""
SELECT 'region:' || r_regionkey AS id, 'region' AS kind, 0 AS level, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 1, n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', 2, c_name FROM customer""")
def graph_nodes(t: Tables) -> DataFrame:
    """GRF-01."""
    return _graph(t)[0]


@query("""
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'owns' FROM orders""")
def ownership_graph(t: Tables) -> DataFrame:
    """GRF-01/12."""
    return _graph(t)[1]


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 10 = 0")
def graph_orphans(t: Tables) -> DataFrame:
    """GRF-01, JON-09."""
    return G.without_parent(*_graph(t)).select("id")


@query("SELECT 'order:' || o_orderkey AS id, 'stub' AS kind FROM orders")
def graph_stubs(t: Tables) -> DataFrame:
    """GRF-04/08: ids that only edges name."""
    nodes, edges = _graph(t)
    return G.stubs(edges, nodes)


@query("""
SELECT 'nation:' || c_nationkey AS src, 'customer:' || c_custkey AS dst FROM customer WHERE c_nationkey = 7 AND c_custkey % 10 <> 0 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND c_custkey % 10 <> 0""")
def object_graph(t: Tables) -> DataFrame:
    """GRF-02: two steps around one object."""
    centre = t.nation.where("n_nationkey = 7").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return G.around(_graph(t)[1], centre).select("src", "dst")


@query("""
SELECT id, coalesce(label, id) AS label, label IS NULL AS degraded FROM (SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS label FROM customer)""")
def degraded_labels(t: Tables) -> DataFrame:
    """GRF-02."""
    ids = t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("label"))
    return G.with_labels(ids, ids.where("label is not null"))


@query("""
SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'owns' WHEN 'N' THEN 'leases' ELSE 'encumbrance' END AS kind, max(l_discount) FILTER (l_linestatus = 'F') AS confidence FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag""")
def graph_emit(t: Tables) -> DataFrame:
    """GRF-03, AGG-06: relations with the confidence of their active assertions."""
    rows = t.lineitem.select(F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id"), F.when(F.col("l_returnflag") == "A", "OWNS").when(F.col("l_returnflag") == "N", "LEASES").otherwise("MORTGAGED_BY").alias("code"), "l_discount", "l_linestatus")
    ends = rows.select(F.col("from_id").alias("id")).unionByName(rows.select(F.col("to_id").alias("id"))).distinct().select("id", F.col("id").alias("node_id"), F.lit("land").alias("kind"), F.col("id").alias("label"))
    asserted = rows.select(F.col("id").alias("relation_id"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "active").otherwise("superseded").alias("status"))
    return G.emit(ends, rows.select("id", "from_id", "to_id", "code").distinct(), asserted)[1]


@query("""
SELECT DISTINCT least('p' || l_partkey, 's' || l_suppkey) AS src, greatest('p' || l_partkey, 's' || l_suppkey) AS dst, 'linked' AS kind FROM lineitem""")
def edge_dedup(t: Tables) -> DataFrame:
    """GRF-04: both directions of an edge become one."""
    p, s = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    both = t.lineitem.select(p.alias("src"), s.alias("dst")).unionByName(t.lineitem.select(s.alias("src"), p.alias("dst")))
    return G.undirected(both.withColumn("kind", F.lit("linked")))


@query("""
WITH RECURSIVE up(start, node, path, depth, hit) AS (
 SELECT c_custkey, c_custkey, CAST(c_custkey AS VARCHAR), 0, c_acctbal < 0 FROM customer
 UNION ALL SELECT start, c_custkey, path || '>' || c_custkey, depth + 1, c_acctbal < 0 FROM up JOIN customer ON c_custkey = node // 10 AND c_custkey <> node WHERE NOT hit)
SELECT start, node AS found, path, depth FROM up WHERE hit""")
def founder_chain(t: Tables) -> DataFrame:
    """GRF-06: up the founders to the first with a pledge; the depth of customer numbers is their number of digits."""
    t.customer.select("c_custkey", F.floor(F.col("c_custkey") / 10).alias("up"), (F.col("c_acctbal") < 0).alias("hit")).createOrReplaceTempView("tessera_founders")
    out = G.chains_recursive(t.spark, "tessera_founders", "c_custkey", "up", "hit")
    return out.select("start", "found", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query("""
WITH RECURSIVE up(start, node, path, depth, hit) AS (
 SELECT s_suppkey, s_suppkey, CAST(s_suppkey AS VARCHAR), 0, s_acctbal < 0 FROM supplier
 UNION ALL SELECT start, s_suppkey, path || '>' || s_suppkey, depth + 1, s_acctbal < 0 FROM up JOIN supplier ON s_suppkey = node // 100 AND s_suppkey <> node WHERE NOT hit)
SELECT start, node AS found, path, depth FROM up WHERE hit""")
def founder_levels(t: Tables) -> DataFrame:
    """GRF-06: a join for each level, as many as the forest has."""
    s = t.supplier.select("s_suppkey", F.floor(F.col("s_suppkey") / 100).alias("up"), (F.col("s_acctbal") < 0).alias("hit"))
    out = G.chains(s, s, "s_suppkey", "up", "hit")
    return out.select("start", "found", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query("""
SELECT DISTINCT 'legal::inn::' || k AS key FROM (SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')""")
def pledge_holders(t: Tables) -> DataFrame:
    """GRF-07."""
    a = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("inn"))
    b = t.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("inn"))
    return G.pledge_holders(a, b, t.customer.where("false").select(F.col("c_name").alias("inn"), F.col("c_name").alias("key")))


@query("""
WITH k AS (SELECT c_name AS local, 'c' || c_custkey AS id FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'c' || c_custkey FROM customer)
SELECT local, min(id) AS id FROM k GROUP BY 1""")
def node_index(t: Tables) -> DataFrame:
    """GRF-05."""
    return G.node_index(t.customer.withColumn("id", F.concat(F.lit("c"), "c_custkey")), "id", ["c_name", "c_nationkey"])


@query("SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'part_of' AS kind FROM customer UNION ALL SELECT 'c' || c_custkey, c_mktsegment, 'belongs_to' FROM customer WHERE c_custkey % 2 = 0")
def placemark_graph(t: Tables) -> DataFrame:
    """GRF-09."""
    return G.placemark_graph(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("owner_id")))


@query("""
WITH s AS (SELECT DISTINCT list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s WHERE len(p) > 0),
 n AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, CASE WHEN i > 1 THEN array_to_string(p[1:i - 1], '/') END AS up, i - 1 AS depth FROM x)
SELECT sha1(path) AS id, path, sha1(up) AS parent_id, CAST(depth AS INTEGER) AS depth FROM n""")
def path_tree(t: Tables) -> DataFrame:
    """GRF-10: every beginning of a path is a node."""
    return G.path_tree(t.pages, "url")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OWNS' WHEN 'F' THEN 'LEASES' ELSE 'RESTRICTED_BY' END AS code FROM orders""")
def relation_codes(t: Tables) -> DataFrame:
    """GRF-11."""
    kind = F.when(F.col("o_orderstatus") == "O", "ownership").when(F.col("o_orderstatus") == "F", "lease").otherwise("other")
    return t.orders.select("o_orderkey", G.relation_code(kind).alias("code"))


@query("SELECT DISTINCT coalesce('s' || l_suppkey, 'b' || o_custkey) AS src, 'o' || o_orderkey AS dst, 'OWNS' AS code FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0) ON l_orderkey = o_orderkey")
def right_edges(t: Tables) -> DataFrame:
    """GRF-12: holders, else the beneficiary."""
    rights = t.orders.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), "o_orderkey").alias("object"), F.concat(F.lit("b"), "o_custkey").alias("beneficiary"), F.lit("ownership").alias("right_type"))
    return G.right_edges(rights, t.lineitem.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("s"), "l_suppkey").alias("holder")), "k")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 w(user_id, rn, seen, event_id, ok) AS (SELECT user_id, rn, t, event_id, true FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, CASE WHEN o.t - w.seen >= 3600 THEN o.t ELSE w.seen END, o.event_id, o.t - w.seen >= 3600 FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, event_id FROM w WHERE ok""")
def debounce(t: Tables) -> DataFrame:
    """STM-02: an hour from the last accepted event."""
    return S.debounce(t.events, "user_id", "ts", "event_id", 3600.0)


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'signup')),
 w(user_id, rn, event_id, f, t, n, first, until) AS (
  SELECT user_id, rn, event_id, f, t, CASE WHEN f THEN 1 ELSE 0 END, CASE WHEN f THEN t END, 0.0::DOUBLE FROM o WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, f, t, n, first, CASE WHEN f AND n >= 3 THEN t + 172800 WHEN f THEN keep ELSE 0.0 END FROM (
   SELECT o.user_id, o.rn, o.event_id, o.f, o.t, CASE WHEN NOT o.f THEN 0 WHEN w.first IS NULL OR o.t - w.first > 86400 THEN 1 ELSE w.n + 1 END AS n,
    CASE WHEN NOT o.f THEN NULL WHEN w.first IS NULL OR o.t - w.first > 86400 THEN o.t ELSE w.first END AS first, CASE WHEN w.first IS NULL OR o.t - w.first > 86400 THEN 0.0 ELSE w.until END AS keep
   FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1))
SELECT user_id, event_id, until > t AS blocked FROM w WHERE f""")
def rate_limiter(t: Tables) -> DataFrame:
    """STM-03, WIN-10: three failures within a day of the first block for two days; a sign-up resets."""
    rows = t.events.where(F.col("event_type").isin("error", "signup"))
    return S.limiter(rows, "user_id", "ts", "event_id", F.col("event_type") == "error", 3, DAY, 2 * DAY)


@query("""
WITH e AS (SELECT user_id % 40 AS f, ts, event_id, 0 AS there FROM events WHERE event_type IN ('error', 'signup') UNION ALL SELECT CASE WHEN event_type = 'signup' THEN user_id % 40 + 100 ELSE user_id % 40 END, ts, event_id, 1 FROM events WHERE event_type IN ('click', 'view', 'signup'))
SELECT 'f' || f AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ts DESC, there DESC) AS rn FROM e) WHERE rn = 1 AND there = 1""")
def file_index(t: Tables) -> DataFrame:
    """STM-01/05: files that stand after their events; a move deletes here and creates there."""
    kinds = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "moved").when(F.col("event_type") == "click", "created").when(F.col("event_type") == "view", "modified")
    rows = t.events.select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("path"), "ts", kinds.alias("kind"), F.concat(F.lit("f"), F.col("user_id") % 40 + 100).alias("target"))
    return S.file_index(rows, "path", "ts", "kind", "target").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN 'changed' ELSE 'same' END AS state FROM customer WHERE c_custkey % 2 = 0")
def monitoring(t: Tables) -> DataFrame:
    """STM-06."""
    k = F.col("c_custkey")
    seen = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(k % 5 == 0, "x").otherwise(F.col("c_name")).alias("c_name"))
    return S.monitor(t.customer.withColumn("monitored", F.when(k % 2 == 0, 1).otherwise(0)), seen, "c_custkey", "c_name")


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    """Extension beyond the registry's own operators."""
    out = S.windowed(t.events, "ts", "event_type", "value", "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def sliding_windows(t: Tables) -> DataFrame:
    """Extension."""
    out = S.windowed(t.events, "ts", "event_type", "value", "6 hours", "3 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(t: Tables) -> DataFrame:
    """Extension: a session ends after twelve hours without an event."""
    return S.sessions(t.events, "ts", "user_id", "12 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
