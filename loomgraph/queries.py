"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import series
from loomgraph.operators import algorithms as A
from loomgraph.operators import fulltext, sampling, vectors
from loomgraph.plans.graph import Graph
from loomgraph.plans.storage import table

#: Vertex ids are a label's number times this plus the key.
STEP = 1 << 40
VERTICES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey")}


def _vid(label: str, key: str):
    return F.col(key).cast("long") + STEP * list(VERTICES).index(label)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders."""
    g = Graph.empty()
    for label, (name, key) in VERTICES.items():
        g = g.with_vertices(label, table(spark, sf_dir, name).withColumn("_vid", _vid(label, key)), key)

    def edges(label: str, name: str, src: tuple[str, str], dst: tuple[str, str], *props: str, rows: bool = False, distinct: bool = False) -> None:
        nonlocal g  # rows: parallel edges are told apart by their place in the file
        df = table(spark, sf_dir, name).select(_vid(*src).alias("_src"), _vid(*dst).alias("_dst"), (F.xxhash64("_metadata.file_path", "_metadata.row_index") if rows else F.lit(0).cast("long")).alias("_eid"), F.lit(0).cast("long").alias("_tid"), *props)
        g = g.with_edges(label, df.distinct() if distinct else df, ((src[0], dst[0]),))

    edges("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    edges("LIVES_IN", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    edges("BASED_IN", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    edges("PLACED", "orders", ("Customer", "o_custkey"), ("Orders", "o_orderkey"), "o_orderdate")
    edges("CONTAINS", "lineitem", ("Orders", "l_orderkey"), ("Part", "l_partkey"), "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", rows=True)
    edges("SUPPLIES", "lineitem", ("Supplier", "l_suppkey"), ("Part", "l_partkey"), distinct=True)
    return g


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with a series of readings; the last event at a timestamp stays."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().withColumn("_vid", F.col("user_id"))
    points = e.select(F.col("user_id").alias("element"), "ts", "value", "event_id")
    held = series.append(series.create(spark, "bigint", {"value": "double"}), points, "event_id")
    g = Graph.empty().with_vertices("User", users, "user_id")
    return Graph(g.vertices, g.edges, g.vertex_labels, g.edge_labels, {("User", "readings"): held})


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, with the first one's quantity."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.lead("l_partkey").over(w).alias("dst"))
    return li.where("dst is not null").select(F.col("l_partkey").alias("src"), "dst", F.col("l_quantity").alias("weight"))


def part_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


#: The same tables in SQL.
E_SQL = "e AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS dst, l_quantity AS weight FROM lineitem) WHERE dst IS NOT NULL)"
U_SQL = E_SQL + ", u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b)"
S_SQL = "s AS (SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)"


def _cypher(text: str, graph: Callable = trade_graph) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark, sf_dir).cypher(text)


def _write(change: str, read: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: trade_graph(spark, sf_dir).execute(change)[0].cypher(read)


#: Name: query text over the trade graph, SQL.
CYPHER = {
    "pattern_orders_by_nation": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (c)-[:PLACED]->(o:Orders) RETURN n.n_name AS nation, count(o) AS orders, max(o.o_totalprice) AS top",
        "SELECT n_name AS nation, count(*) AS orders, max(o_totalprice) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name",
    ),
    "node_scan_all": ("MATCH (n) RETURN label(n) AS label, count(n) AS n", " UNION ALL ".join(f"SELECT '{k}' AS label, count(*) AS n FROM {t}" for k, (t, _) in VERTICES.items())),
    "node_label_scan": ("MATCH (n:Part) RETURN n.p_partkey AS partkey, n.p_name AS name", "SELECT p_partkey AS partkey, p_name AS name FROM part"),
    "node_property_seek": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) WHERE c.c_acctbal > 100.5 RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100.5"),
    "node_seek_dynamic": ("UNWIND [1, 5, 9, 12] AS k MATCH (c:Customer) WHERE c.c_custkey = k RETURN k AS k, c.c_name AS name", "SELECT CAST(c_custkey AS INTEGER) AS k, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9, 12)"),
    "node_id_seek": (f"MATCH (n) WHERE id(n) IN [{STEP}, {STEP + 3}] RETURN id(n) AS id, n.n_name AS name", f"SELECT n_nationkey + {STEP} AS id, n_name AS name FROM nation WHERE n_nationkey IN (0, 3)"),
    "expand_reverse": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "expand_undirected": ("MATCH (n:Nation)-[:IN_REGION|LIVES_IN]-(x) RETURN n.n_name AS nation, count(x) AS n", "SELECT n_name AS nation, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation"),
    "expand_edge_filter": ("MATCH (o:Orders)-[l:CONTAINS WHERE l.l_quantity > 45]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 45"),
    "expand_into": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "trail_uniqueness": (
        "MATCH (a:Part)<-[:CONTAINS]-(o:Orders)-[:CONTAINS]->(b:Part) RETURN o.o_orderkey AS o, count(*) AS pairs",
        "SELECT l_orderkey AS o, n * (n - 1) AS pairs FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1",
    ),
    "variable_length": (
        "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..2]->(x) RETURN label(x) AS label, count(*) AS n",
        "SELECT 'Nation' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Region', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "variable_length_zero": (
        "MATCH p = (n:Nation)-[:IN_REGION*0..1]->(x) RETURN length(p) AS hops, count(*) AS n",
        "SELECT 0 AS hops, count(*) AS n FROM nation UNION ALL SELECT 1, count(*) FROM nation",
    ),
    "quantified_path": ("MATCH (c:Customer)-[:LIVES_IN|IN_REGION]->{2,2}(r:Region) RETURN r.r_name AS region, count(c) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "path_functions": (
        "MATCH p = (s:Supplier)-[:BASED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.s_suppkey AS s, length(p) AS hops, size(nodes(p)) AS nodes, id(r) AS r",
        "SELECT s_suppkey AS s, 2 AS hops, 3 AS nodes, CAST(n_regionkey AS BIGINT) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_orderstatus = 'F' RETURN c.c_custkey AS c, count(o) AS n",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    ),
    "exists_pattern": ("MATCH (c:Customer) WHERE exists((c)-[:PLACED]->(:Orders {o_orderstatus: 'P'})) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "not_exists_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Orders {o_orderstatus: 'P'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "pattern_as_value": ("MATCH (p:Part) RETURN p.p_partkey AS p, exists((:Supplier)-[:SUPPLIES]->(p)) AS supplied", "SELECT p_partkey AS p, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AS supplied FROM part"),
    "pattern_comprehension": (
        "MATCH (n:Nation) RETURN n.n_nationkey AS n, size([(n)<-[:BASED_IN]-(s:Supplier) | s.s_suppkey]) AS suppliers",
        "SELECT n_nationkey AS n, CAST(count(s_suppkey) AS INTEGER) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    ),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "cartesian_product": ("MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(o) AS n WHERE n > 12 MATCH (c)-[:LIVES_IN]->(x:Nation) RETURN c.c_custkey AS c, n AS n, x.n_name AS nation",
        "SELECT c_custkey AS c, n, n_name AS nation FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12) ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "gql_next": ("MATCH (n:Nation) RETURN n.n_regionkey AS r, count(*) AS c NEXT RETURN max(c) AS top", "SELECT CAST(max(c) AS DOUBLE) AS top FROM (SELECT count(*) AS c FROM nation GROUP BY n_regionkey)"),
    "aggregates": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, count(DISTINCT c.c_nationkey) AS d, round(sum(c.c_acctbal)) AS s, round(avg(c.c_acctbal)) AS a, max(c.c_acctbal) AS hi, min(c.c_acctbal) AS lo",
        "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS d, round(sum(c_acctbal)) AS s, round(avg(c_acctbal)) AS a, max(c_acctbal) AS hi, min(c_acctbal) AS lo FROM customer GROUP BY c_mktsegment",
    ),
    "percentiles_and_spread": (
        "MATCH (p:Part) RETURN percentileCont(p.p_retailprice, 0.4) AS cont, percentileDisc(p.p_retailprice, 0.5) AS disc, round(stDev(p.p_retailprice)) AS sd, round(stDevP(p.p_retailprice)) AS sdp, round(variance(p.p_size)) AS v, round(varianceP(p.p_size)) AS vp",
        "SELECT quantile_cont(p_retailprice, 0.4) AS cont, quantile_disc(p_retailprice, 0.5) AS disc, round(stddev_samp(p_retailprice)) AS sd, round(stddev_pop(p_retailprice)) AS sdp, round(var_samp(p_size)) AS v, round(var_pop(p_size)) AS vp FROM part",
    ),
    "aggregate_arithmetic": ("MATCH (p:Part) RETURN max(p.p_size) + 2 * 3 AS m, sum(p.p_size) / count(p) AS a", "SELECT CAST(max(p_size) AS DOUBLE) + 6 AS m, CAST(sum(p_size) AS DOUBLE) / count(*) AS a FROM part"),
    "collect_lists": ("MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n.n_nationkey) AS ks RETURN r AS r, size(ks) AS n, minInList(ks) AS lo, maxInList(ks) AS hi", "SELECT n_regionkey AS r, CAST(count(*) AS INTEGER) AS n, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey"),
    "order_topn": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY t DESC, k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 20"),
    "order_skip_limit": ("MATCH (n:Nation) RETURN n.n_name AS name ORDER BY name SKIP 5 LIMIT 7", "SELECT n_name AS name FROM nation ORDER BY name LIMIT 7 OFFSET 5"),
    "distinct_rows": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg, c.c_nationkey AS n", "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS n FROM customer"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "intersect_keys": ("MATCH (c:Customer) RETURN c.c_nationkey AS n INTERSECT MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except_keys": ("MATCH (p:Part) RETURN p.p_partkey AS n EXCEPT MATCH (:Supplier)-[:SUPPLIES]->(p:Part) WHERE p.p_size > 25 RETURN p.p_partkey AS n", "SELECT p_partkey AS n FROM part EXCEPT SELECT l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25"),
    "unwind_list": ("UNWIND range(1, 5) AS x RETURN x AS x, x * x AS sq", "SELECT CAST(x AS INTEGER) AS x, CAST(x * x AS INTEGER) AS sq FROM range(1, 6) t(x)"),
    "string_predicates": ("MATCH (p:Part) WHERE p.p_type STARTS WITH 'S' OR p.p_brand ENDS WITH '3' OR p.p_name CONTAINS 'ab' OR p.p_name =~ '.*1' RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_brand, '3') OR contains(p_name, 'ab') OR regexp_full_match(p_name, '.*1')"),
    "string_functions": (
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, toLower(n.n_name) AS lo, left(n.n_name, 2) AS l, right(n.n_name, 2) AS r, reverse(n.n_name) AS rev, replace(n.n_name, 'A', '_') AS rep, size(n.n_name) AS n, n.n_name + '!' AS bang, substring(n.n_name, 1, 2) AS sub",
        "SELECT n_nationkey AS k, lower(n_name) AS lo, left(n_name, 2) AS l, right(n_name, 2) AS r, reverse(n_name) AS rev, replace(n_name, 'A', '_') AS rep, CAST(length(n_name) AS INTEGER) AS n, n_name || '!' AS bang, substr(n_name, 2, 2) AS sub FROM nation",
    ),
    "numeric_functions": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, sign(p.p_size - 25) AS s, p.p_size % 7 AS m, p.p_size ^ 2 AS sq, toInteger(p.p_retailprice) AS i",
        "SELECT p_partkey AS k, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, CAST(sign(p_size - 25) AS INTEGER) AS s, p_size % 7 AS m, pow(p_size, 2) AS sq, CAST(trunc(p_retailprice) AS BIGINT) AS i FROM part",
    ),
    "round_digits": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(p.p_retailprice / 7, 2) AS two, round(p.p_retailprice / 7) AS whole", "SELECT p_partkey AS k, round(p_retailprice / 7, 2) AS two, round(p_retailprice / 7) AS whole FROM part"),
    "list_functions": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 3, 1] AS xs RETURN k AS k, head(xs) AS h, last(xs) AS l, xs[-2] AS m, size(xs[1..]) AS n, size([x IN xs WHERE x > 2 | x * 2]) AS big, any(x IN xs WHERE x = 3) AS three, isDesc(xs) AS d, hasDuplicates(xs) AS dup",
        "SELECT p_partkey AS k, p_size AS h, 1 AS l, 3 AS m, 2 AS n, CAST((p_size > 2)::INT + 1 AS INTEGER) AS big, true AS three, p_size > 3 AS d, p_size IN (1, 3) AS dup FROM part",
    ),
    "case_expression": ("MATCH (o:Orders) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "temporal_filter": ("MATCH (o:Orders) WHERE o.o_orderdate >= datetime('1995-01-01 00:00:00') AND o.o_orderdate < datetime('1996-01-01 00:00:00') RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "graph_functions": (
        "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN id(n) AS n, type(e) AS t, startNode(e) AS a, endNode(e) AS b, euid(e) AS u, label(r) AS l, n:Nation AS is_n",
        f"SELECT n_nationkey + {STEP} AS n, 'IN_REGION' AS t, n_nationkey + {STEP} AS a, CAST(n_regionkey AS BIGINT) AS b, (n_nationkey + {STEP}) || '_' || n_regionkey || '_0_0_0' AS u, 'Region' AS l, true AS is_n FROM nation",
    ),
    "relationship_count": ("MATCH ()-[e:CONTAINS]->() RETURN count(e) AS n", "SELECT count(*) AS n FROM lineitem"),
    "snb_style_top_parts": (
        "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[l:CONTAINS]->(p:Part) WITH p, count(DISTINCT c) AS buyers, count(l) AS items ORDER BY buyers DESC, items DESC, p.p_partkey LIMIT 15 RETURN p.p_partkey AS p, p.p_brand AS brand, buyers AS buyers, items AS items",
        "SELECT p_partkey AS p, p_brand AS brand, count(DISTINCT o_custkey) AS buyers, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey GROUP BY p_partkey, p_brand ORDER BY buyers DESC, items DESC, p LIMIT 15",
    ),
    "finbench_style_chain": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part)<-[l:CONTAINS]-(o:Orders) WHERE l.l_discount > 0.09 AND o.o_totalprice > 100000 RETURN s.s_suppkey AS s, count(DISTINCT o) AS orders",
        "SELECT l2.l_suppkey AS s, count(DISTINCT o_orderkey) AS orders FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l2 JOIN lineitem l ON l.l_partkey = l2.l_partkey JOIN orders ON o_orderkey = l.l_orderkey JOIN supplier ON s_suppkey = l2.l_suppkey JOIN part ON p_partkey = l.l_partkey WHERE l.l_discount > 0.09 AND o_totalprice > 100000 GROUP BY 1",
    ),
}

CYPHER["window_functions"] = (
    "MATCH (c:Customer) RETURN c.c_custkey AS c, rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC) AS r, count(*) OVER (PARTITION BY c.c_nationkey) AS n, max(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment) AS hi",
    "SELECT c_custkey AS c, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS hi FROM customer",
)

#: Name: text that changes the trade graph, text that reads the new graph, SQL.
WRITES = {
    "write_create": (
        "MATCH (n:Nation) WHERE n.n_nationkey < 3 CREATE (n)-[:IN_REGION]->(r:Region {r_regionkey: n.n_nationkey + 100, r_name: n.n_name})",
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, n_name FROM nation WHERE n_nationkey < 3",
    ),
    "write_set": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.c_mktsegment = 'BUILDING' SET c.c_acctbal = -1.0, c.c_name = n.n_name",
        "MATCH (c:Customer) RETURN c.c_custkey AS c, c.c_name AS name, c.c_acctbal AS bal",
        "SELECT c_custkey AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN -1.0 ELSE c_acctbal END::DOUBLE AS bal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    ),
    "write_remove": (
        "MATCH (p:Part) WHERE p.p_size > 25 REMOVE p.p_brand",
        "MATCH (p:Part) RETURN p.p_partkey AS p, p.p_brand AS brand",
        "SELECT p_partkey AS p, CASE WHEN p_size > 25 THEN NULL ELSE p_brand END AS brand FROM part",
    ),
    "write_delete": (
        "MATCH (n:Nation) WHERE n.n_regionkey = 1 DETACH DELETE n",
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:LIVES_IN]->(n:Nation) RETURN c.c_custkey AS c, n.n_name AS nation",
        "SELECT c_custkey AS c, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1",
    ),
    "write_merge": (
        "MATCH (o:Orders)<-[:PLACED]-(b:Customer) WHERE o.o_totalprice > 1000 MERGE (c:Customer {c_custkey: o.o_custkey * 2}) ON CREATE SET c.c_name = 'new' ON MATCH SET c.c_name = 'old'",
        "MATCH (c:Customer) RETURN c.c_custkey AS c, c.c_name AS name",
        "WITH k AS (SELECT DISTINCT o_custkey * 2 AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000) SELECT c_custkey AS c, CASE WHEN c_custkey IN (SELECT k FROM k) THEN 'old' ELSE c_name END AS name FROM customer UNION ALL SELECT k, 'new' FROM k WHERE k NOT IN (SELECT c_custkey FROM customer)",
    ),
}

#: The same over users and their series.
SERIES = {
    "series_count": ("MATCH (u:User) RETURN u.user_id AS u, series.count(u, 'readings') AS n", f"WITH {S_SQL} SELECT user_id AS u, count(*) AS n FROM s GROUP BY user_id"),
    "series_latest": ("MATCH (u:User) RETURN u.user_id AS u, series.latest(u, 'readings').value AS v", f"WITH {S_SQL} SELECT user_id AS u, arg_max(value, ts) AS v FROM s GROUP BY user_id"),
    "series_aggregates": (
        "MATCH (u:User) RETURN u.user_id AS u, series.min(u, 'readings', 'value') AS lo, series.max(u, 'readings', 'value') AS hi, round(series.sum(u, 'readings', 'value'), 4) AS s",
        f"WITH {S_SQL} SELECT user_id AS u, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS s FROM s GROUP BY user_id",
    ),
    "series_window": (
        "MATCH (u:User) RETURN u.user_id AS u, size(series.range(u, 'readings', datetime('2024-01-05 00:00:00'), datetime('2024-01-20 00:00:00'))) AS n",
        f"WITH {S_SQL} SELECT user_id AS u, CAST(count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS INTEGER) AS n FROM s GROUP BY user_id",
    ),
    "series_summary": ("MATCH (u:User) RETURN u.user_id AS u, u.readings.count AS n, u.readings.first AS a, u.readings.last AS b", f"WITH {S_SQL} SELECT user_id AS u, count(*) AS n, min(ts) AS a, max(ts) AS b FROM s GROUP BY user_id"),
}

_ROUNDS = 3


def _pagerank_sql() -> str:
    base = f"WITH {E_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM part), d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT p_partkey AS id, coalesce(deg, 0) AS deg, 1 / n AS r FROM part LEFT JOIN d ON src = p_partkey, n)"
    for i in range(_ROUNDS):
        base += f", r{i + 1} AS (SELECT r0.id, r0.deg, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE deg = 0) / n + 0.85 * coalesce(m, 0) AS r FROM r0 CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / deg) AS m FROM e JOIN r{i} x ON x.id = src GROUP BY dst) ON dst = r0.id)"
    return base + f" SELECT id, round(r, 9) AS rank FROM r{_ROUNDS}"


def _weighted_pagerank_sql(rounds: int) -> str:
    out = f"WITH {E_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM part), d AS (SELECT src, sum(weight)::DOUBLE AS deg FROM e GROUP BY src), r0 AS (SELECT p_partkey AS id, coalesce(deg, 0) AS deg, 1 / n AS r FROM part LEFT JOIN d ON src = p_partkey, n)"
    for i in range(rounds):
        out += f", m{i} AS (SELECT dst, sum(r * weight / deg) AS m FROM e JOIN r{i} ON id = src GROUP BY dst), r{i + 1} AS MATERIALIZED (SELECT id, deg, (0.15 + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE deg = 0)) / n + 0.85 * coalesce(m, 0) AS r FROM r{i} CROSS JOIN n LEFT JOIN m{i} ON dst = id)"
    return out + f" SELECT id, round(r, 9) AS rank FROM r{rounds}"


def _seeded_sql(seeds: str, rounds: int, start: float, teleport: float, keep: float, pick: str) -> str:
    """Scores that start at and return to ``seeds``; ``pick`` says which round's are asked for."""
    out = f"WITH {E_SQL}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT p_partkey AS id, coalesce(deg, 0) AS deg, CASE WHEN p_partkey IN ({seeds}) THEN {start} ELSE 0 END::DOUBLE AS r FROM part LEFT JOIN d ON src = p_partkey)"
    for i in range(rounds):
        out += f", r{i + 1} AS MATERIALIZED (SELECT id, deg, {keep} * coalesce(m, 0) + CASE WHEN id IN ({seeds}) THEN {teleport} ELSE 0 END::DOUBLE AS r FROM r{i} LEFT JOIN (SELECT dst, sum(r / deg) AS m FROM e JOIN r{i} ON id = src GROUP BY dst) ON dst = id)"
    every = " UNION ALL ".join(f"SELECT {i} AS i, id, r FROM r{i}" for i in range(rounds + 1))
    return out + f" SELECT id, round(r, 9) AS score FROM ({every}) WHERE i = {pick}"


def _hits_sql(rounds: int) -> str:
    out = f"WITH {E_SQL}, h0 AS (SELECT p_partkey AS id, 1.0::DOUBLE AS h, 0.0::DOUBLE AS a FROM part)"
    for i in range(rounds):
        out += f", x{i} AS MATERIALIZED (SELECT id, coalesce(s, 0) AS a FROM h{i} LEFT JOIN (SELECT dst, sum(h) AS s FROM e JOIN h{i} ON id = src GROUP BY dst) ON dst = id), a{i} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS a FROM x{i})"
        out += f", y{i} AS MATERIALIZED (SELECT id, a, coalesce(s, 0) AS h FROM a{i} LEFT JOIN (SELECT src, sum(a) AS s FROM e JOIN a{i} ON id = dst GROUP BY src) ON src = id), h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{i}) AS h, a FROM y{i})"
    return out + f" SELECT id, round(a, 9) AS authority, round(h, 9) AS hub FROM h{rounds}"


#: Rounds of the distance SQL; it gives no rows where the last of them still changes a distance.
_DISTANCE_ROUNDS = 24


def _distance_sql(roots: list[int]) -> str:
    out = f"WITH {E_SQL}, f AS MATERIALIZED (SELECT src, dst, min(weight)::DOUBLE AS w FROM e GROUP BY src, dst), d0 AS (SELECT unnest({roots})::BIGINT AS id, 0.0::DOUBLE AS dist)"
    for i in range(_DISTANCE_ROUNDS):
        out += f", d{i + 1} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{i} UNION ALL SELECT dst, dist + w FROM d{i} JOIN f ON id = src) GROUP BY id)"
    last = _DISTANCE_ROUNDS
    return out + f" SELECT * FROM d{last} WHERE NOT EXISTS (SELECT * FROM d{last} EXCEPT SELECT * FROM d{last - 1})"


def _lpa_sql(rounds: int) -> str:
    out = f"WITH {E_SQL}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT p_partkey AS id, p_partkey AS label FROM part)"
    for i in range(rounds):
        out += f", l{i + 1} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, label) AS r FROM (SELECT dst AS id, label, 1 AS w FROM b JOIN l{i} ON id = src UNION ALL SELECT id, label, 1 FROM l{i}) GROUP BY id, label) WHERE r = 1)"
    return out + f" SELECT id, label FROM l{rounds}"


T_SQL = ", t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND y.a < y.b), c AS (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id)"


def _round(df: DataFrame, name: str, digits: int = 9) -> DataFrame:
    return df.withColumn(name, F.round(name, digits))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_ids(spark, sf_dir)
    return p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(p.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


P_SQL = ", p AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)), g AS (SELECT a, list(b) AS n FROM u GROUP BY a)"
J_SQL = "FROM p LEFT JOIN g x ON x.a = p.a LEFT JOIN g y ON y.a = p.b"
#: Name: (function of ids and edges, SQL or None).
ALGORITHMS: dict[str, tuple[Callable, str | None]] = {
    "algo_pagerank": (lambda s, d: _round(A.pagerank(part_ids(s, d), part_edges(s, d), _ROUNDS), "rank"), _pagerank_sql()),
    "algo_personalized_pagerank": (lambda s, d: _round(A.personalized_pagerank(part_ids(s, d), part_edges(s, d), 1, 3), "score"), _seeded_sql("1", 3, 1, 0.15, 0.85, "3") + " AND 1 IN (SELECT src FROM e)"),
    "algo_weighted_pagerank": (lambda s, d: _round(A.weighted_pagerank(part_ids(s, d), part_edges(s, d), 3), "rank"), _weighted_pagerank_sql(3)),
    "algo_trustrank": (lambda s, d: _round(A.trustrank(part_ids(s, d), part_edges(s, d), [1, 2, 3], 3), "score"), _seeded_sql("1, 2, 3", 3, 1 / 3, 0.05, 0.85, "3")),
    "algo_sybilrank": (lambda s, d: _round(A.sybilrank(part_ids(s, d), part_edges(s, d), [1, 2, 3]), "score"), _seeded_sql("1, 2, 3", 16, 1, 0, 1, "(SELECT ceil(ln(count(*))) FROM part)")),
    "algo_hits": (lambda s, d: _round(_round(A.hits(part_ids(s, d), part_edges(s, d), 3), "authority"), "hub"), _hits_sql(3)),
    "algo_wcc": (
        lambda s, d: A.wcc(part_ids(s, d), part_edges(s, d)),
        f"WITH RECURSIVE {U_SQL}, r AS (SELECT p_partkey AS id, (SELECT min(p_partkey) FROM part) AS m FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part) UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id) SELECT p_partkey AS id, coalesce(r.m, p_partkey) AS label FROM part LEFT JOIN r ON r.id = p_partkey",
    ),
    "algo_scc": (lambda s, d: A.scc(part_ids(s, d), part_edges(s, d)), None),
    "algo_bfs": (
        lambda s, d: A.bfs(part_edges(s, d), 1).select("id", "depth"),
        f"WITH RECURSIVE {E_SQL}, r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 8) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY id",
    ),
    "algo_sssp": (lambda s, d: A.sssp(part_edges(s, d), 1), _distance_sql([1])),
    "algo_mssp": (lambda s, d: A.mssp(part_edges(s, d), [1, 2, 3]), _distance_sql([1, 2, 3])),
    "algo_egonet": (lambda s, d: s.createDataFrame([(A.egonet(part_edges(s, d), 1, 1),)], "n long"), f"WITH {E_SQL} SELECT count(DISTINCT x) AS n FROM (SELECT dst AS x FROM e WHERE src = 1 UNION ALL SELECT 1)"),
    "algo_lpa": (lambda s, d: A.label_propagation(part_ids(s, d), part_edges(s, d).select("src", "dst"), 2), _lpa_sql(2)),
    "algo_wlpa": (lambda s, d: A.weighted_label_propagation(part_ids(s, d), part_edges(s, d), 2), None),
    "algo_slpa": (lambda s, d: A.speaker_listener(part_ids(s, d), part_edges(s, d), 3), None),
    "algo_louvain": (lambda s, d: A.louvain(part_ids(s, d), part_edges(s, d)), None),
    "algo_leiden": (lambda s, d: A.leiden(part_ids(s, d), part_edges(s, d)), None),
    "algo_triangles": (lambda s, d: A.triangle_count(part_ids(s, d), part_edges(s, d)), f"WITH {U_SQL}{T_SQL} SELECT p_partkey AS id, coalesce(n, 0) AS triangles FROM part LEFT JOIN c ON id = p_partkey"),
    "algo_lcc": (
        lambda s, d: _round(A.local_clustering(part_ids(s, d), part_edges(s, d)), "score"),
        f"WITH {U_SQL}{T_SQL}, d AS (SELECT a, count(*) AS d FROM u GROUP BY a) SELECT p_partkey AS id, round(CASE WHEN d >= 2 THEN 2 * coalesce(n, 0)::DOUBLE / (d * (d - 1)) ELSE 0 END, 9) AS score FROM part LEFT JOIN c ON c.id = p_partkey LEFT JOIN d ON d.a = p_partkey",
    ),
    "algo_jaccard": (lambda s, d: _round(A.jaccard(part_edges(s, d), _pairs(s, d)), "similarity"), f"WITH {U_SQL}{P_SQL} SELECT p.a, p.b, round(CASE WHEN x.n IS NULL AND y.n IS NULL THEN 1 WHEN x.n IS NULL OR y.n IS NULL THEN 0 ELSE len(list_intersect(x.n, y.n))::DOUBLE / len(list_distinct(x.n || y.n)) END, 9) AS similarity {J_SQL}"),
    "algo_common_neighbours": (lambda s, d: A.common_neighbours(part_edges(s, d), _pairs(s, d)), f"WITH {U_SQL}{P_SQL} SELECT p.a, p.b, coalesce(len(list_intersect(x.n, y.n)), 0) AS common {J_SQL}"),
    "algo_degree_correlation": (
        lambda s, d: s.createDataFrame([(round(A.degree_correlation(part_edges(s, d)), 6),)], "r double"),
        f"WITH {E_SQL}, d AS (SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY src) SELECT round(corr(x.d, coalesce(y.d, 0)), 6) AS r FROM e JOIN d x ON x.src = e.src LEFT JOIN d y ON y.src = e.dst",
    ),
    "algo_kcore": (lambda s, d: A.kcore(part_ids(s, d), part_edges(s, d), 3), None),
    "algo_ktruss": (lambda s, d: A.ktruss(part_edges(s, d), 4), None),
    "algo_kcliques": (lambda s, d: A.kcliques(part_edges(s, d), 3), f"WITH {U_SQL}{T_SQL} SELECT id, n AS cliques FROM c"),
    "algo_locate_cycle": (
        lambda s, d: s.createDataFrame([(A.locate_cycles(part_edges(s, d), 3),)], "n long"),
        f"WITH {E_SQL} SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst",
    ),
    "algo_subgraph_isomorphism": (
        lambda s, d: A.subgraph_isomorphism(part_ids(s, d), part_edges(s, d), [[1], [2], []]).agg(F.count("*").alias("n")),
        f"WITH {E_SQL}, q AS (SELECT DISTINCT src, dst FROM e) SELECT count(*) AS n FROM q x JOIN q y ON x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst",
    ),
    "algo_motif": (lambda s, d: A.motif(part_edges(s, d), [1, 2, 3], 3), None),
    "algo_mis": (lambda s, d: A.maximal_independent_set(part_ids(s, d), part_edges(s, d)), None),
    "algo_spsp": (
        lambda s, d: s.createDataFrame([(A.spsp(part_edges(s, d), 1, 2),)], "hops long"),
        f"WITH RECURSIVE {E_SQL}, r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 20) SELECT CAST(coalesce(min(depth), -1) AS BIGINT) AS hops FROM r WHERE id = 2",
    ),
    "algo_all_shortest_paths": (
        lambda s, d: A.all_shortest_paths(part_edges(s, d), 1, 2).select(F.size("nodes").alias("n"), "cost"),
        f"WITH RECURSIVE {E_SQL}, r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 20), l AS (SELECT id, min(depth) AS d FROM r GROUP BY id), "
        "p AS (SELECT id, d FROM l WHERE id = 2 UNION ALL SELECT e.src, p.d - 1 FROM p JOIN e ON e.dst = p.id JOIN l ON l.id = e.src AND l.d = p.d - 1) "
        "SELECT CAST(m + 1 AS INTEGER) AS n, m::DOUBLE AS cost FROM p, (SELECT d AS m FROM l WHERE id = 2) WHERE p.d = 0",
    ),
    "algo_closeness": (
        lambda s, d: _round(A.closeness(part_edges(s, d).drop("weight"), [1, 2]), "score"),
        f"WITH RECURSIVE {E_SQL}, f AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT unnest([1, 2])::BIGINT AS root, unnest([1, 2])::BIGINT AS id, 0 AS depth UNION SELECT root, src, depth + 1 FROM r JOIN f ON dst = id WHERE depth < 20), d AS (SELECT root, id, min(depth) AS dist FROM r GROUP BY root, id) SELECT id, round(count(*) / sum(dist)::DOUBLE, 9) AS score FROM d WHERE root <> id GROUP BY id",
    ),
    "algo_betweenness": (lambda s, d: _round(A.betweenness(part_edges(s, d), [1, 2]), "score"), None),
    "algo_dimension": (
        lambda s, d: s.createDataFrame([(A.dimension_estimation(part_edges(s, d), [1, 2]),)], "depth long"),
        f"WITH RECURSIVE {U_SQL}, r AS (SELECT unnest([1, 2])::BIGINT AS root, unnest([1, 2])::BIGINT AS id, 0 AS depth UNION SELECT root, b, depth + 1 FROM r JOIN u ON a = id WHERE depth < 20) SELECT CAST(max(dist) AS BIGINT) AS depth FROM (SELECT root, id, min(depth) AS dist FROM r GROUP BY root, id)",
    ),
    "algo_apsp_nations": (lambda s, d: A.apsp(trade_graph(s, d).pairs(["IN_REGION", "BASED_IN"])).select("root", "id", F.col("dist").cast("long").alias("dist")), f"SELECT s_suppkey + {3 * STEP} AS root, s_nationkey + {STEP} AS id, 1 AS dist FROM supplier UNION ALL SELECT s_suppkey + {3 * STEP}, n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey + {STEP}, n_regionkey, 1 FROM nation"),
    "algo_belief": (lambda s, d: _round(A.belief_propagation(part_ids(s, d).withColumn("prior", F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.4)), part_edges(s, d), 2), "belief"), None),
    "sample_neighbours": (lambda s, d: sampling.neighbours(part_edges(s, d), part_ids(s, d), 5), None),
    "sample_random_walks": (lambda s, d: sampling.random_walks(part_edges(s, d), part_ids(s, d), 3), None),
    "sample_node2vec": (lambda s, d: sampling.node2vec_walks(part_edges(s, d), part_ids(s, d), 4, 1, 0.5, 2.0), None),
    "sample_negative_edges": (lambda s, d: sampling.negative_edges(part_edges(s, d), part_ids(s, d), 100), None),
    "sample_edges": (lambda s, d: sampling.edge_sample(part_edges(s, d), 0.1), None),
    "vector_knn": (
        lambda s, d: vectors.knn(table(s, d, "embeddings").withColumnRenamed("vec_id", "_vid"), "embedding", [0.1] * 64, 10).select(F.col("_vid").alias("id"), F.round("distance", 6).alias("distance")),
        "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) * (x::DOUBLE - 0.1))), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10",
    ),
    "vector_range": (
        lambda s, d: vectors.within_radius(table(s, d, "embeddings"), "embedding", [0.0] * 63 + [1.0], 1.9).select(F.col("vec_id").alias("id")),
        "SELECT vec_id AS id FROM embeddings WHERE list_sum(list_transform(embedding[1:63], lambda x: x::DOUBLE * x::DOUBLE)) + (embedding[64]::DOUBLE - 1) * (embedding[64]::DOUBLE - 1) <= 1.9",
    ),
    "fulltext_bm25": (lambda s, d: _round(fulltext.search(table(s, d, "documents"), "text", "the and", 10, "doc_id"), "score", 6), None),
    "series_as_of": (
        lambda s, d: series.as_of(table(s, d, "events").select("event_id", "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")), event_graph(s, d).series["User", "readings"], "user_id", "day").select("event_id", "value"),
        f"WITH {S_SQL} SELECT event_id, (SELECT arg_max(s.value, s.ts) FROM s WHERE s.user_id = e.user_id AND s.ts <= date_trunc('day', e.ts)) AS value FROM events e",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _cypher(v[0]) for k, v in CYPHER.items()} | {k: _write(v[0], v[1]) for k, v in WRITES.items()} | {k: _cypher(v[0], event_graph) for k, v in SERIES.items()} | {k: v[0] for k, v in ALGORITHMS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in (CYPHER | SERIES | ALGORITHMS).items() if v[1]} | {k: v[2] for k, v in WRITES.items()}
