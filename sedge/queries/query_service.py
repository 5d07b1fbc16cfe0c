"""Queries of the declarative request service and of the guarded SQL front."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import functions as F

from ..catalog import list_columns, list_tables, read_jdbc, register_tables, write_jdbc
from ..plans.guard import FORBIDDEN, answer, check_statements, parse_point, point_columns
from ..plans.rewrite import FLATTENING, SEMI_MAJOR
from ..plans.spec import QuerySpec, SpecCompiler, first_hit, run_query
from ..session import table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _all(spec: QuerySpec):
    """A query of all rows of a request."""

    def run(spark, sf_dir):
        register_tables(spark, sf_dir, STAR)
        return SpecCompiler(spark).relation(spec)

    return run


def _page(spec: QuerySpec):
    def run(spark, sf_dir):
        register_tables(spark, sf_dir, STAR)
        return run_query(spark, spec).page

    return run


def _total(spec: QuerySpec):
    def run(spark, sf_dir):
        register_tables(spark, sf_dir, STAR)
        return run_query(spark, spec).total

    return run


def scan_table(spark, sf_dir):
    return table(spark, sf_dir, "nation")


def tables(spark, sf_dir):
    register_tables(spark, sf_dir, STAR)
    return list_tables(spark).where(F.col("name").isin(*STAR))


def columns(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders",))
    return list_columns(spark, "orders")


def join_types(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    out = None
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        joined = c.where("c_acctbal > 0").join(o.where("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, how)
        part = joined.agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.count("c_custkey").alias("customers"))
        out = part if out is None else out.unionByName(part)
    return out


def _answered(statement: str):
    """A statement's rows through the guarded front."""

    def run(spark, sf_dir):
        register_tables(spark, sf_dir, STAR)
        return answer(spark, statement, list(STAR))

    return run


#: One partner for each condition of a star, a chain behind one of them, and partners that are tied in a ring.
SEMI = {
    "join_to_semi": "SELECT c.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN orders o ON c.c_custkey = o.o_custkey WHERE n.n_regionkey = 1 AND o.o_totalprice > 100000",
    "join_star_semi": "SELECT * FROM lineitem l INNER JOIN part p ON l.l_partkey = p.p_partkey AND p_size > 20 JOIN supplier AS s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN events e ON e.user_id = c.c_custkey WHERE s.s_acctbal > 0 AND c.c_mktsegment = 'BUILDING' AND l_quantity < 30",
    "join_ring_semi": "SELECT o.* FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_nationkey = c.c_nationkey AND s.s_suppkey % 7 = o.o_orderkey % 7 WHERE o.o_orderkey % 3 = 0",
}


def site_view(spark, sf_dir):
    """Points of a zone about 120 degrees east, as eastings and northings, by the forward series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    root = 2 * math.sqrt(n) / (1 + n)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.lit(118.5) + (F.col("c_custkey") % 3000) / 1000).alias("lon"), (F.col("c_nationkey") * 2.5 - 20).alias("lat"))
    lat, lon = F.radians("lat"), F.radians(F.col("lon") - 120)
    t = F.sinh(F.atanh(F.sin(lat)) - F.lit(root) * F.atanh(F.lit(root) * F.sin(lat)))
    c = c.withColumns({"xi": F.atan2(t, F.cos(lon)), "eta": F.atanh(F.sin(lon) / F.sqrt(1 + t * t))})
    up = F.col("xi") + sum(F.lit(a) * F.sin(2 * k * F.col("xi")) * F.cosh(2 * k * F.col("eta")) for k, a in enumerate(forth, 1))
    across = F.col("eta") + sum(F.lit(a) * F.cos(2 * k * F.col("xi")) * F.sinh(2 * k * F.col("eta")) for k, a in enumerate(forth, 1))
    return c.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 11 != 0, F.struct((F.lit(500000.0) + F.lit(radius) * across).alias("x"), (F.lit(radius) * up).alias("y"))).alias("geom"))


def geo_reproject(spark, sf_dir):
    """Points in degrees beside the columns of a statement, from a table in metres."""
    site_view(spark, sf_dir).createOrReplaceTempView("sites")
    found = answer(spark, "SELECT s.* FROM sites s WHERE c_mktsegment <> 'BUILDING'", ["sites"], {"sites": 4549})
    return found.select("c_custkey", "c_mktsegment", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), (F.get_json_object("geojson", "$.type")).alias("kind"))


def jdbc_scan(spark, sf_dir):
    """Orders written to a database and read back in parallel, filtered there. The database is the one that Spark ships,
    inside the driver's process, unless spark.sedge.jdbc.url names another (which a cluster needs)."""
    conn = {"url": spark.conf.get("spark.sedge.jdbc.url", None) or f"jdbc:derby:{tempfile.mkdtemp(prefix='sedge-')}/db;create=true"}
    write_jdbc(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "", conn, "orders", "o_orderstatus VARCHAR(1)")
    rows = read_jdbc(spark, "", conn, "orders", partition_column="o_orderkey", rows_each=5000)
    return rows.where("o_totalprice > 100000 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


def set_ops(spark, sf_dir):
    c, s = (table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("nationkey")) for t in ("customer", "supplier"))
    o = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"))
    parts = {"union": c.union(s).distinct(), "union_all": c.unionAll(s), "intersect": c.intersect(s), "except": o.exceptAll(s.distinct())}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("nationkey").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


def first_hit_query(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders",))
    tries = ["SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 0", "SELECT no_such_column FROM orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000", "SELECT o_orderkey, o_totalprice FROM orders"]
    hit, rows = first_hit([lambda q=q: spark.sql(q) for q in tries])
    return rows.withColumn("hit_index", F.lit(hit))


def sql_guard(spark, sf_dir):
    """Statements made of the tables' own values, so that the list grows with them."""
    e = table(spark, sf_dir, "events")
    verb = F.element_at(F.array(*[F.lit(x) for x in ("SELECT * FROM Orders WHERE k = ", "  select a.* from customer a where a.k = ", "DELETE FROM orders WHERE k = ", "SELECT 'drop it' FROM orders WHERE k = ", "SELECT * FROM secrets WHERE k = ", "UPDATE orders SET k = ", "SELECT updated FROM orders WHERE k = ")]), (F.col("event_id") % 7 + 1).cast("int"))
    s = e.select("event_id", F.concat(verb, F.col("user_id").cast("string")).alias("statement"))
    return check_statements(s, "statement", ["orders", "customer"])


def geo_point(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 360 - 180)).alias("lon"), (F.col("c_nationkey") * 3 - 40).alias("lat"))
    geojson, _, _ = point_columns(F.col("lon"), F.col("lat"))
    seen = c.select("c_custkey", geojson.alias("geojson"))
    lon, lat = parse_point(F.col("geojson"))
    return seen.withColumn("lon", lon).withColumn("lat", lat)


HAVING = QuerySpec(
    source="orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    select="c.c_mktsegment, count(*) AS n, round(max(o.o_totalprice), 2) AS most",
    where="o.o_orderstatus = {F}",
    args=[["o.o_totalprice", ">", 1000], ["c.c_acctbal", ">=", "-500", "and"]],
    group_by="c.c_mktsegment",
    having="count(*) > {5}",
    order_by="c.c_mktsegment",
)
JOINED = QuerySpec(source="customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000", select="c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice", where="c.c_nationkey < {10}")
PAGED = QuerySpec(source="orders", select=["o_orderkey", "o_totalprice"], args=[{"field": "o_orderkey", "operator": "between", "value": "100,900"}], order_by="o_totalprice DESC, o_orderkey", limit="15", offset=30)

QUERIES = {
    "scan_table": scan_table,
    "list_tables": tables,
    "list_columns": columns,
    "query_select": _all(QuerySpec("orders", select=["o_orderkey", "o_orderstatus", "o_totalprice"], where="o_totalprice > {100000}")),
    "where_template": _all(QuerySpec("orders", select="o_orderkey, o_orderpriority", where="o_orderpriority = {1-URGENT} AND o_totalprice < {1.5e5} AND o_orderstatus <> {it's}")),
    "where_merge": _all(QuerySpec("customer", select="c_custkey", where="c_nationkey = {1} OR c_nationkey = {2}", args=[["c_acctbal", ">", 0], ["c_mktsegment", "=", "BUILDING", "or"]])),
    "args_compare": _all(QuerySpec("orders", select="o_orderkey", args=[["o_totalprice", ">=", "50000"], ["o_totalprice", "<", 90000], ["o_orderkey", "!=", 7], ["o_custkey", "<=", 400]])),
    "args_like": _all(QuerySpec("customer", select="c_custkey, c_name", args=[["c_name", "like", "1"], ["c_name", "not like", "2_"]])),
    "args_in": _all(QuerySpec("orders", select="o_orderkey", args=[["o_custkey", "in", "1, 2,3, x"], ["o_orderstatus", "not in", ["P"], "and"]])),
    "args_between": _all(QuerySpec("orders", select="o_orderkey", args=[["o_orderkey", "between", "10,50"]])),
    "args_null": _all(QuerySpec("customer LEFT JOIN orders ON c_custkey = o_custkey", select="c_custkey", args=[["o_orderkey", "is null"], ["c_name", "is not null"]])),
    "args_andor": _all(QuerySpec("orders", select="o_orderkey", args=[["o_orderstatus", "=", "F", "or"], ["o_totalprice", ">", 200000, "and"], ["o_orderstatus", "=", "O", "or"], ["o_totalprice", "<", 20000, "weird"]])),
    "query_join_left": _all(JOINED),
    "join_types": join_types,
    **{name: _answered(statement) for name, statement in SEMI.items()},
    "geo_reproject": geo_reproject,
    "jdbc_scan": jdbc_scan,
    "query_group": _all(QuerySpec("lineitem", select="l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount", group_by="l_returnflag, l_linestatus")),
    "query_having": _all(HAVING),
    "query_total": _total(HAVING),
    "query_rollup": _all(QuerySpec("nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey", select="r_name, n_name, count(*) AS n", group_by="ROLLUP(r_name, n_name)")),
    "query_page": _page(PAGED),
    "order_spec": _page(QuerySpec("customer", select=["c_custkey", "c_acctbal"], order_by=[{"field": "c_acctbal", "direction": "desc"}, {"field": "c_custkey", "direction": "up"}], limit=50)),
    "set_ops": set_ops,
    "first_hit": first_hit_query,
    "sql_guard": sql_guard,
    "geo_point": geo_point,
}

_JOIN = "FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {0} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey"
ORACLE = {
    "scan_table": "SELECT * FROM nation",
    "list_tables": f"SELECT name FROM (VALUES {', '.join(f'({x!r})' for x in STAR)}) t(name)",
    "list_columns": "SELECT 'orders' AS tabname, CAST(i AS INTEGER) AS id, n AS name, t AS type, true AS nullable FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) v(i, n, t)",
    "query_select": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "where_template": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 150000 AND o_orderstatus <> 'it''s'",
    "where_merge": "SELECT c_custkey FROM customer WHERE (c_nationkey = 1 OR c_nationkey = 2) AND (c_acctbal > 0 OR c_mktsegment = 'BUILDING')",
    "args_compare": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 90000 AND o_orderkey <> 7 AND o_custkey <= 400",
    "args_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' AND c_name NOT LIKE '%2_%'",
    "args_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3) AND o_orderstatus NOT IN ('P')",
    "args_between": "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 50",
    "args_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL AND c_name IS NOT NULL",
    "args_andor": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 20000)",
    "query_join_left": "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000 WHERE c.c_nationkey < 10",
    "join_types": " UNION ALL ".join(f"SELECT '{n}' AS how, count(*) AS n, count(c.c_custkey) AS customers {_JOIN.format(sql)}" for n, sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", "SEMI"), ("left_anti", "ANTI"))),
    "join_to_semi": "SELECT c.* FROM customer c WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "join_star_semi": """SELECT l.* FROM lineitem l WHERE l_quantity < 30 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""",
    "join_ring_semi": "SELECT o.* FROM orders o WHERE o.o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM customer c, supplier s WHERE c.c_custkey = o.o_custkey AND s.s_nationkey = c.c_nationkey AND s.s_suppkey % 7 = o.o_orderkey % 7)",
    "geo_reproject": """SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 <> 0 THEN round(118.5::DOUBLE + (c_custkey % 3000) / 1000, 6) END AS lon, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey * 2.5::DOUBLE - 20 END AS lat,
CASE WHEN c_custkey % 11 <> 0 THEN 'Point' END AS kind FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "jdbc_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "query_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL",
    "query_having": "SELECT c.c_mktsegment, count(*) AS n, round(max(o.o_totalprice), 2) AS most FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND c_acctbal >= -500 GROUP BY c.c_mktsegment HAVING count(*) > 5",
    "query_total": "SELECT count(*) AS total FROM (SELECT c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND c_acctbal >= -500 GROUP BY c.c_mktsegment HAVING count(*) > 5)",
    "query_rollup": "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP(r_name, n_name)",
    "query_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30",
    "order_spec": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    "set_ops": """WITH c AS (SELECT c_nationkey AS nationkey FROM customer), s AS (SELECT s_nationkey AS nationkey FROM supplier), o AS (SELECT n_nationkey AS nationkey FROM nation)
SELECT 'union' AS op, count(*) AS n, CAST(sum(nationkey) AS BIGINT) AS keys FROM (SELECT * FROM c UNION SELECT * FROM s)
UNION ALL SELECT 'union_all', count(*), CAST(sum(nationkey) AS BIGINT) FROM (SELECT * FROM c UNION ALL SELECT * FROM s)
UNION ALL SELECT 'intersect', count(*), CAST(sum(nationkey) AS BIGINT) FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'except', count(*), CAST(sum(nationkey) AS BIGINT) FROM (SELECT * FROM o EXCEPT SELECT * FROM s)""",
    "first_hit": "SELECT o_orderkey, o_totalprice, CAST(2 AS INTEGER) AS hit_index FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
    "sql_guard": """WITH s AS (SELECT event_id, ['SELECT * FROM Orders WHERE k = ', '  select a.* from customer a where a.k = ', 'DELETE FROM orders WHERE k = ', 'SELECT ''drop it'' FROM orders WHERE k = ', 'SELECT * FROM secrets WHERE k = ', 'UPDATE orders SET k = ', 'SELECT updated FROM orders WHERE k = '][event_id % 7 + 1] || user_id AS statement FROM events)
SELECT event_id, statement, regexp_extract(lower(statement), '\\bfrom\\s+([a-z0-9_]+)', 1) AS table_name,
       regexp_matches(lower(statement), '^\\s*select\\b') AND NOT regexp_matches(lower(statement), '\\b(""" + "|".join(FORBIDDEN) + """)\\b')
       AND regexp_extract(lower(statement), '\\bfrom\\s+([a-z0-9_]+)', 1) IN ('orders', 'customer') AS allowed FROM s""",
    "geo_point": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 360 - 180 END AS x, c_nationkey * 3 - 40 AS y FROM customer)
SELECT c_custkey, CASE WHEN x IS NOT NULL THEN '{"type":"Point","coordinates":[' || x || ',' || y || ']}' END AS geojson,
       CASE WHEN x IS NOT NULL THEN CAST(x AS DOUBLE) END AS lon, CASE WHEN x IS NOT NULL THEN CAST(y AS DOUBLE) END AS lat FROM c""",
}
