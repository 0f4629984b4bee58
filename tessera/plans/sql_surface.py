"""Queries that arrive as SQL text: joins, aggregates, windows, sets, limits and scalar functions through the gate."""

from __future__ import annotations

import re

from tessera.engine import Engine
from tessera.registry import query
from tessera.sources.tables import TABLES

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)"


def _money(x: str) -> str:
    """Exact sum of amounts, as a double: independent of the order of rows."""
    return _MONEY.format(x)


#: name -> (SQL that both engines run, tables)
BOTH: dict[str, str] = {
    # joins
    "revenue_by_region": f"""SELECT r.r_name AS region, COALESCE({_money('o.o_totalprice')}, 0) AS revenue, count(*) AS n_orders
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        WHERE o.o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY r.r_name ORDER BY revenue DESC, region""",
    "fk_join": "SELECT n.n_name AS nation, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "composite_join": "SELECT a.l_orderkey AS orderkey, a.l_linenumber AS linenumber, b.l_quantity AS quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'R' AND a.l_quantity > 49",
    "self_join": "SELECT a.s_suppkey AS first_key, b.s_suppkey AS second_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "semi_join": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 1000)",
    "anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 100000)",
    "optional_left": "SELECT c.c_custkey, COALESCE(o.o_orderkey, -1) AS o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    "between_join": f"SELECT c.c_mktsegment AS segment, {_money('o.o_totalprice')} AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE CAST(o.o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND CURRENT_DATE GROUP BY c.c_mktsegment",
    # aggregates
    "agg_count": "SELECT count(*) AS total FROM lineitem",
    "agg_sum_group": f"SELECT l_returnflag, l_linestatus, {_money('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_avg": f"SELECT {_money('l_quantity')} / count(l_quantity) AS mean FROM lineitem WHERE l_discount > 0.05",
    "agg_minmax": "SELECT min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_name) AS first_name, max(p_size) AS largest FROM part",
    "sum_if_diff": "SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) - sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS difference FROM lineitem",
    "sum_if_total": f"SELECT {_money('CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN l_extendedprice ELSE 0 END')} - {_money('CASE WHEN l_returnflag = ' + chr(39) + 'A' + chr(39) + ' THEN l_extendedprice ELSE 0 END')} AS difference FROM lineitem",
    "sum_if_ratio": "SELECT CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), 0) AS ratio FROM lineitem",
    "sum_if_year": "SELECT CAST(sum(CASE WHEN CAST(o_orderdate AS VARCHAR(30)) LIKE '%1995%' THEN 1 ELSE 0 END) AS BIGINT) AS y1995, CAST(sum(CASE WHEN CAST(o_orderdate AS VARCHAR(30)) LIKE '%1996%' THEN 1 ELSE 0 END) AS BIGINT) AS y1996 FROM orders",
    "agg_having": "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "count_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem",
    "count_classes_props": "SELECT count(DISTINCT CASE WHEN kind = 'class' THEN name END) AS classes, count(DISTINCT CASE WHEN kind = 'property' THEN name END) AS properties FROM (SELECT 'class' AS kind, p_brand AS name FROM part UNION ALL SELECT 'property', p_type FROM part) t",
    "grouped_min_key": "SELECT n_regionkey, min(lower(COALESCE(n_name, CAST(n_nationkey AS VARCHAR(20))))) AS sort_key FROM nation GROUP BY n_regionkey",
    "rollup_pass": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_pass": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets_pass": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # windows
    "win_running_sum": f"SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS running FROM orders",
    "win_rank": "SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place FROM supplier",
    "win_neighbours": "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after_role FROM conversations",
    "topk_per_group": "SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) t WHERE place <= 5",
    "canonical_label": "SELECT c_nationkey, c_mktsegment AS label FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer GROUP BY c_nationkey, c_mktsegment) t WHERE place = 1",
    # sets, order, limits
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "multi_key_order": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus ORDER BY n DESC, o_orderpriority, o_orderstatus",
    "entity_page": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 25 OFFSET 50",
    "metric_page": "SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 10 GROUP BY p_brand ORDER BY p_brand LIMIT 10 OFFSET 5",
    "history_page": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20 OFFSET 10",
    "cross_source_join": "SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "values_join": "SELECT n.n_name, v.code FROM nation n JOIN (VALUES (0, 'a'), (1, 'b'), (7, 'c')) AS v(k, code) ON n.n_nationkey = v.k",
    # scalar functions
    "sparql_builtins": "SELECT n_nationkey, lower(n_name) AS low, CASE WHEN lower(n_name) LIKE '%an%' THEN 1 ELSE 0 END AS has_an, CASE WHEN n_name LIKE 'A%' THEN 1 ELSE 0 END AS starts_a, COALESCE(CAST(n_regionkey AS VARCHAR(10)), '') AS region_text, replace(n_name, 'A', '_') AS replaced FROM nation",
    "lcase_eq": "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'",
    "fn_substr": "SELECT p_partkey, substring(p_name, 2, 5) AS part_of_name FROM part",
    "fn_date_add": "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS VARCHAR(10)) AS due FROM orders",
    "fn_date_trunc": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "fn_extract": "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "fn_concat": "SELECT c_custkey, c_name || ':' || c_mktsegment AS joined, concat(c_name, '/', c_mktsegment) AS also FROM customer",
    "fn_nullif": "SELECT s_nationkey, CAST(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END), 0) AS ratio FROM supplier GROUP BY s_nationkey",
    "bgp_filter_order": "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 ORDER BY balance DESC, name",
    "count_filtered": "SELECT count(*) AS n FROM documents WHERE lang = 'en' AND source IS NOT NULL",
}
#: name -> (Spark SQL, SQL of the oracle), where functions or formats differ between the two
APART: dict[str, tuple[str, str]] = {
    "agg_group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "fn_date_str": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS day_text FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day_text FROM orders"),
    "time_grain": (
        "SELECT grain, date_format(date_trunc(grain, ts), 'yyyy-MM-dd') AS bucket, count(*) AS n FROM events LATERAL VIEW explode(array('DAY', 'WEEK', 'MONTH', 'QUARTER', 'YEAR')) g AS grain GROUP BY 1, 2",
        "SELECT grain, strftime(date_trunc(lower(grain), ts), '%Y-%m-%d') AS bucket, count(*) AS n FROM events, (VALUES ('DAY'), ('WEEK'), ('MONTH'), ('QUARTER'), ('YEAR')) g(grain) GROUP BY 1, 2",
    ),
    "fn_series": ("SELECT y, count(o_orderkey) AS n FROM (SELECT explode(sequence(1992, 1999)) AS y) s LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y", "SELECT y::INT AS y, count(o_orderkey) AS n FROM generate_series(1992, 1999) s(y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y"),
    "json_props": ("SELECT CAST(from_json(props, 'k INT').k AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"),
    "events_tumbling": ("SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS day_start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
#: Queries without a stated SQL equal: the sketches' results are the engine's own.
ALONE: dict[str, str] = {
    "approx_distinct": "SELECT approx_count_distinct(l_partkey, 0.02) AS parts FROM lineitem",
}


def _run(sql: str):
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]  # other tables' files aren't looked at
    return lambda spark, sf_dir: Engine(spark, sf_dir, names).sql(sql, max_rows=None)


for _name, _sql in BOTH.items():
    query(_name, _sql)(_run(_sql))
for _name, (_spark, _duck) in APART.items():
    query(_name, _duck)(_run(_spark))
for _name, _sql in ALONE.items():
    query(_name)(_run(_sql))


@query("limit_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_cap(spark, sf_dir):
    """An outer LIMIT beyond the cap is lowered to it; the inner one stays."""
    return Engine(spark, sf_dir).sql("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000) t ORDER BY o_orderkey LIMIT 999999", max_rows=100)


@query("metric_exec", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_nationkey = 7 AND c_mktsegment <> 'x''y' GROUP BY 1")
def metric_exec(spark, sf_dir):
    """A metric's template with dimensions bound as parameters."""
    from tessera.operators.metrics import run_metric

    template = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_nationkey = :nation AND c_mktsegment <> {other} GROUP BY 1"
    return run_metric(Engine(spark, sf_dir), template, {"nation": 7, "other": "x'y"}, allowed={"nation", "other"})


@query("table_allow_list", "SELECT r_regionkey, r_name FROM region")
def table_allow_list(spark, sf_dir):
    """A statement that passes an allow-list and a column deny-list."""
    from tessera.operators.sqlgate import Profile

    profile = Profile(frozenset({"region", "nation"}), {"nation": frozenset({"n_name"})})
    return Engine(spark, sf_dir).sql("SELECT r_regionkey, r_name FROM region", profile)


@query("truncation_flag", "SELECT 50 AS kept, count(*) > 50 AS truncated FROM customer")
def truncation_flag(spark, sf_dir):
    from pyspark.sql import functions as F

    e = Engine(spark, sf_dir)
    most = 50
    rows = e.table("customer").select("c_custkey").limit(most + 1).agg(F.count("*").alias("n"))
    return rows.select(F.least("n", F.lit(most)).cast("int").alias("kept"), (F.col("n") > most).alias("truncated"))
