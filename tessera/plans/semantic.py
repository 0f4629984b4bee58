"""SPARQL over the mapped tables, and the knowledge graph's traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import graphs
from tessera.operators.sparql import Compiler
from tessera.registry import query

_DEC = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)"

#: name -> (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "sparql_filter_order": ('SELECT ?name ?bal WHERE { ?c a :Customer ; :name ?name ; :acctbal ?bal . FILTER(?bal > 9000) } ORDER BY DESC(?bal) ?name', "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000"),
    "bgp_star": ('SELECT ?name ?brand ?size WHERE { ?p a :Part ; :name ?name ; :brand ?brand ; :size ?size . FILTER(?size <= 5 && CONTAINS(?brand, "1")) }', "SELECT p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_size <= 5 AND contains(p_brand, '1')"),
    "sparql_join": ('SELECT ?rn (COUNT(?c) AS ?n) WHERE { ?c a :Customer ; :nation ?x . ?x :region ?r . ?r a :Region ; :name ?rn } GROUP BY ?rn', "SELECT r_name AS rn, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "sparql_distinct": ("SELECT DISTINCT ?seg WHERE { ?c a :Customer ; :mktsegment ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "sparql_count": ("SELECT (COUNT(?p) AS ?total) WHERE { ?p a :Part }", "SELECT count(*) AS total FROM part"),
    "sparql_sum_if": ('SELECT (SUM(IF(?f = "R", 1, 0)) - SUM(IF(?f = "A", 1, 0)) AS ?diff) WHERE { ?l a :Lineitem ; :returnflag ?f }', "SELECT CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) - sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) AS BIGINT) AS diff FROM lineitem"),
    "sparql_having": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o a :Orders ; :customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "sparql_union": ('SELECT ?n WHERE { { ?c a :Customer ; :name ?n ; :acctbal ?b . FILTER(?b > 9900) } UNION { ?s a :Supplier ; :name ?n ; :acctbal ?b . FILTER(?b > 9500) } }', "SELECT c_name AS n FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 9500"),
    "sparql_optional": ('SELECT ?name ?st WHERE { ?c a :Customer ; :name ?name . OPTIONAL { ?o a :Orders ; :customer ?c ; :orderstatus ?st . FILTER(?st = "P") } }', "SELECT c_name AS name, o_orderstatus AS st FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"),
    "sparql_values": ('SELECT ?name ?r WHERE { ?n a :Nation ; :name ?name ; :region ?r . VALUES ?r { 1 3 } }', "SELECT n_name AS name, n_regionkey AS r FROM nation WHERE n_regionkey IN (1, 3)"),
    "sparql_minmax": ("SELECT (MIN(?p) AS ?low) (MAX(?p) AS ?high) WHERE { ?x a :Part ; :retailprice ?p }", "SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part"),
    "sparql_group_concat": ('SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR = "|") AS ?names) WHERE { ?x a :Nation ; :name ?n ; :region ?r } GROUP BY ?r', "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "sparql_page": ("SELECT ?n WHERE { ?p a :Part ; :name ?n ; :size ?s } ORDER BY ?n ?s LIMIT 20 OFFSET 10", "SELECT p_name AS n FROM part ORDER BY p_name, p_size LIMIT 20 OFFSET 10"),
    "sparql_bind": ('SELECT ?low ?y WHERE { ?o a :Orders ; :orderpriority ?p ; :orderdate ?d ; :totalprice ?t . BIND(LCASE(?p) AS ?low) BIND(YEAR(?d) AS ?y) FILTER(?t > 400000 || STRSTARTS(?p, "1")) }', "SELECT lower(o_orderpriority) AS low, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE o_totalprice > 400000 OR starts_with(o_orderpriority, '1')"),
    "ask_exists": ('ASK { ?n a :Nation ; :name ?x . FILTER(LCASE(?x) = "nosuchname") }', "SELECT count(*) > 0 AS answer FROM nation WHERE lower(n_name) = 'nosuchname'"),
}


def _answer(text: str):
    return lambda spark, sf_dir: Compiler(spark, sf_dir).run(text)


for _name, (_text, _sql) in SPARQL.items():
    query(_name, _sql)(_answer(_text))


# A property graph from the sample tables: nations and regions, customers and suppliers in them, orders of customers.
_EDGES = """(SELECT 'customer/' || c_custkey AS src, 'in nation' AS rel, 'nation/' || c_nationkey AS dst FROM customer
    UNION ALL SELECT 'supplier/' || s_suppkey, 'In-Nation', 'nation/' || s_nationkey FROM supplier
    UNION ALL SELECT 'nation/' || n_nationkey, 'in region', 'region/' || n_regionkey FROM nation
    UNION ALL SELECT 'order/' || o_orderkey, 'placed by', 'customer/' || o_custkey FROM orders)"""


def _edges(spark, sf_dir):
    return Engine(spark, sf_dir, ("customer", "supplier", "nation", "orders")).sql(f"SELECT * FROM {_EDGES} e", max_rows=None)


def _seeds(spark, *names):
    return F.broadcast(spark.createDataFrame([(n,) for n in names], "node string"))


@query("edge_types", f"SELECT rel, count(*) AS n FROM {_EDGES} e GROUP BY rel ORDER BY n DESC LIMIT 10")
def edge_types(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel").limit(10)


@query("uri_expand", f"SELECT src, rel, dst FROM {_EDGES} e WHERE src IN ('nation/3', 'customer/7') UNION ALL SELECT dst, rel, src FROM {_EDGES} e WHERE dst IN ('nation/3', 'customer/7')")
def uri_expand(spark, sf_dir):
    return graphs.neighbours(_edges(spark, sf_dir), _seeds(spark, "nation/3", "customer/7")).select("src", "rel", "dst")


@query("hop_union", f"""WITH e AS (SELECT * FROM {_EDGES} x), s(node) AS (VALUES ('order/1'), ('order/5'), ('customer/7')),
    outgoing AS (SELECT e.* FROM e WHERE src IN (SELECT node FROM s)), incoming AS (SELECT e.* FROM e WHERE dst IN (SELECT node FROM s)),
    near(node) AS (SELECT src FROM incoming UNION SELECT dst FROM incoming UNION SELECT src FROM outgoing UNION SELECT dst FROM outgoing),
    shared(node) AS (SELECT dst FROM outgoing UNION SELECT dst FROM e WHERE src IN (SELECT src FROM incoming)),
    sibling(node) AS (SELECT src FROM e WHERE dst IN (SELECT node FROM shared))
    SELECT src, rel, dst, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM outgoing UNION ALL SELECT *, 1 FROM incoming
    UNION ALL SELECT *, 2 FROM e WHERE src IN (SELECT node FROM near) UNION ALL SELECT *, 2 FROM e WHERE dst IN (SELECT node FROM near)
    UNION ALL SELECT *, 2 FROM e WHERE src IN (SELECT node FROM sibling)) t GROUP BY 1, 2, 3 ORDER BY hop, src, rel, dst LIMIT 300""")
def hop_union(spark, sf_dir):
    return graphs.expand(_edges(spark, sf_dir), _seeds(spark, "order/1", "order/5", "customer/7"))


@query("hop_group", f"SELECT src, string_agg(DISTINCT rel || '>' || dst, ';' ORDER BY rel || '>' || dst) AS relations FROM {_EDGES} e WHERE src LIKE 'nation/%' GROUP BY src")
def hop_group(spark, sf_dir):
    e = _edges(spark, sf_dir).filter(F.col("src").startswith("nation/"))
    return e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "rel", "dst"))), ";").alias("relations"))


@query("edge_typed", f"""WITH e AS (SELECT * FROM {_EDGES} x), b AS (SELECT src, rel, dst FROM e UNION SELECT dst, rel, src FROM e)
    SELECT b.src, b.rel, b.dst, coalesce(string_agg(DISTINCT s.text, ',' ORDER BY s.text), '') AS texts FROM b
    LEFT JOIN (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst, c_mktsegment AS text FROM customer WHERE c_acctbal > 0) s ON s.src = b.src AND s.dst = b.dst
    WHERE translate(lower(b.rel), ' -', '__') IN ('in_nation') GROUP BY 1, 2, 3""")
def edge_typed(spark, sf_dir):
    said = Engine(spark, sf_dir, ("customer",)).sql("SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst, c_mktsegment AS text FROM customer WHERE c_acctbal > 0", max_rows=None)
    return graphs.typed_edges(_edges(spark, sf_dir), said, ["in_nation"]).withColumn("texts", F.array_join("texts", ","))


_COLUMNS = "(SELECT * FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'))"
# references as the column names tell them
_FK = f"""(WITH k AS (SELECT table_name, ordinal_position AS p, column_name, regexp_extract(column_name, '^[^_]*_(.+key)$', 1) AS suffix FROM {_COLUMNS} c),
    f AS (SELECT suffix, arg_min(table_name, length(table_name) * 1000 + ascii(table_name)) AS dst FROM k WHERE p = 1 AND suffix <> '' GROUP BY 1)
    SELECT table_name AS src, column_name AS rel, dst FROM k JOIN f USING (suffix) WHERE table_name <> dst)"""


def _references(spark, sf_dir):
    from tessera.sources import catalog

    return catalog.inferred_references(catalog.discover_columns(spark, sf_dir, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")))


@query("fk_adjacency", f"SELECT node, string_agg(DISTINCT near, ',' ORDER BY near) AS near FROM (SELECT src AS node, dst AS near FROM {_FK} a UNION ALL SELECT dst, src FROM {_FK} b) t GROUP BY node")
def fk_adjacency(spark, sf_dir):
    return graphs.adjacency(_references(spark, sf_dir)).withColumn("near", F.array_join("near", ","))


@query("fk_expand", f"SELECT table_name, min(hop) AS hop FROM (SELECT 'customer' AS table_name, 0 AS hop UNION ALL SELECT dst, 1 FROM {_FK} a WHERE src = 'customer' UNION ALL SELECT src, 1 FROM {_FK} b WHERE dst = 'customer') t GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def fk_expand(spark, sf_dir):
    """Tables found and their neighbours, at most ten."""
    near = graphs.neighbours(_references(spark, sf_dir), _seeds(spark, "customer")).select(F.col("dst").alias("table_name"), F.lit(1).alias("hop"))
    own = spark.createDataFrame([("customer", 0)], "table_name string, hop int")
    return own.unionByName(near).groupBy("table_name").agg(F.min("hop").alias("hop")).orderBy("hop", "table_name").limit(10)


@query("fk_topo", f"""WITH RECURSIVE f AS (SELECT DISTINCT src, dst FROM {_FK} x), w(node, level) AS (SELECT DISTINCT dst, 0 FROM f WHERE dst NOT IN (SELECT src FROM f) UNION SELECT f.src, w.level + 1 FROM w JOIN f ON f.dst = w.node)
    SELECT node, max(level) AS level FROM w GROUP BY 1""")
def fk_topo(spark, sf_dir):
    """Levels such that every table comes after all that it refers to."""
    pairs = _references(spark, sf_dir).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    nodes = pairs.select(F.col("child").alias("node")).union(pairs.select("parent")).distinct()
    return graphs.first_level(pairs, nodes)


@query("subtype_chain", """WITH RECURSIVE p(child, parent) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 1),
    c(child, ancestor, level) AS (SELECT child, parent, 1 FROM p UNION ALL SELECT c.child, p.parent, level + 1 FROM c JOIN p ON p.child = c.ancestor WHERE level < 5)
    SELECT child, ancestor, min(level) AS level FROM c GROUP BY 1, 2""")
def subtype_chain(spark, sf_dir):
    """Ancestors up to five levels in a binary tree over customer keys."""
    p = Engine(spark, sf_dir, ("customer",)).table("customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return graphs.closure(p)


@query("components", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07),
    b(a, z) AS (SELECT 's' || s, 'p' || p FROM e UNION SELECT 'p' || p, 's' || s FROM e), r(a, z) AS (SELECT a, a FROM b UNION SELECT r.a, b.z FROM r JOIN b ON b.a = r.z)
    SELECT a AS node, min(z) AS comp FROM r GROUP BY a""")
def components(spark, sf_dir):
    e = Engine(spark, sf_dir, ("lineitem",)).table("lineitem").filter("l_quantity > 49 AND l_tax > 0.07")
    e = e.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graphs.components(e, nodes)


@query("chunk_window", """WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'system' OR turn = 3)
    SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN s ON s.conv_id = c.conv_id AND abs(c.turn - s.turn) <= 2
    WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.conv_id = c.conv_id AND x.turn = c.turn)""")
def chunk_window(spark, sf_dir):
    c = Engine(spark, sf_dir, ("conversations",)).table("conversations").select("conv_id", "turn", "role")
    return graphs.window_around(c, c.filter("role = 'system' OR turn = 3"), 2, "conv_id", "turn").select("conv_id", "turn").distinct()


@query("beam_search", """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + k * 3) % 25 AS dst, 1.0 / (k + 2) AS weight FROM nation, range(3) r(k)),
    p(node, score, level) AS (SELECT 0, CAST(1.0 AS DOUBLE), 0 UNION ALL SELECT e.dst, p.score * e.weight::DOUBLE, level + 1 FROM p JOIN e ON e.src = p.node WHERE level < 4)
    SELECT node, round(max(score), 9) AS score FROM p GROUP BY node ORDER BY 2 DESC, 1 LIMIT 50""")
def beam_search(spark, sf_dir):
    n = Engine(spark, sf_dir, ("nation",)).table("nation")
    e = n.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    e = e.select("src", ((F.col("src") * 7 + F.col("k") * 3) % 25).alias("dst"), (1.0 / (F.col("k") + 2)).alias("weight"))
    seeds = spark.createDataFrame([(0, 1.0)], "node int, score double")
    return graphs.beam(e, seeds, width=100, depth=4, top=50).select("node", F.round("score", 9).alias("score"))


@query("cycle_check", "SELECT c_custkey AS node FROM customer WHERE c_custkey // 25 % 3 = 0 AND c_custkey // 25 * 25 + 24 <= (SELECT max(c_custkey) FROM customer)")
def cycle_check(spark, sf_dir):
    """Customers in rings of 25 and in chains of 25, every ring with a tail; the rings are cycles, the rest isn't."""
    from tessera.operators.quality import cycles

    k = F.col("c_custkey")
    ring = F.expr("c_custkey div 25 % 3 = 0")
    c = Engine(spark, sf_dir, ("customer",)).table("customer")
    most = c.agg(F.max("c_custkey").alias("most"))
    whole = c.crossJoin(F.broadcast(most)).filter(F.expr("c_custkey div 25 * 25 + 24") <= F.col("most"))  # one row
    nxt = F.when(k % 25 == 24, F.when(ring, k - 24)).otherwise(k + 1)
    pairs = whole.select(k.alias("child"), nxt.alias("parent")).filter("parent is not null")
    tails = whole.filter(ring & (k % 25 == 7)).select((-k).alias("child"), k.alias("parent"))
    return cycles(pairs.unionByName(tails))


@query("unpivot_triples", "SELECT 'nation/' || n_nationkey AS s, p, o FROM (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation) UNPIVOT (o FOR p IN (n_name, n_regionkey))")
def unpivot_triples(spark, sf_dir):
    n = Engine(spark, sf_dir, ("nation",)).table("nation")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in ("n_name", "n_regionkey")]))
    return n.select(F.concat(F.lit("nation/"), "n_nationkey").alias("s"), pairs.alias("x")).select("s", "x.p", "x.o")


@query("contains_any", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot') ORDER BY p_partkey LIMIT 50")
def contains_any(spark, sf_dir):
    name = F.lower("p_name")
    return Engine(spark, sf_dir, ("part",)).table("part").filter(name.contains("ring") | name.contains("hot")).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("graph_scope", f"SELECT src, rel, dst FROM {_EDGES} e WHERE starts_with(src, 'nation/') AND dst <> 'region/1'")
def graph_scope(spark, sf_dir):
    return _edges(spark, sf_dir).filter(F.col("src").startswith("nation/") & (F.col("dst") != "region/1"))


@query("vertex_lookup", f"SELECT e.rel, e.dst, n.n_name AS label FROM {_EDGES} e LEFT JOIN nation n ON e.dst = 'nation/' || n.n_nationkey WHERE e.src IN ('customer/5', 'customer/9')")
def vertex_lookup(spark, sf_dir):
    out = _edges(spark, sf_dir).filter(F.col("src").isin("customer/5", "customer/9"))
    n = Engine(spark, sf_dir, ("nation",)).table("nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("dst"), F.col("n_name").alias("label"))
    return out.join(n, "dst", "left").select("rel", "dst", "label")


@query("norm_key_join", f"SELECT translate(lower(rel), ' -', '__') AS edge, count(*) AS n FROM {_EDGES} e JOIN (VALUES ('in_nation'), ('placed_by')) w(k) ON translate(lower(rel), ' -', '__') = w.k GROUP BY 1")
def norm_key_join(spark, sf_dir):
    from tessera.functions.names import normal_edge

    wanted = spark.createDataFrame([("In Nation",), ("placed-by",)], "k string").select(normal_edge(F.col("k")).alias("edge"))
    return _edges(spark, sf_dir).select(normal_edge(F.col("rel")).alias("edge")).join(F.broadcast(wanted), "edge").groupBy("edge").agg(F.count("*").alias("n"))
