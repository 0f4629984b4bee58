"""Catalog trees, ontology triples, governed and dimensioned metrics, fuzzy matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import fuzzy
from tessera.operators import graphs, quality, triples
from tessera.operators.metrics import run_metric
from tessera.operators.sparql import Compiler
from tessera.operators.sqlgate import Profile
from tessera.plans.semantic import _FK
from tessera.registry import query
from tessera.sources import catalog
from tessera.sources.tables import read

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


_COLUMNS = "(SELECT * FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'))"
_CLASS = "upper(table_name[1]) || table_name[2:]"
_PROPERTY = "column_name[1] || upper(column_name[3]) || column_name[4:]"


def _keys(spark, sf_dir):
    """References as the column names tell them, as catalog rows."""
    r = catalog.inferred_references(catalog.discover_columns(spark, sf_dir, _TABLES))
    return r.select(F.col("src").alias("table_name"), F.lit("FOREIGN KEY").alias("kind"), F.lit(1).alias("position"), F.col("rel").alias("column_name"), F.col("dst").alias("ref_table"), F.lit(None).cast("string").alias("ref_column"))


@query("fk_positional_join", f"SELECT a.table_name, a.column_name, b.table_name AS ref_table, b.column_name AS ref_column FROM {_COLUMNS} a JOIN {_COLUMNS} b ON a.ordinal_position = b.ordinal_position WHERE a.table_name = 'lineitem' AND b.table_name = 'orders'")
def fk_positional_join(spark, sf_dir):
    """A composite reference's columns meet by their position, not each with each: here all columns of two tables."""
    use = catalog.discover_columns(spark, sf_dir, ("lineitem", "orders")).select(F.concat(F.lit("k_"), "table_name").alias("name"), "table_name", "column_name", F.col("position").alias("place"))
    ref = spark.createDataFrame([("k_lineitem", "k_orders")], "name string, unique_name string")
    left = use.join(ref, "name")
    right = use.select(F.col("name").alias("unique_name"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "place")
    return left.join(right, ["unique_name", "place"]).select("table_name", "column_name", "ref_table", "ref_column")


@query("metric_list", """SELECT 'urn:g/' || event_type || '/m' || user_id % 4 AS s, event_type AS namespace, 'metric ' || user_id % 4 AS name, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'SELECT ' || user_id % 4 END AS sql
    FROM events WHERE event_type <> 'error' GROUP BY event_type, user_id % 4""")
def metric_list(spark, sf_dir):
    """Metrics of all graphs under a prefix, one row each; the namespace is read from the name."""
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("k")).distinct()
    graph = F.when(F.col("event_type") == "error", "urn:x/").otherwise("urn:g/")
    said = F.array(F.struct(F.lit("name").alias("p"), F.concat(F.lit("metric "), "k").alias("o")), F.struct(F.lit("sql").alias("p"), F.when(F.col("k") != 0, F.concat(F.lit("SELECT "), "k")).alias("o")))
    t = e.select(F.concat(graph, "event_type", F.lit("/m"), "k").alias("s"), F.explode(said).alias("x")).select("s", "x.*").filter(F.col("s").startswith("urn:g/") & F.col("o").isNotNull())
    one = lambda p: F.coalesce(F.max(F.when(F.col("p") == p, F.col("o"))), F.lit(""))
    return t.groupBy("s").agg(one("name").alias("name"), one("sql").alias("sql")).select("s", F.regexp_extract("s", "^urn:g/([^/]+)/", 1).alias("namespace"), "name", "sql")


@query("facts_left_join", "SELECT s.s_name AS subject, coalesce(n.n_name, '') AS object, CASE WHEN n.n_name IS NULL THEN 'SPC' ELSE 'SPO' END AS kind FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey = 1")
def facts_left_join(spark, sf_dir):
    """Facts of subjects, with their object entity if there is one."""
    n = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = read(spark, sf_dir, "supplier").join(n, "s_nationkey", "left")
    return j.select(F.col("s_name").alias("subject"), F.coalesce("n_name", F.lit("")).alias("object"), F.when(F.col("n_name").isNull(), "SPC").otherwise("SPO").alias("kind"))


def _ontology(spark, sf_dir):
    return triples.ontology(catalog.discover_columns(spark, sf_dir, _TABLES), _keys(spark, sf_dir))


@query("ontology_edges", f"SELECT upper(src[1]) || src[2:] AS source, rel AS label, upper(dst[1]) || dst[2:] AS target FROM {_FK} f")
def ontology_edges(spark, sf_dir):
    return triples.edges(_ontology(spark, sf_dir))


@query("ontology_triples", """WITH c AS (SELECT column_name, CASE column_name WHEN 'n_regionkey' THEN 'Region' END AS ref, data_type FROM information_schema.columns WHERE table_name = 'nation'),
    n AS (SELECT column_name, 'Nation.' || column_name[1] || upper(column_name[3]) || column_name[4:] AS s, ref, data_type FROM c)
    SELECT 'Nation' AS s, 'rdf:type' AS p, 'owl:Class' AS o UNION ALL SELECT s, 'rdf:type', CASE WHEN ref IS NULL THEN 'owl:DatatypeProperty' ELSE 'owl:ObjectProperty' END FROM n
    UNION ALL SELECT s, 'rdfs:label', column_name FROM n UNION ALL SELECT s, 'rdfs:domain', 'Nation' FROM n UNION ALL SELECT s, 'rdfs:range', coalesce(ref, CASE data_type WHEN 'INTEGER' THEN 'xsd:integer' ELSE 'xsd:string' END) FROM n""")
def ontology_triples(spark, sf_dir):
    return triples.ontology(catalog.discover_columns(spark, sf_dir, ("nation",)), _keys(spark, sf_dir)).select("s", "p", "o")


@query("entity_search", f"SELECT {_CLASS} || '.' || {_PROPERTY} AS s, column_name AS label FROM {_COLUMNS} c WHERE contains(column_name, 'key')")
def entity_search(spark, sf_dir):
    return triples.search(_ontology(spark, sf_dir), "key", ("owl:ObjectProperty", "owl:DatatypeProperty"))


@query("catalog_explode", f"""SELECT c.table_name, c.column_name, CASE WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'other' END AS data_type, CASE WHEN f.dst IS NOT NULL THEN 'FK>' || f.dst || '.id' WHEN ordinal_position = 1 THEN 'PK' ELSE '' END AS tag
    FROM {_COLUMNS} c LEFT JOIN {_FK} f ON f.src = c.table_name AND f.rel = c.column_name""")
def catalog_explode(spark, sf_dir):
    """A nested catalog, as JSON, as one row a column; references one column each."""
    c = catalog.discover_columns(spark, sf_dir, _TABLES).withColumn("type", F.when(F.col("data_type") == "string", "string").otherwise("other"))
    refs = _keys(spark, sf_dir).select("table_name", "column_name", "ref_table")
    c = c.join(refs, ["table_name", "column_name"], "left")
    fk = F.collect_list(F.when(F.col("ref_table").isNotNull(), F.struct(F.col("column_name").alias("column"), F.col("ref_table").alias("table"), F.lit("id").alias("ref"))))
    pk = F.collect_list(F.when((F.col("position") == 1) & F.col("ref_table").isNull(), F.col("column_name")))
    per = c.groupBy(F.col("table_name").alias("name")).agg(pk.alias("pk"), fk.alias("fk"), F.collect_list(F.struct(F.col("column_name").alias("name"), "type")).alias("columns"))
    j = per.agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(F.struct("name", "pk", "fk", "columns")).alias("tables"))).alias("databases"))).alias("j"))
    kind = "databases array<struct<tables:array<struct<name:string,pk:array<string>,fk:array<struct<column:string,table:string,ref:string>>,columns:array<struct<name:string,type:string>>>>>>"
    t = j.select(F.from_json("j", kind).alias("c")).select(F.explode("c.databases").alias("d")).select(F.explode("d.tables").alias("t")).select("t.*", F.explode("t.columns").alias("x"))
    ref = F.get(F.filter("fk", lambda k: k["column"] == F.col("x.name")), F.lit(0))
    return t.select(F.col("name").alias("table_name"), F.col("x.name").alias("column_name"), F.col("x.type").alias("data_type"), F.when(F.array_contains("pk", F.col("x.name")), "PK").when(ref.isNotNull(), F.concat(F.lit("FK>"), ref["table"], F.lit("."), ref["ref"])).otherwise("").alias("tag"))


@query("sparql_projection", "SELECT n_name AS label, n_regionkey AS where_ FROM nation")
def sparql_projection(spark, sf_dir):
    """Helper variables are dropped and names are the query's."""
    return Compiler(spark, sf_dir).run("SELECT ?label ?where_ WHERE { ?n a :Nation ; :name ?label ; :region ?where_ }")


@query("governed_select", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def governed_select(spark, sf_dir):
    profile = Profile(frozenset({"customer"}), {"customer": frozenset({"c_acctbal"})})
    return Engine(spark, sf_dir).sql("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", profile)


@query("metric_dim", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 1000.5 GROUP BY 1")
def metric_dim(spark, sf_dir):
    return run_metric(Engine(spark, sf_dir), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = :priority AND o_totalprice >= :least GROUP BY 1", [{"name": "priority", "operator": "=", "value": "1-URGENT"}, {"name": "least", "value": 1000.5}], {"priority", "least"})


@query("closure_domain", "SELECT n_name AS class, 'in_' || r_name AS prop, n_regionkey = r_regionkey AS compatible FROM nation, region UNION ALL SELECT n_name, 'known', true FROM nation UNION ALL SELECT n_name, 'own', n_nationkey = 3 FROM nation")
def closure_domain(spark, sf_dir):
    """A property fits a class if its domain is the class or any class above it; without a domain there is no answer."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(r.select("r_name", F.lit("World")))
    up = graphs.closure(pairs)
    domain = r.select(F.concat(F.lit("in_"), "r_name").alias("prop"), F.col("r_name").alias("domain")).union(spark.createDataFrame([("known", "World"), ("own", "NATION_3")], "prop string, domain string"))
    names_ = [f"in_{x[0]}" for x in r.select("r_name").collect()]  # the regions are few
    ask = n.select(F.col("n_name").alias("class"), F.explode(F.array(*map(F.lit, [*names_, "known", "own", "colour"]))).alias("prop"))
    above = up.select(F.col("child").alias("class"), F.col("ancestor").alias("domain")).withColumn("hit", F.lit(True))
    j = ask.join(domain, "prop").join(above, ["class", "domain"], "left")
    return j.select("class", "prop", (F.coalesce("hit", F.lit(False)) | (F.col("class") == F.col("domain"))).alias("compatible"))


@query("schema_context", "SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'part') GROUP BY 1")
def schema_context(spark, sf_dir):
    c = catalog.discover_columns(spark, sf_dir, ("region", "nation", "part"))
    return c.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ",").alias("columns"))


@query("dq_datatype", "SELECT 'datatype' AS check_name, 'p_brand' AS column_name, sum((TRY_CAST(p_brand AS INT) IS NULL)::INT)::BIGINT AS violations FROM part")
def dq_datatype(spark, sf_dir):
    return quality.profile(read(spark, sf_dir, "part"), castable={"p_brand": "int"})


@query("dq_positive", "SELECT 'positive' AS check_name, 's_acctbal' AS column_name, sum((s_acctbal <= 0)::INT)::BIGINT AS violations FROM supplier")
def dq_positive(spark, sf_dir):
    return quality.profile(read(spark, sf_dir, "supplier"), positive=["s_acctbal"])


@query("dq_pattern", "SELECT 'pattern' AS check_name, 'p_brand' AS column_name, sum((NOT regexp_matches(p_brand, '^Brand#[0-2]+$'))::INT)::BIGINT AS violations FROM part")
def dq_pattern(spark, sf_dir):
    return quality.profile(read(spark, sf_dir, "part"), patterns={"p_brand": "^Brand#[0-2]+$"})


@query("fuzzy_match")
def fuzzy_match(spark, sf_dir):
    """Metrics that a question nearly names."""
    q = spark.createDataFrame([(1, "whats totl revenue for asia"), (2, "average order size")], "qid int, question string")
    return fuzzy.fuzzy_matches(q, spark.createDataFrame([("total_revenue", "total revenue"), ("order_size", "order sizes"), ("headcount", "headcount")], "metric string, label string"))


@query("class_clusters")
def class_clusters(spark, sf_dir):
    """Vectors normalised one after the other within each label."""
    return fuzzy.cluster_classes(read(spark, sf_dir, "embeddings"), "label", "vec_id", "vec_id", "embedding")


@query("turtle_export")
def turtle_export(spark, sf_dir):
    return triples.turtle_lines(_ontology(spark, sf_dir))
