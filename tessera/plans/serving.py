"""Federation, routing, metric lookup, retrieval modes, shapes and the small functions around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import lexical, serving, shapes, triples
from tessera.registry import query
from tessera.sources import catalog
from tessera.sources.tables import TABLES, read

_COLUMNS = "(SELECT * FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"


def _federation(spark, sf_dir):
    sources = {"sales": ("customer", "orders", "lineitem"), "geo": ("region", "nation"), "text": ("documents", "labels")}
    return serving.Federation(spark, {s: {t: read(spark, sf_dir, t) for t in tables} for s, tables in sources.items()})


@query("federated_join", "SELECT r_name, count(*) AS n, CAST(sum(c_acctbal * 100) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def federated_join(spark, sf_dir):
    """Two sources in one statement: qualified, catalog-qualified and bare names, one of them a literal too."""
    sql = "SELECT r_name, count(*) AS n, CAST(sum(c_acctbal * 100) AS BIGINT) AS cents FROM lake.sales.customer JOIN geo.nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE 'sales.customer' <> '' GROUP BY r_name"
    return _federation(spark, sf_dir).sql(sql)


@query("federated_alias", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def federated_alias(spark, sf_dir):
    """Names that a federation has made: SOURCE_SCHEMA_TABLE, and a common table expression that hides a source's table."""
    return _federation(spark, sf_dir).sql("WITH nation AS (SELECT * FROM GEO_PUBLIC_NATION WHERE n_regionkey = 2) SELECT n_nationkey, n_name FROM nation")


@query("single_source", "SELECT o_orderstatus, count(*) AS n, 1 AS sources FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def single_source(spark, sf_dir):
    """One source alone is asked: the statement's sources are counted before it runs."""
    f = _federation(spark, sf_dir)
    sql = "SELECT o_orderstatus, count(*) AS n FROM orders JOIN sales.lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus"
    return f.sql(sql).withColumn("sources", F.lit(len(f.used(sql))))


@query("name_qualify", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def name_qualify(spark, sf_dir):
    """Bare tables get their database, common table expressions don't; here the database is taken off again to run."""
    for t in ("lineitem", "part"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    sql = "WITH big AS (SELECT p_partkey FROM part WHERE p_size > 25) SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM big) GROUP BY l_returnflag"
    full = serving.qualified(spark, sql, ("lake", "db"))
    assert [r.parts for r in serving.relations(spark, full)] == [("lake", "db", "part"), ("lake", "db", "lineitem")]
    return spark.sql(serving.renamed(spark, full, lambda parts: parts[-1]))


@query("cell_decode", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name, n_regionkey * 0.5 AS half, n_regionkey > 2 AS far FROM nation")
def cell_decode(spark, sf_dir):
    """Cells that are a null, a text, a whole or real number or a truth value, as typed columns."""
    none = {"is_null": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string"), "whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double"), "truth": F.lit(None).cast("boolean")}
    cell = lambda **c: F.struct(*[c.get(k, v).alias(k) for k, v in none.items()])
    name = cell(is_null=F.col("n_nationkey") % 5 == 0, text=F.col("n_name"))
    rows = read(spark, sf_dir, "nation").select(F.array(cell(whole=F.col("n_nationkey").cast("bigint")), name, cell(real=F.col("n_regionkey") * F.lit(0.5).cast("double")), cell(truth=F.col("n_regionkey") > 2)).alias("cells"))
    return serving.decoded(rows, "cells", [("k", "int"), ("name", "string"), ("half", "double"), ("far", "boolean")])


@query("table_routing", f"SELECT table_name, CASE WHEN table_name IN ('customer', 'orders', 'lineitem') THEN 'sales' WHEN table_name IN ('region', 'nation') THEN 'geo' ELSE '' END AS source FROM (SELECT DISTINCT table_name FROM {_COLUMNS} c) t")
def table_routing(spark, sf_dir):
    tables = catalog.discover_columns(spark, sf_dir).select("table_name").distinct()
    mapping = [("db.Customer", "sales"), ("orders", "sales"), ("LINEITEM", "sales"), ("x.y.region", "geo"), ("nation", "geo")]
    return serving.routed(tables, spark.createDataFrame(mapping, "table_name string, source string"))


@query("class_sources", "SELECT lang AS class, coalesce(arg_max(CASE WHEN doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN doc_id END), '') AS source FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def class_sources(spark, sf_dir):
    """The last source of a class that isn't empty."""
    d = read(spark, sf_dir, "documents").filter("lang is not null")
    return serving.class_sources(d.select(F.col("lang").alias("class"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("source"), "doc_id"), "doc_id")


@query("metric_cascade", """SELECT c_custkey AS qid, CASE c_mktsegment WHEN 'MACHINERY' THEN 'machine_parts' ELSE lower(c_mktsegment) END AS metric, CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' ELSE 'fuzzy' END AS how,
    CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.9 END AS floor FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'MACHINERY' OR c_custkey % 3 = 1 OR c_custkey % 3 = 2 AND c_mktsegment <> 'MACHINERY'""")
def metric_cascade(spark, sf_dir):
    """Questions name a metric, or a synonym, or misspell it; what isn't found exactly is looked up nearly."""
    segments = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    metric = F.when(F.col("c_mktsegment") == "MACHINERY", "machine_parts").otherwise(F.lower("c_mktsegment"))
    load = lambda: segments.select(metric.alias("metric"), F.lit("sales").alias("namespace"), F.lit("").alias("sql"), F.array(F.concat(F.lit("turnover in "), F.lower("c_mktsegment"))).alias("synonyms"))
    c = read(spark, sf_dir, "customer")
    low = F.lower("c_mktsegment")
    said = F.when(F.col("c_custkey") % 3 == 0, low).when(F.col("c_custkey") % 3 == 1, F.concat(F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).otherwise(F.lit("")), F.lit("turnover in "), low)).otherwise(F.concat(F.substring(low, 1, 7), F.lit("x"), F.substring(low, 8, 9)))
    # a synonym holds the metric's own name where the two are the same word, so a name hit outranks it there
    q = c.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("show "), said, F.lit(" now")).alias("question"))
    got = serving.MetricIndex(load).match(q, "sales")
    best = got.withColumn("floor", F.when(F.col("qid") % 3 == 1, 0.95).when(F.col("score") >= 1, 1.0).otherwise(0.9))
    return best.select("qid", "metric", "how", "floor")


# --- retrieval -------------------------------------------------------------


def _mentions(spark, sf_dir):
    """Documents mention their source and their language."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk"), F.explode(F.array("source", F.concat(F.lit("lang "), "lang"))).alias("entity")).filter("entity is not null")


_MENTIONS = "(SELECT DISTINCT doc_id AS chunk, unnest([source, 'lang ' || lang]) AS entity FROM documents)"


def _entities(spark, sf_dir):
    return _mentions(spark, sf_dir).select("entity", F.col("entity").alias("name")).distinct()


@query("lex_chunk", "SELECT a.vec_id AS chunk, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 3 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10")
def lex_chunk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return lexical.by_chunk(e.withColumnRenamed("vec_id", "chunk"), [float(v) for v in e.filter("vec_id = 3").first()["embedding"]]).withColumn("score", F.round("score", 6))


@query("lex_chunk_semantic", """WITH e AS (SELECT a.vec_id AS chunk, a.label, list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 3),
    near AS (SELECT chunk, label, score FROM e ORDER BY score DESC, chunk LIMIT 5), said AS (SELECT label, max(score) AS score FROM near GROUP BY 1),
    a AS (SELECT chunk, score FROM near UNION ALL SELECT e.chunk, said.score * 0.5 FROM e JOIN said USING (label))
    SELECT chunk, round(max(score), 6) AS score FROM a GROUP BY 1 ORDER BY max(score) DESC, chunk LIMIT 30""")
def lex_chunk_semantic(spark, sf_dir):
    """Here a chunk mentions its label."""
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk")
    v = [float(x) for x in e.filter("chunk = 3").first()["embedding"]]
    return lexical.by_chunk_semantic(e, e.select("chunk", F.col("label").alias("entity")), v, k=30).withColumn("score", F.round("score", 6))


@query("lex_entity", f"SELECT chunk, sum(contains(entity, 'src1')::INT + contains(entity, 'lang de')::INT)::BIGINT AS score FROM {_MENTIONS} m WHERE contains(entity, 'src1') OR contains(entity, 'lang de') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def lex_entity(spark, sf_dir):
    return lexical.by_entity(_mentions(spark, sf_dir), _entities(spark, sf_dir), ["SRC1", "lang de"], 40)


_SEEDS = "seeds AS (SELECT DISTINCT entity FROM m WHERE contains(entity, 'src1'))"
_NEAR = "SELECT entity FROM (SELECT entity, count(*) AS n FROM m WHERE chunk IN (SELECT chunk FROM m WHERE entity IN (SELECT entity FROM {0})) AND entity NOT IN (SELECT entity FROM {0}) GROUP BY 1) t ORDER BY n DESC, entity LIMIT 2"


@query("lex_entity_context", f"WITH m AS (SELECT * FROM {_MENTIONS} x WHERE entity IS NOT NULL), {_SEEDS}, one AS ({_NEAR.format('seeds')}), w AS (SELECT entity, 2 AS w FROM seeds UNION ALL SELECT entity, 1 FROM one) SELECT chunk, sum(w)::BIGINT AS score FROM m JOIN w USING (entity) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def lex_entity_context(spark, sf_dir):
    return lexical.by_entity_context(_mentions(spark, sf_dir), _entities(spark, sf_dir), ["src1"], 60, 2)


@query("lex_entity_network", f"WITH m AS (SELECT * FROM {_MENTIONS} x WHERE entity IS NOT NULL), {_SEEDS}, one AS ({_NEAR.format('seeds')}), near AS (SELECT * FROM seeds UNION ALL SELECT * FROM one), two AS ({_NEAR.format('near')}), w AS (SELECT entity, 4 AS w FROM seeds UNION ALL SELECT entity, 2 FROM one UNION ALL SELECT entity, 1 FROM two) SELECT chunk, sum(w)::BIGINT AS score FROM m JOIN w USING (entity) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def lex_entity_network(spark, sf_dir):
    return lexical.by_entity_network(_mentions(spark, sf_dir), _entities(spark, sf_dir), ["src1"], 200, 2)


@query("lex_topic", "SELECT doc_id AS chunk, max(contains(source, 'src2')::INT + contains(source, '2')::INT)::BIGINT AS score FROM documents WHERE contains(source, '2') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def lex_topic(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    topics = d.select(F.col("doc_id").alias("chunk"), F.col("source").alias("topic"))
    return lexical.by_topic(topics, topics.select("topic", F.col("topic").alias("name")).distinct(), ["src2", "2"], 50)


@query("entities_by_class", "SELECT doc_id AS entity, lang AS kind FROM documents WHERE lang = 'de' ORDER BY 1 LIMIT 25")
def entities_by_class(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.col("lang").alias("kind"))
    return lexical.of_class(d, "de", 25)


# --- checks ----------------------------------------------------------------


@query("shape_check", """SELECT check_name, path, count(*) AS n FROM (
    SELECT 'minCount' AS check_name, 'name' AS path FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'maxCount', 'name' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0
    UNION ALL SELECT 'minInclusive', 'balance' FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'HOUSEHOLD' UNION ALL SELECT 'datatype', 'balance' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
    UNION ALL SELECT 'pattern', 'segment' FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-M]') UNION ALL SELECT 'class', 'nation' FROM customer WHERE c_nationkey >= 20) t GROUP BY 1, 2""")
def shape_check(spark, sf_dir):
    """Shapes over triples of all customers: counts, datatypes, patterns, least values and the class of what is referred to."""
    c = read(spark, sf_dir, "customer")
    s = F.concat(F.lit("customer/"), "c_custkey")
    row = lambda p, o, where=None: F.when(F.lit(True) if where is None else where, F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")))
    key = F.col("c_custkey")
    parts = [
        row("rdf:type", F.lit("Customer")), row("name", F.col("c_name"), key % 7 != 0), row("name", F.concat("c_name", F.lit(" II")), (key % 7 != 0) & (key % 11 == 0)),
        row("balance", F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("x"), F.abs("c_acctbal"))).otherwise(F.col("c_acctbal").cast("string"))), row("segment", F.col("c_mktsegment")), row("nation", F.concat(F.lit("nation/"), "c_nationkey")),
    ]
    t = c.select(s.alias("s"), F.explode(F.array_compact(F.array(*parts))).alias("x")).select("s", "x.p", "x.o")
    n = read(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("nation/"), "n_nationkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("Nation").alias("o"))
    rules = [("Customer", "name", 1, 1, None, None, None, None), ("Customer", "balance", None, None, "double", None, None, 0.0), ("Customer", "segment", None, None, None, "^[A-M]", None, None), ("Customer", "nation", None, None, None, None, "Nation", None)]
    found = shapes.shape_findings(t.unionByName(n), spark.createDataFrame(rules, shapes.SHAPES))
    return found.groupBy("check_name", "path").agg(F.count("*").alias("n"))


@query("range_compat", f"""SELECT c.table_name || '.' || c.column_name AS prop, l AS literal_type, CASE c.data_type WHEN 'BIGINT' THEN l IN ('long', 'int', 'short', 'byte') WHEN 'INTEGER' THEN l IN ('integer', 'long', 'int', 'short', 'byte')
    WHEN 'DOUBLE' THEN l = 'double' WHEN 'VARCHAR' THEN l = 'string' WHEN 'TIMESTAMP' THEN l = 'dateTime' WHEN 'DATE' THEN l = 'date' END AS compatible FROM {_COLUMNS} c, (VALUES ('integer'), ('int'), ('double'), ('string'), ('dateTime')) v(l) WHERE c.data_type <> 'FLOAT[]'
    UNION ALL SELECT 'nowhere', 'int', NULL""")
def range_compat(spark, sf_dir):
    """Whether a literal's type fits a property's range; a property without a range has no answer."""
    c = catalog.discover_columns(spark, sf_dir).filter("data_type not like 'array%'").select(F.concat_ws(".", "table_name", "column_name").alias("prop"), names.xsd_type(F.col("data_type")).alias("range"))
    asked = c.select("prop", F.explode(F.array(*map(F.lit, ("integer", "int", "double", "string", "dateTime")))).alias("literal_type"))
    return shapes.range_compatible(asked.unionByName(spark.createDataFrame([("nowhere", "int")], "prop string, literal_type string")), c)


@query("ambiguous_matches", "SELECT DISTINCT source AS s, 'lang ' || lang AS o FROM documents WHERE doc_id % 4 = 1 AND lang IS NOT NULL")
def ambiguous_matches(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("lang is not null")
    p = F.when(F.col("doc_id") % 4 == 1, "skos:relatedMatch").when(F.col("doc_id") % 4 == 2, "skos:exactMatch").otherwise("skos:closeMatch")
    return shapes.ambiguous(d.select(F.col("source").alias("s"), p.alias("p"), F.concat(F.lit("lang "), "lang").alias("o")))


@query("concept_linkage", f"SELECT 'm_' || event_type AS metric, concept FROM (SELECT DISTINCT event_type FROM events), (VALUES ('urn:x#Orders'), ('urn:x/Ghost'), ('lineitem'), ('Refund')) v(concept) WHERE lower(regexp_extract(concept, '([^#/]*)$', 1)) NOT IN (SELECT table_name FROM {_COLUMNS} c)")
def concept_linkage(spark, sf_dir):
    """Concepts of metrics that are no class."""
    concepts = read(spark, sf_dir, "events").select(F.concat(F.lit("m_"), "event_type").alias("metric")).distinct().select("metric", F.explode(F.array(*map(F.lit, ("urn:x#Orders", "urn:x/Ghost", "lineitem", "Refund")))).alias("concept"))
    return shapes.unlinked(concepts, catalog.discover_columns(spark, sf_dir).select(names.pascal_case(F.col("table_name")).alias("class")))


@query("group_columns", f"SELECT metric, column_name FROM (VALUES ('by_region', 'nation', 'n_regionkey'), ('by_ghost', 'nation', 'n_ghost'), ('nested', 'orders', 'o_status'), ('nested', 'orders', 'o_orderpriority'), ('by_year', 'orders', 'o_orderdate')) v(metric, t, column_name) WHERE column_name NOT IN (SELECT column_name FROM {_COLUMNS} c WHERE table_name = t)")
def group_columns(spark, sf_dir):
    """Grouping columns that the catalog's table doesn't have, also inside subqueries and expressions."""
    m = {
        "by_region": "SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey", "by_ghost": "SELECT n_ghost, count(*) FROM nation n GROUP BY n.n_ghost", "by_year": "SELECT year(o_orderdate), sum(o_totalprice) FROM orders GROUP BY year(o_orderdate)",
        "nested": "SELECT max(c) FROM (SELECT o_status, count(*) AS c FROM orders GROUP BY o_status, O_ORDERPRIORITY) t", "other": "SELECT x, count(*) FROM elsewhere GROUP BY x",
    }
    return shapes.unknown_groupings(spark, m, catalog.discover_columns(spark, sf_dir))


@query("individuals", "SELECT 'Supplier/' || s_suppkey AS s, p, o FROM (SELECT s_suppkey, unnest(['rdf:type', 'rdfs:label', 'skos:inScheme']) AS p, unnest(['Supplier', s_name, 'NATION_' || s_nationkey]) AS o FROM supplier)")
def individuals(spark, sf_dir):
    """Each entity as an individual of its class, with its label and its scheme."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier/"), "s_suppkey").alias("iri"), F.lit("Supplier").alias("class"), F.col("s_name").alias("label"), F.concat(F.lit("NATION_"), "s_nationkey").alias("scheme"))
    return triples.individuals(s)


@query("tbox_context", f"""WITH hit AS (SELECT 'customer' AS t, 1 AS place UNION ALL SELECT 'orders', 2 UNION ALL SELECT 'lineitem', 3), c AS (SELECT table_name, place, count(*) AS n, string_agg(column_name, ',' ORDER BY column_name) AS properties FROM {_COLUMNS} x JOIN hit ON t = table_name GROUP BY 1, 2)
    SELECT table_name AS class, properties FROM (SELECT *, sum(20 + 30 * n) OVER (ORDER BY place) AS used FROM c) y WHERE used <= 400""")
def tbox_context(spark, sf_dir):
    """The classes nearest a question with their properties, as many as a token budget takes."""
    hits = spark.createDataFrame([("customer", 1), ("orders", 2), ("lineitem", 3)], "class string, place int")
    c = catalog.discover_columns(spark, sf_dir).select(F.col("table_name").alias("class"), F.col("column_name").alias("property"))
    return triples.context(hits, c, 400)


# --- functions -------------------------------------------------------------


@query("iri_lookup_key", "SELECT p_partkey, lower(regexp_replace(trim(p_type || '  ' || p_name), '\\s+', '-', 'g')) AS key FROM part")
def iri_lookup_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.iri_key(F.concat("p_type", F.lit("  "), "p_name")).alias("key"))


@query("json_safe", "SELECT '{\"k\":' || o_orderkey || ',\"price\":\"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '\",\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"tags\":[\"' || o_orderstatus || '\"]}' AS j FROM orders")
def json_safe(spark, sf_dir):
    """A row as JSON: decimals and dates are texts, nested values too."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.to_date("o_orderdate").alias("day"), F.array("o_orderstatus").alias("tags"))
    return o.select(names.json_safe(o.schema, F.struct(*o.columns)).alias("j"))


@query("float_to_decimal", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def float_to_decimal(spark, sf_dir):
    """Floats of nested columns as decimals, so that sums are exact."""
    rows = read(spark, sf_dir, "lineitem").select(F.struct("l_returnflag", F.array("l_extendedprice").alias("prices")).alias("x"))
    exact = names.without_floats(rows, "decimal(18,2)")
    return exact.groupBy(F.col("x.l_returnflag").alias("l_returnflag")).agg((F.sum(F.get("x.prices", F.lit(0))) * 100).cast("bigint").alias("cents"))


@query("active_counts", "SELECT user_id % 10 AS namespace, sum((event_type IN ('click', 'view'))::INT)::BIGINT AS active, count(*) AS jobs FROM events GROUP BY 1")
def active_counts(spark, sf_dir):
    """Jobs of each namespace in one of a set of states."""
    active = F.col("event_type").isin("click", "view").cast("long")
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("namespace")).agg(F.sum(active).alias("active"), F.count("*").alias("jobs"))


@query("catalog_scan", f"SELECT table_name, column_name, ordinal_position::INT AS position, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE 'array<float>' END AS data_type, false AS is_partition FROM {_COLUMNS} c")
def catalog_scan(spark, sf_dir):
    """Tables and columns of the session's catalog, partition keys marked."""
    for t in TABLES:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return catalog.scan(spark, TABLES).select("table_name", "column_name", "position", "data_type", "is_partition")


@query("literal_origin", "SELECT item_id, contains(lower(text), 'the ') AS said FROM benchmark")
def literal_origin(spark, sf_dir):
    """Whether a statement's literal comes from the question."""
    rows = read(spark, sf_dir, "benchmark")
    word = serving.literals("SELECT 1 FROM t WHERE x = 'The ' AND y = \"col\"")[0]
    return rows.select("item_id", F.lower("text").contains(word.lower()).alias("said"))
