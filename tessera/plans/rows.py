"""Vectors, names and types, catalog, documents, induction, quality and incremental queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import graphs, induce, metrics, quality, vectors
from tessera.plans.semantic import _FK
from tessera.registry import query
from tessera.sources import catalog, documents
from tessera.sources.tables import TABLES, read

_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = f"({_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})))"
_TABLES_SQL = "table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
_STOP = ("the", "of", "and", "with", "that", "for")
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)


# --- vectors ---------------------------------------------------------------


def _first_vector(spark, sf_dir, vec_id=0):
    return [float(v) for v in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


@query("knn_topk", f"SELECT a.vec_id, round({_COS.format('a.embedding', 'q.embedding')}, 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS.format('a.embedding', 'q.embedding')} DESC, a.vec_id LIMIT 20")
def knn_topk(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT a.vec_id, round({_COS.format('a.embedding', 'q.embedding')}, 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0 AND a.label IN (1, 3) ORDER BY {_COS.format('a.embedding', 'q.embedding')} DESC, a.vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    """The filter comes before the distance, so k rows are found if there are k."""
    return vectors.top_k(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, where=F.col("label").isin(1, 3)).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_join", f"""SELECT query_id, label, vec_id, place FROM (SELECT q.vec_id AS query_id, a.label, a.vec_id, row_number() OVER (PARTITION BY q.vec_id, a.label ORDER BY {_COS.format('a.embedding', 'q.embedding')} DESC, a.vec_id) AS place
    FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0) t WHERE place <= 3""")
def knn_join(spark, sf_dir):
    """Every stated query against every group: top three of each."""
    e = read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.top_k_join(e, q, 3, by="label").select("query_id", "label", "vec_id", "place")


@query("cosine", f"SELECT a.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


_SCORES = "(SELECT p_partkey AS id, (p_size * 2 % 101) / 100.0 AS lexical, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 97) / 97.0 END AS structural FROM part)"


def _scores(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), ((F.col("p_size") * 2 % 101) / 100.0).alias("lexical"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 97) / 97.0).alias("structural"))


@query("fused_score", f"SELECT id, round(0.6 * lexical + 0.4 * coalesce(structural, 0), 6) AS score FROM {_SCORES} s")
def fused_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", F.round(names.fused_score(F.col("lexical"), F.col("structural"), 0.4), 6).alias("score"))


@query("score_band", f"SELECT CASE WHEN lexical >= 0.95 THEN 'exact' WHEN lexical >= 0.8 THEN 'close_match' ELSE 'novel' END AS band, count(*) AS n FROM {_SCORES} s GROUP BY 1")
def score_band(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy(names.score_band(F.col("lexical")).alias("band")).agg(F.count("*").alias("n"))


@query("score_tier", f"""SELECT CASE WHEN structural IS NULL THEN 'novel' WHEN id % 2 = 0 THEN CASE WHEN structural >= 0.85 THEN 'exact' WHEN structural >= 0.65 THEN 'high_confidence' WHEN structural >= 0.4 THEN 'ambiguous' ELSE 'novel' END
    ELSE CASE WHEN structural >= 0.95 THEN 'exact' WHEN structural >= 0.8 THEN 'high_confidence' WHEN structural >= 0.5 THEN 'ambiguous' ELSE 'novel' END END AS tier, count(*) AS n FROM {_SCORES} s GROUP BY 1""")
def score_tier(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy(names.score_tier(F.col("structural"), F.col("id") % 2 == 0).alias("tier")).agg(F.count("*").alias("n"))


@query("skip_decision", "SELECT max(CASE WHEN place <= 50 AND mapped THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN place <= 10 AND mapped THEN 1 ELSE 0 END) = 0 AS skip FROM (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place, p_size > 45 AS mapped FROM part) t")
def skip_decision(spark, sf_dir):
    """Skip if some of the best fifty hits are mapped and none of the best ten; only fifty rows are ranked."""
    best = read(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    ranked = best.select((F.col("p_size") > 45).alias("mapped"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))
    return ranked.agg((F.max(F.when(F.col("mapped"), 1).otherwise(0)) == 1).alias("a"), (F.max(F.when(F.col("mapped") & (F.col("place") <= 10), 1).otherwise(0)) == 0).alias("b")).select((F.col("a") & F.col("b")).alias("skip"))


@query("hybrid", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'with')) AS tf0, len(list_filter(w, lambda x: x = 'license')) AS tf1 FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS a, sum((tf0 > 0)::INT) AS df0, sum((tf1 > 0)::INT) AS df1 FROM c),
    r AS (SELECT doc_id, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / a)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / a)) AS b FROM c, s WHERE tf0 + tf1 > 0)
    SELECT doc_id, round(0.3 * b + coalesce(label / 10.0, 0), 6) AS score FROM r LEFT JOIN embeddings ON vec_id = doc_id""")
def hybrid(spark, sf_dir):
    """0.3 of BM25 plus a score from the vectors' side."""
    words = vectors.bm25(read(spark, sf_dir, "documents"), ["with", "license"])
    side = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") / 10.0).alias("v"))
    return words.join(side, "doc_id", "left").select("doc_id", F.round(0.3 * F.col("bm25") + F.coalesce("v", F.lit(0.0)), 6).alias("score"))


@query("weighted_fusion", "SELECT doc_id AS id, round(sum(s), 6) AS score FROM (SELECT doc_id, 1.0 * quality AS s FROM labels UNION ALL SELECT doc_id, 0.5 * toxic FROM labels) t GROUP BY 1")
def weighted_fusion(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    parts = [(lab.select(F.col("doc_id").alias("id"), F.col(c).cast("double").alias("score")), w) for c, w in (("quality", 1.0), ("toxic", 0.5))]
    return vectors.weighted_fusion(parts).select("id", F.round("score", 6).alias("score"))


@query("ground_exact", "SELECT p.p_partkey, CASE WHEN n.n_name IS NOT NULL THEN 1.0 ELSE 0.5 END AS confidence FROM part p LEFT JOIN nation n ON lower(n.n_name) = lower(split_part(p.p_name, ' ', 1))")
def ground_exact(spark, sf_dir):
    """An exact name, ignoring case, short-circuits the score."""
    n = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("k"), F.lit(1.0).alias("hit"))
    p = read(spark, sf_dir, "part").withColumn("k", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return p.join(n, "k", "left").select("p_partkey", F.coalesce("hit", F.lit(0.5)).alias("confidence"))


@query("schema_retrieve", f"SELECT table_name AS t, count(*) AS n FROM information_schema.columns WHERE {_TABLES_SQL} AND regexp_matches(column_name, 'key|type|price|text') GROUP BY 1 ORDER BY n DESC, t LIMIT 7")
def schema_retrieve(spark, sf_dir):
    """Of all tables the seven whose column names hold the most terms of the question, best first."""
    cols = catalog.discover_columns(spark, sf_dir)
    return cols.filter(F.col("column_name").rlike("key|type|price|text")).groupBy(F.col("table_name").alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(7)


# --- names, types, text ----------------------------------------------------


@query("norm_predicate", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part")
def norm_predicate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.normal_predicate(F.col("p_type")).alias("name"))


@query("camel_spaced", "SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || p_type[1] || lower(p_type[2:]) || ' HTTP ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS spaced FROM part")
def camel_spaced(spark, sf_dir):
    """redEconomyHTTPWidget and its like."""
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    name = F.concat(first, F.initcap(F.lower("p_type")), F.lit("HTTP"), F.initcap(second))
    return read(spark, sf_dir, "part").select("p_partkey", names.camel_spaced(name).alias("spaced"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(c_mktsegment || ' ' || c_name, '[^a-zA-Z0-9\\s_-]', '', 'g'), '[\\s_-]+'), lambda w: w <> '')"


@query("to_pascal", f"SELECT c_custkey, array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM customer")
def to_pascal(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", names.pascal_case(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("name"))


@query("to_camel", f"SELECT c_custkey, lower(n[1]) || n[2:] AS name FROM (SELECT c_custkey, array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || lower(w[2:])), '') AS n FROM customer) t")
def to_camel(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", names.camel_case(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("name"))


@query("local_name", "SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS name FROM pages")
def local_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", names.local_name(F.col("url")).alias("name"))


@query("iri_ascii", "SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(url_encode(regexp_replace(trim(p_type || ' & ' || p_brand), '\\s+', '-', 'g')), '%20', '+'), '~', '%7E'), '-+', '-', 'g'), '^-|-$', '', 'g') AS segment FROM part")
def iri_ascii(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", names.iri_segment(F.concat("p_type", F.lit(" & "), "p_brand")).alias("segment"))


@query("iri_first_seen", "SELECT lower(p_brand) AS k, min_by(p_brand, p_partkey) AS spelling FROM part GROUP BY 1")
def iri_first_seen(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("k")).agg(F.min_by("p_brand", "p_partkey").alias("spelling"))


_LITERALS = "(SELECT 'true' AS v UNION ALL SELECT '12' UNION ALL SELECT '-1.5' UNION ALL SELECT '2024-01-02' UNION ALL SELECT '2024-01-02T03:04:05' UNION ALL SELECT 'x 1' UNION ALL SELECT CAST(p_retailprice AS VARCHAR) FROM part UNION ALL SELECT p_brand FROM part)"
_LITERAL_SQL = "CASE WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(trim(v), '^[+-]?[0-9]*\\.[0-9]+$') THEN 'decimal' WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') THEN 'dateTime' WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' ELSE 'string' END"


@query("literal_type", f"SELECT {_LITERAL_SQL} AS kind, count(*) AS n FROM {_LITERALS} t GROUP BY 1")
def literal_type(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    v = spark.createDataFrame([(x,) for x in ("true", "12", "-1.5", "2024-01-02", "2024-01-02T03:04:05", "x 1")], "v string")
    v = v.union(p.select(F.col("p_retailprice").cast("string"))).union(p.select("p_brand"))
    return v.groupBy(names.literal_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


# DuckDB's names of the columns' types and what they are in XSD
_XSD_SQL = "CASE data_type WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'dateTime' WHEN 'DATE' THEN 'date' ELSE 'string' END"


@query("type_map", f"SELECT table_name, column_name, {_XSD_SQL} AS xsd FROM information_schema.columns WHERE {_TABLES_SQL}")
def type_map(spark, sf_dir):
    """Every column's XSD type."""
    return catalog.discover_columns(spark, sf_dir).select("table_name", "column_name", names.xsd_type(F.col("data_type")).alias("xsd"))


@query("type_map_named", """SELECT e.event_type AS said, p.p_name AS about, count(*) AS n, CASE WHEN e.event_type IN ('click', 'view') AND right(p.p_name, 4) <> 'ring' THEN 'decimal' ELSE 'string' END AS xsd
    FROM events e JOIN part p ON p.p_partkey = e.event_id GROUP BY 1, 2""")
def type_map_named(spark, sf_dir):
    """A text column named after a number is a decimal: names are made from events and parts, some with a number's word in front."""
    j = read(spark, sf_dir, "events").join(read(spark, sf_dir, "part"), F.col("event_id") == F.col("p_partkey")).groupBy(F.col("event_type").alias("said"), F.col("p_name").alias("about")).agg(F.count("*").alias("n"))
    word = F.when(F.col("said") == "click", "Total_").when(F.col("said") == "view", "lat_").otherwise("grand")
    name = F.when(F.col("about").endswith("ring"), F.regexp_replace("about", " ", "_")).otherwise(F.concat(word, F.regexp_replace("about", " ", "_")))
    return j.select("said", "about", "n", names.xsd_type_named(F.lit("varchar(20)"), name).alias("xsd"))


@query("type_family", f"SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' WHEN 'VARCHAR' THEN 'string' ELSE 'array<float>' END AS family FROM information_schema.columns WHERE {_TABLES_SQL}")
def type_family(spark, sf_dir):
    return catalog.discover_columns(spark, sf_dir).select("table_name", "column_name", names.type_family(F.col("data_type")).alias("family"))


@query("xsd_canon", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey <= 32767 THEN 'short' ELSE 'SmallInt' END WHEN 'P' THEN 'decimal'
    ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'timestamp' ELSE 'geometry' END END AS canon FROM orders""")
def xsd_canon(spark, sf_dir):
    """An alias becomes the usual name where the text is valid for it, else it stays; so does what isn't known."""
    o = read(spark, sf_dir, "orders")
    token = F.when(F.col("o_orderstatus") == "F", "SmallInt").when(F.col("o_orderstatus") == "P", "NUMBER").when(F.col("o_orderpriority") == "5-LOW", "timestamp").otherwise("geometry")
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).when(F.col("o_orderstatus") == "P", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", names.canonical_xsd(token, text).alias("canon"))


@query("term_extract", f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*'), lambda t: length(t) > 2 AND t NOT IN ({_STOP_SQL}))[:8], ' ') AS terms FROM conversations")
def term_extract(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(names.query_terms(F.col("text"), _STOP, 8), " ").alias("terms"))


@query("residual", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_%$]+'), lambda t: t NOT IN ({_STOP_SQL})), ' ') AS rest FROM benchmark")
def residual(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(metrics.residual_tokens(F.col("text"), _STOP), " ").alias("rest"))


@query("datamark", "SELECT conv_id, turn, md5(regexp_replace(text, '\\s+', '^', 'g')) AS marked FROM conversations")
def datamark(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(names.datamarked(F.col("text")).cast("binary")).alias("marked"))


@query("json_dialect", """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name ELSE '' END AS expression FROM part""")
def json_dialect(spark, sf_dir):
    """The TRINO expression if there is one, else the first, else nothing; broken JSON gives nothing."""
    entry = lambda dialect, c: F.concat(F.lit('{"dialect":"' + dialect + '","expression":"'), F.col(c), F.lit('"}'))
    kind = F.col("p_size") % 4
    j = F.when(kind == 0, F.concat(F.lit("["), entry("ANSI", "p_name"), F.lit(","), entry("trino", "p_brand"), F.lit("]"))).when(kind == 1, F.concat(F.lit("["), entry("ANSI", "p_type"), F.lit("]")))
    j = j.when(kind == 2, F.concat(F.lit("["), entry("MYSQL", "p_name"), F.lit(","), entry("ANSI", "p_type"), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.col("p_name")))
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.from_json(j, "array<struct<dialect:string,expression:string>>").alias("a"))
    trino = F.filter("a", lambda x: F.upper(x["dialect"]) == "TRINO")
    pick = F.coalesce(F.get(trino, F.lit(0))["expression"], F.get("a", F.lit(0))["expression"], F.lit(""))
    return d.select("id", pick.alias("expression"))


@query("calibrate", f"SELECT id, round(greatest(0, least(1, CASE WHEN id % 5 = 0 THEN lexical * 0.5 ELSE lexical END)), 6) AS confidence FROM {_SCORES} s")
def calibrate(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", F.round(induce.calibrated(F.col("lexical"), F.col("id") % 5), 6).alias("confidence"))


@query("heuristic_conf", f"SELECT id % 10 AS g, round(least(0.95, 0.8 * avg(lexical) + 0.1 * max(CASE WHEN structural IS NULL THEN 0 ELSE 1 END) + 0.1), 6) AS confidence FROM {_SCORES} s GROUP BY 1")
def heuristic_conf(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.groupBy((F.col("id") % 10).alias("g")).agg(F.round(F.least(F.lit(0.95), 0.8 * F.avg("lexical") + 0.1 * F.max(F.col("structural").isNotNull().cast("int")) + 0.1), 6).alias("confidence"))


@query("merge_spans", """WITH s AS (SELECT l_suppkey AS key, l_partkey % 500 AS start, l_partkey % 500 + l_linenumber AS "end" FROM lineitem),
    m AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM s),
    i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT key, min(start) AS start, max("end") AS "end" FROM i GROUP BY key, island""")
def merge_spans(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 500).alias("start"), (F.col("l_partkey") % 500 + F.col("l_linenumber")).alias("end"))
    return metrics.merge_spans(s)


@query("metric_match", """WITH q AS (SELECT conv_id * 1000 + turn AS qid, lower(text) AS t FROM conversations WHERE text IS NOT NULL),
    m(metric, namespace, label, is_name) AS (VALUES ('greeting', '', 'the', true), ('greeting', 'sales', 'and the', false), ('hidden', 'other', 'the', true), ('two_words', 'SALES', 'that_the', false))
    SELECT qid, metric, max(is_name::INT) AS by_name, count(*)::INT AS hits FROM q JOIN m ON regexp_matches(t, '(^|\\W)' || replace(label, '_', '[_ ]') || '(\\W|$)') WHERE namespace IN ('', 'sales', 'SALES') GROUP BY 1, 2""")
def metric_match(spark, sf_dir):
    q = read(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    m = [("greeting", "", "the", True), ("greeting", "sales", "and the", False), ("hidden", "other", "the", True), ("two_words", "SALES", "that_the", False)]
    return metrics.match_metrics(q, spark.createDataFrame(m, "metric string, namespace string, label string, is_name boolean"), "sales").withColumn("hits", F.col("hits").cast("int"))


@query("metric_allowed", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#1') GROUP BY 1")
def metric_allowed(spark, sf_dir):
    allowed = F.broadcast(spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#1",)], "p_brand string"))
    return read(spark, sf_dir, "part").join(allowed, "p_brand", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))


# --- catalog ---------------------------------------------------------------


@query("disc_columns", "SELECT table_name, ordinal_position::INT AS position, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')")
def disc_columns(spark, sf_dir):
    return catalog.discover_columns(spark, sf_dir, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")).select("table_name", "position", "column_name")


_PROFILE = ("l_returnflag", "l_linestatus", "l_quantity", "l_partkey")


@query("enum_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) <= 25 AND count(*) >= 3 * count(DISTINCT {c}) AS is_enum FROM lineitem WHERE {c} IS NOT NULL" for c in _PROFILE))
def enum_profile(spark, sf_dir):
    return catalog.enum_profile(read(spark, sf_dir, "lineitem"), list(_PROFILE)).select("column_name", "total", "distinct_values", "is_enum")


@query("enum_values", "SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def enum_values(spark, sf_dir):
    return catalog.enum_values(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("glob_filter", "SELECT DISTINCT table_name FROM information_schema.columns WHERE regexp_matches(table_name, '^(n.*|part|[lo].*)$') AND table_name <> 'labels' AND table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'labels', 'pages')")
def glob_filter(spark, sf_dir):
    names_ = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels", "pages")
    return spark.createDataFrame([(n,) for n in names_], "table_name string").filter(catalog.matches(F.col("table_name"), "n*|part,[l,o]*", "labels"))


_PRINT_SQL = f"""(SELECT table_name, substring(sha256(string_agg(pair, ',' ORDER BY pair)), 1, 16) AS fingerprint FROM (SELECT table_name, lower(column_name) || ':' || CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' WHEN 'VARCHAR' THEN 'string' ELSE 'array<float>' END AS pair FROM information_schema.columns WHERE {_TABLES_SQL}) c GROUP BY 1)"""


@query("schema_fingerprint", f"SELECT table_name, fingerprint FROM {_PRINT_SQL} f")
def schema_fingerprint(spark, sf_dir):
    return catalog.fingerprints(catalog.discover_columns(spark, sf_dir))


@query("rescan_diff", f"""SELECT table_name, CASE WHEN table_name LIKE 'p%' THEN 'insert' WHEN old.n <> 0 AND table_name LIKE '%e%' THEN 'revise' ELSE 'unchanged' END AS action FROM {_PRINT_SQL} f, (SELECT count(*) AS n FROM region) old""")
def rescan_diff(spark, sf_dir):
    """Tables that weren't there, that have another fingerprint than before, and the rest."""
    now = catalog.fingerprints(catalog.discover_columns(spark, sf_dir))
    known = now.filter("table_name not like 'p%'").withColumn("fingerprint", F.when(F.col("table_name").contains("e"), F.reverse("fingerprint")).otherwise(F.col("fingerprint")))
    return catalog.rescan(known, now)


@query("upsert_merge", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM customer")
def upsert_merge(spark, sf_dir):
    """Odd keys and multiples of three are stored, even keys are scanned: every key is in one of them, some in both."""
    c = read(spark, sf_dir, "customer")
    return catalog.upsert(c.filter("c_custkey % 2 <> 0 OR c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("origin")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("origin")), "k")


_SEVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_SEVEN_SQL = "(SELECT * FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _SEVEN) + "))"


def _references(spark, sf_dir):
    """References as the column names tell them, as catalog rows."""
    r = catalog.inferred_references(catalog.discover_columns(spark, sf_dir, _SEVEN))
    return r.select(F.col("src").alias("table_name"), F.lit("FOREIGN KEY").alias("kind"), F.col("rel").alias("column_name"), F.col("dst").alias("ref_table"))


@query("r2rml_rows", f"SELECT upper(table_name[1]) || table_name[2:] AS class_name, column_name, column_name[1] || upper(column_name[3]) || column_name[4:] AS property, CASE WHEN dst IS NULL THEN 'datatype' ELSE 'object' END AS kind, coalesce(dst, '') AS ref_table FROM {_SEVEN_SQL} c LEFT JOIN {_FK} f ON f.src = c.table_name AND f.rel = c.column_name")
def r2rml_rows(spark, sf_dir):
    return catalog.mapping_rows(catalog.discover_columns(spark, sf_dir, _SEVEN), _references(spark, sf_dir)).drop("table_name")


@query("subtypes", "WITH p AS (SELECT p_brand AS child, min(p_type) AS parent FROM part GROUP BY 1) SELECT child, parent, CASE WHEN count(*) OVER (PARTITION BY parent) >= 2 THEN 'confirmed' ELSE 'suggested' END AS status FROM p WHERE child <> 'Brand#3'")
def subtypes(spark, sf_dir):
    """Brands as tables whose only key refers to the only key of their first type's table; one brand's key has two columns."""
    pairs = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("child")).agg(F.min("p_type").alias("parent"))
    row = lambda table, kind, column, ref: F.struct(table.alias("table_name"), F.lit(kind).alias("kind"), F.lit(1).alias("position"), F.lit(column).alias("column_name"), ref.alias("ref_table"), F.when(ref.isNotNull(), "id").alias("ref_column"))
    none = F.lit(None).cast("string")
    two = F.when(F.col("child") == "Brand#3", row(F.col("child"), "PRIMARY KEY", "id2", none))
    keys = pairs.select(F.explode(F.array_compact(F.array(row(F.col("child"), "PRIMARY KEY", "id", none), row(F.col("child"), "FOREIGN KEY", "id", F.col("parent")), row(F.col("parent"), "PRIMARY KEY", "id", none), two))).alias("k")).select("k.*").distinct()
    return catalog.subtypes(keys)


@query("unknown_tables", f"SELECT DISTINCT event_type AS table_name FROM events WHERE event_type NOT IN (SELECT table_name FROM {_SEVEN_SQL} c)")
def unknown_tables(spark, sf_dir):
    """Names that are asked for and no table, ignoring case: event types and all tables in capitals."""
    known = catalog.discover_columns(spark, sf_dir).select("table_name")
    asked = read(spark, sf_dir, "events").select(F.col("event_type").alias("table_name")).union(known.select(F.upper("table_name")))
    return quality.unknown(asked, known, ["table_name"])


@query("unknown_columns", f"SELECT table_name, column_name || '_code' AS column_name FROM {_SEVEN_SQL} c WHERE ordinal_position % 2 = 0")
def unknown_columns(spark, sf_dir):
    known = catalog.discover_columns(spark, sf_dir, _SEVEN)
    asked = known.select(F.upper("table_name").alias("table_name"), F.upper(F.when(F.col("position") % 2 == 0, F.concat("column_name", F.lit("_code"))).otherwise(F.col("column_name"))).alias("column_name"))
    return quality.unknown(asked, known, ["table_name", "column_name"])


@query("type_compat", f"SELECT column_name, op AS operator FROM {_SEVEN_SQL} c, (VALUES ('>'), ('LIKE'), ('='), ('BETWEEN')) v(op) WHERE op IN ('>', 'BETWEEN') AND data_type = 'VARCHAR' OR op = 'LIKE' AND data_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
def type_compat(spark, sf_dir):
    """Filters that don't go with a column's type, of every operator on every column."""
    c = catalog.discover_columns(spark, sf_dir, _SEVEN)
    return quality.type_conflicts(c.select("column_name", F.explode(F.array(*map(F.lit, (">", "LIKE", "=", "BETWEEN")))).alias("operator")), c)


# --- documents -------------------------------------------------------------


@query("exact_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) t WHERE r = 1")
def exact_dedup(spark, sf_dir):
    return documents.first_of_copies(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("doc_gate", "SELECT coalesce(CASE WHEN trim(text) = '' THEN 'empty' WHEN strlen(text) < 300 THEN 'too_small' WHEN strlen(text) > 8000 THEN 'too_large' END, 'taken') AS reason, count(*) AS n FROM documents GROUP BY 1")
def doc_gate(spark, sf_dir):
    return documents.gate(read(spark, sf_dir, "documents"), 300, 8000).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


@query("doc_sparse_flag", "SELECT page_id, page_id % 4 = 0 OR length(html) / (page_id % 4) < 50 AS scanned FROM pages")
def doc_sparse_flag(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    pages = F.col("page_id") % 4
    return p.select("page_id", F.coalesce(documents.is_scanned(F.length("html"), F.nullif(pages, F.lit(0))), F.lit(True)).alias("scanned"))


@query("elements_md", "SELECT conv_id, md5(string_agg(CASE role WHEN 'system' THEN '## ' || trim(text) WHEN 'user' THEN '- ' || trim(text) ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn)) AS markdown FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def elements_md(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "Title").when(F.col("role") == "user", "ListItem").otherwise("Text")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", documents.elements_to_markdown(kind, F.col("text")).alias("m")).filter("m is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"])
    return c.groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n\n").cast("binary")).alias("markdown"))


# --- induction -------------------------------------------------------------

_REL = "(SELECT lang AS domain, 'Has  Source!' AS predicate, source AS range, 1 AS count FROM documents UNION ALL SELECT lang, 'has source', source, 1 FROM documents WHERE doc_id % 2 = 0)"


def _rel(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    one = d.select(F.col("lang").alias("domain"), F.lit("Has  Source!").alias("predicate"), F.col("source").alias("range"), F.lit(1).alias("count"))
    return one.unionByName(d.filter("doc_id % 2 = 0").select(F.col("lang").alias("domain"), F.lit("has source").alias("predicate"), F.col("source").alias("range"), F.lit(1).alias("count")))


@query("path_aggregate", f"SELECT domain, 'has_source' AS predicate, range, sum(count)::BIGINT AS freq FROM {_REL} t GROUP BY 1, 3 HAVING sum(count) >= 3")
def path_aggregate(spark, sf_dir):
    return induce.relations(_rel(spark, sf_dir), 3).orderBy(F.desc("freq"), "domain", "predicate", "range")


@query("class_relations", f"SELECT domain, predicate, range, sum(count)::BIGINT AS freq FROM {_REL} t GROUP BY 1, 2, 3")
def class_relations(spark, sf_dir):
    return _rel(spark, sf_dir).groupBy("domain", "predicate", "range").agg(F.sum("count").alias("freq"))


@query("class_context", f"SELECT class, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT domain AS class, count AS o, 0 AS i FROM {_REL} a UNION ALL SELECT range, 0, count FROM {_REL} b) t GROUP BY 1")
def class_context(spark, sf_dir):
    return induce.class_contexts(_rel(spark, sf_dir))


@query("class_nodes", "SELECT source AS class, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, class")
def class_nodes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


@query("class_floor", "SELECT p_brand || p_size AS class, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3")
def class_floor(spark, sf_dir):
    return induce.classes(read(spark, sf_dir, "part").select(F.concat("p_brand", "p_size").alias("class")))


@query("topic_counts", "SELECT n.n_name AS topic, count(s.s_suppkey) AS statements FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY 1")
def topic_counts(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return read(spark, sf_dir, "nation").join(s, "n_nationkey", "left").groupBy(F.col("n_name").alias("topic")).agg(F.count("s_suppkey").alias("statements"))


@query("topic_concepts", "SELECT DISTINCT trim(p_type) AS concept FROM part WHERE trim(p_type) <> ''")
def topic_concepts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.trim("p_type").alias("concept")).filter("concept <> ''").distinct()


@query("object_props", """WITH f AS (SELECT lang AS domain, CASE WHEN doc_id % 3 = 0 THEN 'Comes From' ELSE 'comes from' END AS p, source FROM documents),
    l AS (SELECT domain, p, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, p) AS r FROM f GROUP BY 1, 2)
    SELECT f.domain, 'comes_from' AS name, any_value(l.p) AS label, string_agg(DISTINCT source, ',' ORDER BY source) AS ranges FROM f JOIN l ON l.domain = f.domain AND l.r = 1 GROUP BY 1""")
def object_props(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return induce.object_properties(d.select(F.col("lang").alias("subject_class"), F.when(F.col("doc_id") % 3 == 0, "Comes From").otherwise("comes from").alias("predicate"), F.col("source").alias("object_class")))


@query("datatype_props", "SELECT o_orderstatus AS domain, p AS name, p AS label, CASE p WHEN 'key' THEN 'integer' ELSE 'string' END AS datatype FROM (SELECT DISTINCT o_orderstatus, unnest(['key', 'mixed']) AS p FROM orders) t")
def datatype_props(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("subject_class"), F.explode(F.array(F.struct(F.lit("key").alias("predicate"), F.col("o_orderkey").cast("string").alias("complement")), F.struct(F.lit("mixed").alias("predicate"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("a").alias("complement")))).alias("x"))
    return induce.datatype_properties(rows.select("subject_class", "x.*"))


@query("stratified_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) t WHERE n >= 3 AND r <= greatest(5, ceil(sqrt(n)))")
def stratified_sample(spark, sf_dir):
    return induce.stratified_sample(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("name_collision", "SELECT p_partkey, CASE WHEN r = 1 THEN p_type ELSE p_type || '_' || substring(sha256(id), 1, 8) END AS name FROM (SELECT p_partkey, p_type, p_name || p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_name || p_partkey) AS r FROM part) t")
def name_collision(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat("p_name", "p_partkey").alias("id"))
    return induce.unique_names(p, "p_type", "id").select("p_partkey", "name")


@query("best_of", "SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) t WHERE r = 1")
def best_of(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return graphs.keep_best(rows, ["l_partkey"], "l_quantity", "o").select("l_partkey", "l_orderkey", "l_quantity")


@query("protected_upsert", """SELECT 't' || s_nationkey AS table_name, s_name AS column_name, 'p' AS ref_table, 'id' AS ref_column, s_suppkey % 2 = 0 AS protected FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 't' || s_nationkey, s_name, CASE s_suppkey % 5 WHEN 0 THEN 'p' ELSE 'r' END, 'id', false FROM supplier WHERE NOT (s_suppkey % 3 <> 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = 0))""")
def protected_upsert(spark, sf_dir):
    """References stored and found anew: a protected one keeps its column, an equal one isn't stored twice."""
    k = F.col("s_suppkey")
    row = lambda ref, protected: [F.concat(F.lit("t"), "s_nationkey").alias("table_name"), F.col("s_name").alias("column_name"), ref.alias("ref_table"), F.lit("id").alias("ref_column"), protected.alias("protected")]
    s = read(spark, sf_dir, "supplier")
    return induce.protected_upsert(s.filter(k % 3 != 0).select(*row(F.lit("p"), k % 2 == 0)), s.select(*row(F.when(k % 5 == 0, "p").otherwise("r"), F.lit(False))))


@query("budget_trim", "SELECT kind, item FROM (SELECT p_brand AS kind, p_partkey AS item, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER () * 20 AS total FROM part) t WHERE r <= floor(n * least(1.0, 8000.0 / total))")
def budget_trim(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("item"), F.lit(20).alias("cost"))
    return induce.budget_trim(p, "kind", "item", "cost", 8000).select("kind", "item")


@query("token_budget", "SELECT CAST(count(DISTINCT p_brand) * 20 + count(*) * 30 + count(DISTINCT p_type) * 40 AS BIGINT) AS tokens FROM part")
def token_budget(spark, sf_dir):
    return read(spark, sf_dir, "part").agg((F.count_distinct("p_brand") * 20 + F.count("*") * 30 + F.count_distinct("p_type") * 40).alias("tokens"))


@query("topk_pinned", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = last THEN 0 ELSE 1 END, length(text) DESC, turn) AS r FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) x) t WHERE r <= 3")
def topk_pinned(spark, sf_dir):
    """The newest turn first, then by score."""
    w = Window.partitionBy("conv_id")
    c = read(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(w))
    r = F.row_number().over(w.orderBy((F.col("turn") != F.col("last")).cast("int"), F.desc(F.length("text")), "turn"))
    return c.withColumn("r", r).filter("r <= 3").select("conv_id", "turn")


@query("incremental_dedup", "SELECT DISTINCT conv_id, turn FROM conversations")
def incremental_dedup(spark, sf_dir):
    """New rows added to those held, by key; two thirds each, so that every conversation is in one of them and a third in both."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    held = c.filter("conv_id % 3 <> 0")
    return held.unionByName(c.filter("conv_id % 3 <> 1").join(held, ["conv_id", "turn"], "left_anti"))


@query("align_candidates", "SELECT p_type AS name, count(DISTINCT p_brand) AS repos FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 5")
def align_candidates(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count_distinct("p_brand").alias("repos")).filter("repos >= 5")


@query("align_context", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type))[:5], ',') AS properties FROM part GROUP BY 1")
def align_context(spark, sf_dir):
    """A class's properties, at most five."""
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 5), ",").alias("properties"))


@query("grant_merge", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS denied FROM nation GROUP BY 1")
def grant_merge(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.array("n_name", "n_name").alias("deny"))
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deny")))), ",").alias("denied"))


@query("dataset_resolve", "SELECT k AS name, CASE WHEN n_name IS NULL THEN 'unresolved' ELSE 'ok' END AS status FROM (VALUES (0), (3), (99)) v(k) LEFT JOIN nation ON n_nationkey = k")
def dataset_resolve(spark, sf_dir):
    v = spark.createDataFrame([(0,), (3,), (99,)], "name int")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), "n_name")
    return v.join(n, "name", "left").select("name", F.when(F.col("n_name").isNull(), "unresolved").otherwise("ok").alias("status"))


@query("reconcile", "SELECT p_partkey AS id, CASE WHEN p_size % 4 < 2 THEN p_type ELSE p_name END AS description, p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',' || p_type END AS synonyms FROM part")
def reconcile(spark, sf_dir):
    """A description gives way only to a source of higher standing; synonyms add up, ignoring case."""
    p = read(spark, sf_dir, "part")
    stored = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("old"), (F.col("p_size") % 4).alias("standing"), F.array("p_brand").alias("have"))
    got = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("new"), F.when(F.col("p_size") % 3 == 0, F.array(F.upper("p_brand"))).otherwise(F.array(F.upper("p_brand"), "p_type")).alias("more"))
    j = stored.join(got, "id").withColumn("low", F.transform("have", lambda x: F.lower(x)))
    add = F.filter("more", lambda x: ~F.array_contains(F.col("low"), F.lower(x)))
    return j.select("id", F.when(F.col("standing") < 2, F.col("new")).otherwise(F.col("old")).alias("description"), F.array_join(F.concat("have", add), ",").alias("synonyms"))


@query("golden_exact", "SELECT sum((a.k IS NOT NULL AND b.k IS NOT NULL)::INT)::BIGINT AS exact, sum((a.k IS NULL)::INT)::BIGINT AS missing, sum((b.k IS NULL)::INT)::BIGINT AS novel, round(sum((a.k IS NOT NULL AND b.k IS NOT NULL)::INT) / nullif(count(a.k), 0), 3) AS precision_, round(sum((a.k IS NOT NULL AND b.k IS NOT NULL)::INT) / nullif(count(b.k), 0), 3) AS recall FROM (SELECT doc_id AS k FROM labels WHERE quality = 1) a FULL JOIN (SELECT doc_id AS k FROM documents WHERE lang = 'en') b ON a.k = b.k")
def golden_exact(spark, sf_dir):
    a = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(1).alias("a"))
    b = read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.lit(1).alias("b"))
    both = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long")
    s = a.join(b, "doc_id", "full").agg(F.sum(both).alias("exact"), F.sum(F.col("a").isNull().cast("long")).alias("missing"), F.sum(F.col("b").isNull().cast("long")).alias("novel"), F.count("a").alias("na"), F.count("b").alias("nb"))
    return s.select("exact", "missing", "novel", F.round(F.col("exact") / F.nullif("na", F.lit(0)), 3).alias("precision_"), F.round(F.col("exact") / F.nullif("nb", F.lit(0)), 3).alias("recall"))


@query("richness", f"SELECT round(count(dst) * 1.0 / count(*), 3) AS relationship, round((count(*) - count(dst)) * 1.0 / 7, 3) AS attribute FROM {_SEVEN_SQL} c LEFT JOIN {_FK} f ON f.src = c.table_name AND f.rel = c.column_name")
def richness(spark, sf_dir):
    """Share of relations among properties, and attributes per class."""
    m = catalog.mapping_rows(catalog.discover_columns(spark, sf_dir, _SEVEN), _references(spark, sf_dir))
    s = m.agg(F.sum((F.col("kind") == "object").cast("long")).alias("o"), F.sum((F.col("kind") == "datatype").cast("long")).alias("d"), F.count_distinct("class_name").alias("c"))
    return s.select(F.round(F.col("o") / (F.col("o") + F.col("d")), 3).alias("relationship"), F.round(F.col("d") / F.col("c"), 3).alias("attribute"))


# --- quality ---------------------------------------------------------------


@query("dq_required", "SELECT 'required' AS check_name, 'o_custkey' AS column_name, sum((o_custkey IS NULL)::INT)::BIGINT AS violations FROM orders UNION ALL SELECT 'positive', 'o_totalprice', sum((o_totalprice <= 0)::INT)::BIGINT FROM orders UNION ALL SELECT 'pattern', 'o_orderpriority', sum((NOT regexp_matches(o_orderpriority, '^[1-3]-'))::INT)::BIGINT FROM orders UNION ALL SELECT 'datatype', 'o_orderpriority', sum((TRY_CAST(o_orderpriority AS INT) IS NULL)::INT)::BIGINT FROM orders")
def dq_required(spark, sf_dir):
    return quality.profile(read(spark, sf_dir, "orders"), required=["o_custkey"], positive=["o_totalprice"], patterns={"o_orderpriority": "^[1-3]-"}, castable={"o_orderpriority": "int"})


@query("dq_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, sf_dir):
    return quality.not_unique(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_maxcount", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def dq_maxcount(spark, sf_dir):
    return quality.many_valued(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("dq_reference", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def dq_reference(spark, sf_dir):
    return quality.unreferenced(read(spark, sf_dir, "lineitem"), "l_partkey", read(spark, sf_dir, "part").filter("p_size > 25"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("label_missing", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def label_missing(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


# --- incremental -----------------------------------------------------------


@query("chunk_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def chunk_progress(spark, sf_dir):
    """All files taken by an availableNow stream, batch by batch, into counters."""
    from tessera.streaming.jobs import counted

    return counted(spark, sf_dir, "events", "event_type")
