"""Names in statements, federation, tiers, policy, projection headers, composite keys, ingestion, cycles and levels."""

import duckdb
import pytest

from tessera.operators import graphs, quality, serving, shapes, triples
from tessera.operators.serving import Gating, Grant, Policy, resolve
from tessera.operators.sqlgate import Rejected
from tessera.sources import jdbc, tables
from tests.conftest import SF


def test_relations(spark):
    sql = "WITH a AS (SELECT * FROM x.t1), b AS (SELECT * FROM a JOIN t2) SELECT 't3', (SELECT max(v) FROM c.d.t4) FROM b /* t5 */ JOIN `t 6` ON EXISTS (WITH z AS (SELECT 1) SELECT * FROM z, t7 AS z2)"
    found = serving.relations(spark, sql)
    assert [r.parts for r in found] == [("x", "t1"), ("t2",), ("c", "d", "t4"), ("t 6",), ("t7",)]
    assert [sql[r.start : r.end] for r in found] == ["x.t1", "t2", "c.d.t4", "`t 6`", "t7"]
    assert serving.catalogs(spark, sql) == ({"c"}, True) and serving.catalogs(spark, "SELECT 1 FROM c.d.t") == ({"c"}, False)
    assert serving.qualified(spark, "SELECT a.x FROM a JOIN db.b AS a2", ("k", "d")) == "SELECT a.x FROM `k`.`d`.`a` JOIN db.b AS a2"
    # a common table expression hides a table only behind it
    again = "WITH t AS (SELECT * FROM t) SELECT * FROM t"
    assert [r.start for r in serving.relations(spark, again)] == [again.index("FROM t)") + 5]


def test_federation(spark):
    one, two = spark.range(3).toDF("k"), spark.range(5).toDF("k")
    f = serving.Federation(spark, {"A": {"T": one, "only": one}, "b": {"t": two}})
    assert f.sql("SELECT * FROM a.t").count() == 3 and f.sql("SELECT * FROM lake.B.T", max_rows=4).count() == 4
    assert f.sql("SELECT a_public_only.k FROM A_PUBLIC_ONLY a_public_only").count() == 3
    assert f.used("SELECT 1 FROM only JOIN b.t") == {"a", "b"}
    for bad in ("SELECT * FROM t", "SELECT * FROM ghost", "SELECT * FROM c.t"):
        with pytest.raises(Rejected):
            f.sql(bad)
    assert serving.unprefixed("SRC_PUBLIC_ORDERS", ["src_public"]) == "orders" and serving.unprefixed("orders", ["src"]) == "orders"


def test_spellings():
    assert serving.transpiled("SELECT strpos(a, 'now()') FROM strpos", "spark") == "SELECT instr(a, 'now()') FROM strpos"
    assert serving.transpiled('SELECT "A b", x::text', "spark") == "SELECT `A b`, x::string"
    assert serving.transpiled("SELECT x::text, length(y)", "sqlserver") == "SELECT CAST(x AS nvarchar(max)), len(y)"
    assert serving.transpiled("SELECT now()", "elsewhere") == "SELECT now()"
    assert serving.literals("SELECT 'it''s', \"col\" -- 'no'") == ["it's"]
    assert serving.literal_from("WHERE x = 'Berlin'", "people in berlin?") and not serving.literal_from("WHERE x = 'Rome' AND y = ''", "people in berlin?")


def test_tiers():
    def fails(_):
        raise OSError

    tiers = [("metric", lambda q: None), ("structured", fails), ("knowledge", lambda q: q.upper())]
    out = resolve("x", tiers)
    assert out.tier == "knowledge" and out.answer == "X" and [t["status"] for t in out.trace] == ["miss", "failed", "answered"]
    assert [t["status"] for t in resolve("x", tiers, Gating.of(["documents"])).trace] == ["skipped", "skipped", "answered"]
    assert resolve("x", tiers, Gating.of(["jdbc"])).tier is None and resolve("x", tiers, pinned="metric").trace == [{"tier": "metric", "status": "miss"}]
    assert Gating.of(None) == Gating.of(["odd"]) == Gating()


def test_policy():
    p = Policy([Grant("analyst", "query", "Sales"), Grant("admin", "*", "*"), Grant("intern", "query", "*", "forbid")])
    assert p.allows(["Analyst"], "query", "sales") and not p.allows(["analyst"], "query", "hr") and not p.allows([], "query", "sales")
    assert p.allows(["admin"], "drop", "hr") and not p.allows(["admin", "intern"], "query", "hr")
    with pytest.raises(Rejected):
        p.check(None, "query", "sales")


def test_projection(spark):
    assert shapes.split_top("a, f(b, c), 'x,y', [d, e]") == ["a", "f(b, c)", "'x,y'", "[d, e]"] and shapes.split_top(" ") == []
    got = shapes.projection(spark, "SELECT DISTINCT ?b (COUNT(?x) AS ?n) WHERE { ?a :p ?b }", "[?n AS v1, ?b/1 AS v0]")
    assert got == {"variables": {"b": "v0", "n": "v1"}, "distinct": True}
    assert shapes.projection(spark, "SELECT ?a ?b WHERE {}", "[?a AS v0]") is None
    assert shapes.projection(spark, "SELECT * WHERE { }", "[?a AS v0]") == {"variables": {"a": "v0"}, "distinct": False}
    assert shapes.in_class("http://x/A/b", "http://x/A") and not shapes.in_class("http://x/Ab", "http://x/A") and shapes.in_class("http://x/A#z", "http://x/A#")


def test_composite_keys():
    a, b = (["a", "b"], [("p", "x"), ("p", "y")]), (["b", "c"], [("q", "x"), ("q", "y")])
    assert shapes.composite_usable(*a) and not shapes.composite_usable(["a"], [("p", "x")]) and not shapes.composite_usable(["a", "b"], [("p", "x"), ("q", "y")]) and not shapes.composite_usable(["a", "b"], [("p", "x"), ("p", "")])
    assert shapes.absorbed(["a", "b", "c"], [a, b]) == {"b": "a"}
    assert shapes.absorbed(["b", "a", "c"], [a]) == {"a": "b"}
    assert shapes.absorbed(["a", "b"], [(["a", "b"], [("p", "x")])]) == {"a": "", "b": ""} and shapes.absorbed(["a"], []) == {}
    assert shapes.absorbed(["d", "e", "f"], [(["d", "e", "f"], [("p", "1"), ("p", "2"), ("p", "3")])]) == {"e": "d", "f": "d"}


def test_ingest(spark):
    kind = "g string, s string, p string, o string, kind string"
    old = spark.createDataFrame([("g1", "a", "p", "1", "literal"), ("g2", "b", "p", "2", "literal")], kind)
    new = spark.createDataFrame([("g1", "c", "p", "3", "literal"), ("g1", "c", "p", "3", "literal")], kind)
    assert sorted(r["s"] for r in triples.ingest(old, new).collect()) == ["b", "c"]
    assert sorted(r["s"] for r in triples.ingest(old, new, append=True).collect()) == ["a", "b", "c"]


def test_long_rings_and_levels(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    chain = [(100 + i, 101 + i) for i in range(15)] + [(100, 0), (200, 200)]
    pairs = spark.createDataFrame(ring + chain, "child int, parent int")
    assert sorted(r["node"] for r in quality.cycles(pairs).collect()) == [*range(40), 200]
    assert quality.cycles(pairs.filter("child > 100 and child < 200")).isEmpty() and quality.cycles(pairs.limit(0)).isEmpty()
    nodes = spark.createDataFrame([(i,) for i in [*range(40), *range(100, 116), 200]], "node int")
    level = {r["node"]: r["level"] for r in graphs.first_level(pairs, nodes).collect()}
    assert level[115] == 0 and level[101] == 14 and level[100] is None and level[0] is None and level[200] == 0


def test_no_shared_folder(spark):
    class Far:
        class sparkContext:
            master = "spark://far:7077"

            class getConf:
                def get(self, key):
                    return None

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        tables.shared_folder(Far)


def test_dialect_statements_run(spark):
    c = duckdb.connect()
    for what in ("schemas", "tables", "columns", "keys"):
        c.execute(jdbc.dialect("postgresql").ask(what))
    assert serving.routed(spark.createDataFrame([("T",)], "table_name string"), spark.createDataFrame([], "table_name string, source string")).first()["source"] == ""
    assert tables.read(spark, SF, "region").count() == 5
