"""What the SQL gate, the metric binding and the SPARQL compiler let through and what they refuse."""

import pytest

from tessera.engine import Engine
from tessera.operators import metrics, sqlgate
from tessera.operators.sparql import Compiler, Unsupported
from tessera.operators.sqlgate import Profile, Rejected
from tests.conftest import SF


@pytest.mark.parametrize("sql", [
    "SELECT 1", "SELECT * FROM (SELECT n_name FROM nation) t", "SELECT 1 UNION ALL SELECT 2", "SELECT 1 INTERSECT SELECT 1",
    "WITH a AS (SELECT 1 AS x) SELECT x FROM a", "SELECT 'DROP TABLE x; DELETE' AS t", "/* DROP */ SELECT 1 -- DELETE",
])
def test_reads_pass(spark, sql):
    Engine(spark, SF)
    sqlgate.validate(spark, sql)


@pytest.mark.parametrize("sql", [
    "INSERT INTO nation VALUES (1)", "DROP TABLE nation", "DELETE FROM nation", "CREATE TABLE x AS SELECT 1", "/* a */ DROP TABLE x",
    "SELECT 1; MSCK REPAIR TABLE t", "SELECT pg_sleep(5)", "SELECT * FROM (SELECT pg_read_file('x')) t", "EXPLAIN SELECT 1", "SET a = 1",
    "SELECT (SELECT dblink('x'))", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT 'unterminated; DROP TABLE x",
])
def test_others_are_refused(spark, sql):
    with pytest.raises(Rejected):
        sqlgate.validate(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT value FROM text.`{}/secret.customer`", "SELECT * FROM parquet.`{}/customer`", "SELECT 1 FROM secret_db.customer", "SELECT 1 FROM nowhere", "WITH a AS (SELECT * FROM csv.`{}/x`) SELECT 1 FROM a", "SELECT TRANSFORM(r_name) USING 'cat' AS x FROM region"])
def test_unknown_relations(spark, sql, tmp_path):
    (tmp_path / "secret.customer").write_text("a secret")
    Engine(spark, SF)
    for profile in (None, Profile(frozenset({"customer", "region"}))):
        with pytest.raises(Rejected):
            Engine(spark, SF).sql(sql.format(tmp_path), profile)


SEES = Profile(frozenset({"orders", "customer"}), {"customer": frozenset({"c_acctbal"})})


@pytest.mark.parametrize("sql", [
    "WITH x AS (SELECT o_orderkey FROM orders) SELECT * FROM x", "SELECT c.c_name FROM customer c", "SELECT count(*) FROM customer", "SELECT x.c_name AS c_acctbal FROM customer x",
    "WITH customer AS (SELECT o_orderkey AS c_acctbal FROM orders) SELECT c_acctbal FROM customer", "FROM customer |> SELECT c_name |> LIMIT 3", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY c_name LIMIT 5", "SELECT 1 AS c_acctbal", "SELECT c_name FROM customer a JOIN customer b USING (c_custkey, c_name)",
])
def test_allowed(spark, sql):
    Engine(spark, SF)
    sqlgate.evaluate(spark, sql, SEES)


@pytest.mark.parametrize("sql", [
    "SELECT * FROM nation", "SELECT * FROM customer", "SELECT c.* FROM customer c", "SELECT c_acctbal FROM customer c", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM part)",
    "SELECT c.C_ACCTBAL FROM customer c JOIN orders o ON 1 = 1", "TABLE customer", "FROM customer |> WHERE c_custkey = 1", "SELECT a.c_name FROM customer a JOIN customer b USING (c_acctbal)",
    "SELECT count(*) FROM customer a NATURAL JOIN customer b", "SELECT x FROM (SELECT c_acctbal AS x FROM customer)", "WITH t AS (TABLE customer) SELECT c_name FROM t", "SELECT c_name FROM customer ORDER BY c_acctbal",
    "SELECT c_name FROM customer GROUP BY c_name HAVING max(c_acctbal) > 0", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal > o.o_totalprice)", "(TABLE customer) INTERSECT (TABLE customer)",
    "SELECT rank() OVER (ORDER BY c_acctbal) FROM customer", "SELECT to_json(struct(*)) FROM customer", "WITH nation AS (SELECT 1 AS x) SELECT (SELECT max(r_name) FROM region) FROM nation", "WITH customer AS (SELECT * FROM customer) SELECT 1 FROM customer",
    "SELECT (SELECT max(c_acctbal) FROM customer)", "SELECT 1 FROM public.orders",
])
def test_kept_from(spark, sql):
    Engine(spark, SF)
    with pytest.raises(Rejected):
        sqlgate.evaluate(spark, sql, SEES)


def test_no_tables(spark):
    Engine(spark, SF)
    with pytest.raises(Rejected):
        sqlgate.evaluate(spark, "SELECT 1 FROM orders", Profile(frozenset()))
    sqlgate.evaluate(spark, "SELECT 1", Profile(frozenset()))


def test_limit_cap(spark):
    e = Engine(spark, SF)
    assert e.sql("SELECT * FROM lineitem", max_rows=7).count() == 7
    assert e.sql("SELECT 1 AS x UNION ALL SELECT 2", max_rows=1).count() == 1
    assert e.sql("SELECT * FROM (SELECT * FROM lineitem LIMIT 2000) t LIMIT 500", max_rows=10).count() == 10
    assert e.sql("SELECT 1 AS x LIMIT 5", max_rows=10).count() == 1
    assert [r[0] for r in e.sql("SELECT r_regionkey FROM region ORDER BY 1 OFFSET 3", max_rows=10).collect()] == [3, 4]
    assert [r[0] for r in e.sql("SELECT r_regionkey FROM region ORDER BY 1 DESC", max_rows=2).collect()] == [4, 3]


def test_grants():
    assert sqlgate.merge_grants([{"deny": ["a"]}, {"allow": ["t"], "deny": ["b"]}]) == (frozenset({"t"}), frozenset({"a", "b"}))
    assert sqlgate.merge_grants([{}])[0] is None


@pytest.mark.parametrize("given", [{"a": 1, "b": 2}, {}, {"x": 1}, [{"name": "a", "operator": ">", "value": 1}], {"a": float("nan")}, {"a": [1]}, [{"name": "a", "value": 1}, {"name": "A", "value": 2}]])
def test_bad_dimensions(given):
    with pytest.raises(metrics.BadDimension):
        metrics.bound("SELECT :a", given, {"a", "b"})


def test_bound_dimensions():
    sql, values = metrics.bound("SELECT x::int FROM t WHERE a = :a AND b = {b}", {"a": "it's", "B": 2}, {"a", "b"})
    assert sql == "SELECT x::int FROM t WHERE a = :a AND b = :b" and values == {"a": "it's", "b": 2}


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x a :Ghost }", "SELECT ?y WHERE { ?x a :Part . ?x :ghost ?y }", "SELECT ?n (COUNT(?p) AS ?c) WHERE { ?p a :Part ; :name ?n }", "SELECT ?z WHERE { ?p a :Part }", "SELECT ?a WHERE { ?a a :Part . ?b a :Nation }"])
def test_sparql_refuses(spark, text):
    with pytest.raises(Unsupported):
        Compiler(spark, SF).run(text)


def test_pushdown(spark):
    df = Compiler(spark, SF).run('SELECT ?n WHERE { ?c a :Customer ; :name ?n ; :acctbal ?b . FILTER(?b > 9000) }')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal" in plan and "c_mktsegment" not in plan
