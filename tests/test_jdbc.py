"""Catalog statements of each engine, run against tables that look like the engine's catalog."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.sources import jdbc

WANT = {("orders", "fk_line", ("a", "b"), "lines", ("x", "y")), ("orders", "fk_self", ("parent",), "orders", ("id",))}


def references(rows):
    """(table, name, columns, referenced table, referenced columns) of statement rows."""
    by = {}
    for r in rows:
        by.setdefault((r["table_name"], r["name"], r["ref_table"]), []).append((r["position"], r["column_name"], r["ref_column"]))
    return {(t, n, tuple(c for _, c, _ in sorted(p)), u, tuple(d for _, _, d in sorted(p))) for (t, n, u), p in by.items()}


def run(c, sql):
    got = c.execute(sql)
    names = [d[0].lower() for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def fill(c, table, columns, rows):
    c.execute(f"CREATE TABLE {table} ({columns})")
    for r in rows:
        c.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(r))})", r)


def ansi(c):
    c.execute("CREATE SCHEMA info")
    fill(c, "info.referential_constraints", "constraint_schema VARCHAR, constraint_name VARCHAR, unique_constraint_schema VARCHAR, unique_constraint_name VARCHAR", [("s", "fk_line", "s", "pk_lines"), ("s", "fk_self", "s", "pk_orders")])
    use = [("s", "fk_line", "s", "orders", "a", 1, 1), ("s", "fk_line", "s", "orders", "b", 2, 2), ("s", "fk_self", "s", "orders", "parent", 1, 1), ("s", "pk_lines", "s", "lines", "x", 1, None), ("s", "pk_lines", "s", "lines", "y", 2, None), ("s", "pk_orders", "s", "orders", "id", 1, None)]
    fill(c, "info.key_column_usage", "constraint_schema VARCHAR, constraint_name VARCHAR, table_schema VARCHAR, table_name VARCHAR, column_name VARCHAR, ordinal_position INT, position_in_unique_constraint INT", use)
    fill(c, "info.table_constraints", "constraint_schema VARCHAR, constraint_name VARCHAR, table_name VARCHAR, constraint_type VARCHAR", [("s", "pk_lines", "lines", "PRIMARY KEY"), ("s", "pk_orders", "orders", "PRIMARY KEY"), ("s", "fk_line", "orders", "FOREIGN KEY")])


def mysql(c):
    c.execute("CREATE SCHEMA info")
    use = [("s", "orders", "fk_line", "a", 1, "lines", "x"), ("s", "orders", "fk_line", "b", 2, "lines", "y"), ("s", "orders", "fk_self", "parent", 1, "orders", "id"), ("s", "lines", "PRIMARY", "x", 1, None, None), ("s", "lines", "PRIMARY", "y", 2, None, None), ("s", "orders", "PRIMARY", "id", 1, None, None)]
    fill(c, "info.key_column_usage", "table_schema VARCHAR, table_name VARCHAR, constraint_name VARCHAR, column_name VARCHAR, ordinal_position INT, referenced_table_name VARCHAR, referenced_column_name VARCHAR", use)


def redshift(c):
    c.execute("CREATE SCHEMA info")
    fill(c, "info.pg_namespace", "oid INT, nspname VARCHAR", [(1, "s")])
    fill(c, "info.pg_class", "oid INT, relnamespace INT, relname VARCHAR", [(10, 1, "orders"), (20, 1, "lines")])
    fill(c, "info.pg_attribute", "attrelid INT, attnum INT, attname VARCHAR", [(10, 1, "id"), (10, 2, "b"), (10, 3, "a"), (10, 4, "parent"), (20, 1, "y"), (20, 2, "x")])
    fill(c, "info.pg_constraint", "conname VARCHAR, contype VARCHAR, conrelid INT, confrelid INT, conkey INT[], confkey INT[]", [("fk_line", "f", 10, 20, [3, 2], [2, 1]), ("fk_self", "f", 10, 10, [4], [1]), ("pk_lines", "p", 20, 0, [2, 1], None), ("pk_orders", "p", 10, 0, [1], None)])


def oracle(c):
    fill(c, "all_constraints", "owner VARCHAR, constraint_name VARCHAR, constraint_type VARCHAR, r_owner VARCHAR, r_constraint_name VARCHAR", [("s", "fk_line", "R", "s", "pk_lines"), ("s", "fk_self", "R", "s", "pk_orders"), ("s", "pk_lines", "P", None, None), ("s", "pk_orders", "P", None, None)])
    fill(c, "all_cons_columns", "owner VARCHAR, constraint_name VARCHAR, table_name VARCHAR, column_name VARCHAR, position INT", [("s", "fk_line", "orders", "a", 1), ("s", "fk_line", "orders", "b", 2), ("s", "fk_self", "orders", "parent", 1), ("s", "pk_lines", "lines", "x", 1), ("s", "pk_lines", "lines", "y", 2), ("s", "pk_orders", "orders", "id", 1)])
    fill(c, "all_tab_columns", "owner VARCHAR, table_name VARCHAR, column_name VARCHAR, data_type VARCHAR, nullable VARCHAR, column_id INT", [("s", "orders", "id", "NUMBER", "N", 1)])
    fill(c, "all_tables", "owner VARCHAR, table_name VARCHAR", [("s", "orders")])
    fill(c, "all_views", "owner VARCHAR, view_name VARCHAR", [("s", "v")])
    fill(c, "all_users", "username VARCHAR", [("s",), ("SYS",)])


def sqlserver(c):
    c.execute("CREATE SCHEMA sys")
    c.execute("CREATE MACRO OBJECT_NAME(i) AS CASE i WHEN 1 THEN 'fk_line' ELSE 'fk_self' END")
    fill(c, "sys.schemas", "schema_id INT, name VARCHAR", [(1, "s")])
    fill(c, "sys.tables", "object_id INT, schema_id INT, name VARCHAR", [(10, 1, "orders"), (20, 1, "lines")])
    fill(c, "sys.columns", "object_id INT, column_id INT, name VARCHAR", [(10, 1, "id"), (10, 2, "b"), (10, 3, "a"), (10, 4, "parent"), (20, 1, "y"), (20, 2, "x")])
    fill(c, "sys.foreign_key_columns", "constraint_object_id INT, constraint_column_id INT, parent_object_id INT, parent_column_id INT, referenced_object_id INT, referenced_column_id INT", [(1, 1, 10, 3, 20, 2), (1, 2, 10, 2, 20, 1), (2, 1, 10, 4, 10, 1)])
    fill(c, "sys.key_constraints", "type VARCHAR, parent_object_id INT, unique_index_id INT", [("PK", 20, 1), ("PK", 10, 1)])
    fill(c, "sys.index_columns", "object_id INT, index_id INT, key_ordinal INT, column_id INT", [(20, 1, 1, 2), (20, 1, 2, 1), (10, 1, 1, 1)])


@pytest.mark.parametrize("engine, make", [("postgresql", ansi), ("redshift", redshift), ("mysql", mysql), ("sqlserver", sqlserver), ("oracle", oracle)])
def test_keys_and_references(spark, engine, make):
    c = duckdb.connect()
    make(c)
    d = jdbc.dialect(engine)
    own = lambda what: d.ask(what, "s").replace("information_schema.", "info.").replace("pg_catalog.", "info.")
    got = run(c, own("references"))
    assert references(got) == WANT and len(got) == 3
    keys = run(c, own("keys"))
    assert sorted((r["table_name"], r["position"], r["column_name"]) for r in keys) == [("lines", 1, "x"), ("lines", 2, "y"), ("orders", 1, "id")]
    frames = [spark.createDataFrame([{k: r[k] for k in (x.split(" ")[0] for x in jdbc.CATALOG[w].split(", "))} for r in rows], jdbc.CATALOG[w]) for w, rows in (("keys", keys), ("references", got))]
    by = {r["table_name"]: r for r in jdbc.by_table(*[jdbc.shaped(f, w, d) for f, w in zip(frames, ("keys", "references"), strict=True)]).collect()}
    assert by["lines"]["primary_key"] == ["x", "y"] and by["lines"]["foreign_keys"] is None
    assert [(f["columns"], f["ref_table"], f["ref_columns"]) for f in by["orders"]["foreign_keys"]] == [(["a", "b"], "lines", ["x", "y"]), (["parent"], "orders", ["id"])]


def test_lists(spark):
    c = duckdb.connect()
    c.execute("CREATE SCHEMA shop; CREATE TABLE shop.orders (id INT NOT NULL, note VARCHAR); CREATE VIEW shop.v AS SELECT 1 AS x; CREATE TABLE shop.\"it's\" (x INT)")
    d = jdbc.dialect("postgresql")
    assert "shop" in {r["table_schema"] for r in run(c, d.ask("schemas"))}
    assert {(r["table_name"], r["kind"]) for r in run(c, d.ask("tables", "shop"))} == {("orders", "table"), ("v", "view"), ("it's", "table")}
    assert sorted((r["position"], r["column_name"], r["nullable"]) for r in run(c, d.ask("columns", "shop")) if r["table_name"] == "orders") == [(1, "id", 0), (2, "note", 1)]
    assert run(c, d.ask("tables", "x' OR '1' = '1")) == []
    o = duckdb.connect()
    oracle(o)
    d = jdbc.dialect("ORACLE")
    assert {(r["table_name"], r["kind"]) for r in run(o, d.ask("tables", "s"))} == {("orders", "table"), ("v", "view")}
    users = spark.createDataFrame(run(o, d.ask("schemas")), "table_schema string")
    assert [r[0] for r in jdbc.shaped(users, "schemas", d).collect()] == ["s"]
    assert run(o, d.ask("columns", "s"))[0]["nullable"] == 0
    assert all(d.ask("columns") for d in jdbc.DIALECTS.values()) and jdbc.dialect("snowflake").ask("keys") is None
    assert not any("information_schema" in q for q in jdbc.ORACLE.values())


@pytest.mark.parametrize("engine", sorted(jdbc.DIALECTS))
def test_names_and_limits(engine):
    d = jdbc.dialect(engine.upper())
    assert d.system and d.address("h", "db", 9).count("9") >= 1
    one = {"sqlserver": "[a].[b]]c]", "mysql": "`a`.`b]c`"}.get(engine, '"a"."b]c"')
    assert d.quoted("a", "b]c") == one
    sql = d.distinct_values("s", "t", "c", 25)
    assert ("TOP (25)" in sql) == (engine == "sqlserver") and ("FETCH FIRST 25" in sql) == (engine == "oracle") and "IS NOT NULL" in sql
    assert "LIMIT 7" in d.limited("SELECT 1", 7) or engine in ("sqlserver", "oracle")


def test_no_such_engine(spark):
    assert jdbc.dialect(None) is None and jdbc.dialect("") is None
    with pytest.raises(ValueError):
        jdbc.JdbcSource(spark, "db3", "h", "d", "u", "p")
    s = jdbc.JdbcSource(spark, "snowflake", "h", "d", "u", "p")
    assert s.discover("references").count() == 0 and s.discover("references").columns == [x.split(" ")[0] for x in jdbc.CATALOG["references"].split(", ")]
    assert s.discover("keys").filter(F.lit(True)).isEmpty()
