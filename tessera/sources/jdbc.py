"""JDBC sources: a dialect per engine with its own catalog statements, and reads in parallel ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest time a statement may take, in seconds.
TIMEOUT = 300
#: What the catalog statements return.
CATALOG = {
    "schemas": "table_schema string",
    "tables": "table_schema string, table_name string, kind string",
    "columns": "table_schema string, table_name string, column_name string, data_type string, nullable boolean, position int",
    "keys": "table_schema string, table_name string, column_name string, position int",
    "references": "table_schema string, table_name string, name string, column_name string, position int, ref_table string, ref_column string",
    "comments": "table_schema string, table_name string, column_name string, note string",
}

# Statements over the ANSI information schema. Foreign keys are paired by position, so that composite keys don't cross.
ANSI = {
    "schemas": "SELECT schema_name AS table_schema FROM information_schema.schemata",
    "tables": "SELECT table_schema, table_name, CASE table_type WHEN 'VIEW' THEN 'view' ELSE 'table' END AS kind FROM information_schema.tables WHERE table_type IN ('BASE TABLE', 'VIEW')",
    "columns": "SELECT table_schema, table_name, column_name, data_type, CASE is_nullable WHEN 'YES' THEN 1 ELSE 0 END AS nullable, ordinal_position AS position FROM information_schema.columns",
    "keys": "SELECT k.table_schema, k.table_name, k.column_name, k.ordinal_position AS position FROM information_schema.table_constraints c"
    " JOIN information_schema.key_column_usage k ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name"
    " WHERE c.constraint_type = 'PRIMARY KEY'",
    "references": "SELECT k.table_schema, k.table_name, r.constraint_name AS name, k.column_name, k.ordinal_position AS position, u.table_name AS ref_table, u.column_name AS ref_column FROM information_schema.referential_constraints r"
    " JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name"
    " JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint",
}
_PG_COMMENTS = (
    "SELECT n.nspname AS table_schema, c.relname AS table_name, a.attname AS column_name, d.description AS note FROM pg_catalog.pg_description d"
    " JOIN pg_catalog.pg_class c ON c.oid = d.objoid JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace"
    " LEFT JOIN pg_catalog.pg_attribute a ON a.attrelid = c.oid AND a.attnum = d.objsubid AND d.objsubid > 0"
)
_PLACES = " UNION ALL ".join(f"SELECT {k} AS place" for k in range(1, 17))
# No position_in_unique_constraint here: the key's column numbers are arrays, read place by place.
REDSHIFT = ANSI | {
    "schemas": "SELECT nspname AS table_schema FROM pg_catalog.pg_namespace",
    "keys": "SELECT n.nspname AS table_schema, t.relname AS table_name, a.attname AS column_name, p.place AS position FROM pg_catalog.pg_constraint k"
    f" JOIN pg_catalog.pg_class t ON t.oid = k.conrelid JOIN pg_catalog.pg_namespace n ON n.oid = t.relnamespace JOIN ({_PLACES}) p ON true"
    " JOIN pg_catalog.pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = k.conkey[p.place] WHERE k.contype = 'p'",
    "references": "SELECT n.nspname AS table_schema, t.relname AS table_name, k.conname AS name, a.attname AS column_name, p.place AS position, r.relname AS ref_table, b.attname AS ref_column FROM pg_catalog.pg_constraint k"
    f" JOIN pg_catalog.pg_class t ON t.oid = k.conrelid JOIN pg_catalog.pg_namespace n ON n.oid = t.relnamespace JOIN pg_catalog.pg_class r ON r.oid = k.confrelid JOIN ({_PLACES}) p ON true"
    " JOIN pg_catalog.pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = k.conkey[p.place] JOIN pg_catalog.pg_attribute b ON b.attrelid = k.confrelid AND b.attnum = k.confkey[p.place] WHERE k.contype = 'f'",
    "comments": _PG_COMMENTS,
}
# Every primary key is called PRIMARY, so a reference's target is taken from its own row.
MYSQL = ANSI | {
    "keys": "SELECT table_schema, table_name, column_name, ordinal_position AS position FROM information_schema.key_column_usage WHERE constraint_name = 'PRIMARY'",
    "references": "SELECT table_schema, table_name, constraint_name AS name, column_name, ordinal_position AS position, referenced_table_name AS ref_table, referenced_column_name AS ref_column FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL",
    "comments": "SELECT table_schema, table_name, NULL AS column_name, table_comment AS note FROM information_schema.tables WHERE table_comment <> ''"
    " UNION ALL SELECT table_schema, table_name, column_name, column_comment FROM information_schema.columns WHERE column_comment <> ''",
}
SQLSERVER = ANSI | {
    "keys": "SELECT s.name AS table_schema, t.name AS table_name, c.name AS column_name, CAST(x.key_ordinal AS int) AS position FROM sys.key_constraints k"
    " JOIN sys.tables t ON t.object_id = k.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id"
    " JOIN sys.index_columns x ON x.object_id = k.parent_object_id AND x.index_id = k.unique_index_id JOIN sys.columns c ON c.object_id = x.object_id AND c.column_id = x.column_id WHERE k.type = 'PK'",
    "references": "SELECT s.name AS table_schema, t.name AS table_name, OBJECT_NAME(k.constraint_object_id) AS name, c.name AS column_name, k.constraint_column_id AS position, r.name AS ref_table, d.name AS ref_column FROM sys.foreign_key_columns k"
    " JOIN sys.tables t ON t.object_id = k.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.columns c ON c.object_id = k.parent_object_id AND c.column_id = k.parent_column_id"
    " JOIN sys.tables r ON r.object_id = k.referenced_object_id JOIN sys.columns d ON d.object_id = k.referenced_object_id AND d.column_id = k.referenced_column_id",
    "comments": "SELECT s.name AS table_schema, t.name AS table_name, c.name AS column_name, CAST(e.value AS nvarchar(4000)) AS note FROM sys.extended_properties e"
    " JOIN sys.tables t ON t.object_id = e.major_id JOIN sys.schemas s ON s.schema_id = t.schema_id"
    " LEFT JOIN sys.columns c ON c.object_id = e.major_id AND c.column_id = e.minor_id AND e.minor_id > 0 WHERE e.name = 'MS_Description'",
}
# Keys aren't exposed to queries here.
SNOWFLAKE = {k: v for k, v in ANSI.items() if k not in ("keys", "references")} | {
    "comments": "SELECT table_schema, table_name, NULL AS column_name, comment AS note FROM information_schema.tables WHERE comment <> ''"
    " UNION ALL SELECT table_schema, table_name, column_name, comment FROM information_schema.columns WHERE comment <> ''",
}
# No information schema: the owner's catalog views.
ORACLE = {
    "schemas": "SELECT username AS table_schema FROM all_users",
    "tables": "SELECT owner AS table_schema, table_name, 'table' AS kind FROM all_tables UNION ALL SELECT owner, view_name, 'view' FROM all_views",
    "columns": "SELECT owner AS table_schema, table_name, column_name, data_type, CASE nullable WHEN 'Y' THEN 1 ELSE 0 END AS nullable, column_id AS position FROM all_tab_columns",
    "keys": "SELECT c.owner AS table_schema, k.table_name, k.column_name, k.position FROM all_constraints c"
    " JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name WHERE c.constraint_type = 'P'",
    "references": "SELECT c.owner AS table_schema, k.table_name, c.constraint_name AS name, k.column_name, k.position, r.table_name AS ref_table, r.column_name AS ref_column FROM all_constraints c"
    " JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name"
    " JOIN all_cons_columns r ON r.owner = c.r_owner AND r.constraint_name = c.r_constraint_name AND r.position = k.position WHERE c.constraint_type = 'R'",
    "comments": "SELECT owner AS table_schema, table_name, NULL AS column_name, comments AS note FROM all_tab_comments WHERE comments IS NOT NULL"
    " UNION ALL SELECT owner, table_name, column_name, comments FROM all_col_comments WHERE comments IS NOT NULL",
}


@dataclass(frozen=True)
class Dialect:
    """How one engine is reached and asked."""

    name: str
    driver: str
    url: str
    port: int
    #: A pattern of the schemas that are the engine's own.
    system: str
    quote: str = '"'
    limit: str = "SELECT * FROM ({sql}) t LIMIT {n}"
    distinct: str = "SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL LIMIT {n}"
    session: str = ""
    catalog: dict[str, str] = field(default_factory=lambda: dict(ANSI))

    def quoted(self, *names: str) -> str:
        """Names of a path, each quoted."""
        start, end = ("[", "]") if self.quote == "[" else (self.quote, self.quote)
        return ".".join(start + n.replace(end, end * 2) + end for n in names)

    def limited(self, sql: str, n: int) -> str:
        return self.limit.format(sql=sql, n=int(n))

    def distinct_values(self, schema: str, table: str, column: str, n: int) -> str:
        """At most n different values of a column."""
        return self.distinct.format(column=self.quoted(column), table=self.quoted(schema, table), n=int(n))

    def address(self, host: str, database: str, port: int | None = None) -> str:
        return self.url.format(host=host, port=port or self.port, database=database)

    def ask(self, what: str, schema: str | None = None) -> str | None:
        """The statement that lists schemas, tables, columns, keys, references or comments, of one schema if it is named;
        None if the engine can't tell."""
        sql = self.catalog.get(what)
        if sql is None or schema is None:
            return sql
        name = schema.replace("'", "''")
        return f"SELECT * FROM ({sql}) s WHERE table_schema = '{name}'"


DIALECTS = {
    d.name: d
    for d in (
        Dialect("postgresql", "org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432, r"pg_catalog|pg_toast.*|information_schema", session="SET default_transaction_read_only = on", catalog=ANSI | {"comments": _PG_COMMENTS}),
        Dialect("redshift", "com.amazon.redshift.jdbc.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439, r"pg_.*|information_schema|catalog_history", catalog=REDSHIFT),
        Dialect("mysql", "com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306, r"information_schema|mysql|performance_schema|sys", quote="`", session="SET SESSION TRANSACTION READ ONLY", catalog=MYSQL),
        Dialect("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, r"sys|INFORMATION_SCHEMA|guest|db_.*", quote="[", limit="SELECT TOP ({n}) * FROM ({sql}) t", distinct="SELECT DISTINCT TOP ({n}) {column} FROM {table} WHERE {column} IS NOT NULL", catalog=SQLSERVER),
        Dialect("snowflake", "net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}:{port}/?db={database}", 443, r"INFORMATION_SCHEMA", catalog=SNOWFLAKE),
        Dialect(
            "oracle", "oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521,
            r"SYS|SYSTEM|OUTLN|XDB|CTXSYS|MDSYS|DBSNMP|APPQOSSYS|ORDSYS|ORDDATA|WMSYS|LBACSYS|DVSYS|AUDSYS|GSMADMIN_INTERNAL|OJVMSYS|DBSFWUSER",
            limit="SELECT * FROM ({sql}) FETCH FIRST {n} ROWS ONLY", distinct="SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL FETCH FIRST {n} ROWS ONLY", catalog=ORACLE,
        ),
    )
}
_ALIASES = {"postgres": "postgresql", "aurora-postgresql": "postgresql", "mariadb": "mysql", "aurora-mysql": "mysql", "mssql": "sqlserver"}


def dialect(engine: str | None) -> Dialect | None:
    """The dialect of an engine's name, ignoring case; None if there is none."""
    key = (engine or "").strip().lower()
    return DIALECTS.get(_ALIASES.get(key, key))


class JdbcSource:
    """A database behind JDBC. Its driver's jar must be on Spark's class path."""

    def __init__(self, spark: SparkSession, engine: str, host: str, database: str, user: str, password: str, port: int | None = None):
        found = dialect(engine)
        if found is None:
            raise ValueError(f"no dialect for {engine}")
        self.spark, self.dialect = spark, found
        self.options = {"url": found.address(host, database, port), "driver": found.driver, "user": user, "password": password, "queryTimeout": str(TIMEOUT)}
        if found.session:
            self.options["sessionInitStatement"] = found.session

    def query(self, sql: str, max_rows: int | None = None) -> DataFrame:
        """Rows of a statement; it runs in the database as a subquery."""
        return self.spark.read.format("jdbc").options(**self.options).option("query", self.dialect.limited(sql, max_rows) if max_rows else sql).load()

    def table(self, schema: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        """A table, in `parts` ranges of a numeric key; filters and columns are pushed down."""
        reader = self.spark.read.format("jdbc").options(**self.options).option("dbtable", self.dialect.quoted(schema, name)).option("fetchsize", "10000")
        if key:
            reader = reader.option("partitionColumn", self.dialect.quoted(key)).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
        return reader.load()

    def discover(self, what: str, schema: str | None = None) -> DataFrame:
        """Schemas, tables, columns, keys, references or comments (see CATALOG), the engine's own schemas left out.

        What the engine doesn't tell is empty.
        """
        sql = self.dialect.ask(what, schema)
        if sql is None:
            return self.spark.createDataFrame([], CATALOG[what])
        return shaped(self.query(sql), what, self.dialect)


def shaped(rows: DataFrame, what: str, found: Dialect) -> DataFrame:
    """Catalog rows with the names and types of CATALOG (engines differ in both), without the engine's own schemas."""
    wanted = [c.split(" ") for c in CATALOG[what].split(", ")]
    rows = rows.toDF(*[c.lower() for c in rows.columns]).select(*[F.col(c).cast(t).alias(c) for c, t in wanted])
    return rows.filter(~F.col("table_schema").rlike(f"^({found.system})$"))


def by_table(keys: DataFrame, references: DataFrame) -> DataFrame:
    """(table_schema, table_name, primary_key, foreign_keys): columns in order, references as (columns, table, columns).

    A composite reference is one entry, its columns paired in order.
    """
    own = ["table_schema", "table_name"]
    pk = keys.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("position", "column_name"))).alias("k"))
    pk = pk.select(*own, F.transform("k", lambda x: x["column_name"]).alias("primary_key"))
    one = references.groupBy(*own, "name", "ref_table").agg(F.sort_array(F.collect_list(F.struct("position", "column_name", "ref_column"))).alias("p"))
    one = one.select(*own, F.struct(F.transform("p", lambda x: x["column_name"]).alias("columns"), F.col("ref_table"), F.transform("p", lambda x: x["ref_column"]).alias("ref_columns")).alias("f"))
    return pk.join(one.groupBy(*own).agg(F.sort_array(F.collect_list("f")).alias("foreign_keys")), own, "full")
