"""Catalog discovery: tables, columns, keys, glob filters, enum profiles, fingerprints, re-scan differences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import type_family
from tessera.sources import tables

#: An enum has at most so many distinct values, and at least so many rows for each.
MAX_DISTINCT, ROWS_PER_VALUE = 25, 3


def split_globs(pattern: str) -> list[str]:
    """Globs of a list, split at | and , outside of [...]."""
    return [p.strip() for p in re.findall(r"(?:\[[^\]]*\]|[^|,\[]|\[)+", pattern) if p.strip()]


def glob_regex(pattern: str) -> str:
    """One regular expression for a list of globs; matches whole names."""

    def one(glob: str) -> str:
        out = ""
        for piece in re.findall(r"\[!?[^\]]*\]|.", glob):
            if piece == "*":
                out += ".*"
            elif piece == "?":
                out += "."
            elif piece.startswith("[") and piece.endswith("]") and len(piece) > 2:
                out += "[" + piece[1:-1].replace("!", "^", 1) + "]" if piece[1] == "!" else piece
            else:
                out += re.escape(piece)
        return out

    return "^(" + "|".join(one(g) for g in split_globs(pattern)) + ")$"


def matches(name: Column, include: str | None = None, exclude: str | None = None) -> Column:
    ok = name.rlike(glob_regex(include)) if include else F.lit(True)
    return ok & ~name.rlike(glob_regex(exclude)) if exclude else ok


def discover_columns(spark: SparkSession, sf_dir: str, names=tables.TABLES) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable) from the tables' schemas; no data is read."""
    rows = []
    for name in names:
        for i, f in enumerate(tables.read(spark, sf_dir, name).schema.fields, 1):
            rows.append((name, i, f.name, f.dataType.simpleString(), f.nullable))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def scan(spark: SparkSession, names=None) -> DataFrame:
    """(table_name, kind, position, column_name, data_type, is_partition) of the session's catalog, or of the tables named."""
    tables_ = [t for t in spark.catalog.listTables() if names is None or t.name in names]
    rows = [(t.name, t.tableType.lower(), i, c.name, c.dataType, c.isPartition) for t in tables_ for i, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table_name string, kind string, position int, column_name string, data_type string, is_partition boolean")


def constraints(spark: SparkSession) -> DataFrame:
    """(table_name, kind, position, column_name, ref_table, ref_column): keys and references, column by column."""
    rows = [(t, "PRIMARY KEY", i, c, None, None) for t, cs in tables.PRIMARY_KEYS.items() for i, c in enumerate(cs, 1)]
    rows += [(t, "FOREIGN KEY", 1, c, rt, rc) for t, c, rt, rc in tables.FOREIGN_KEYS]
    return spark.createDataFrame(rows, "table_name string, kind string, position int, column_name string, ref_table string, ref_column string")


def inferred_references(columns: DataFrame) -> DataFrame:
    """(src, rel, dst): columns named like another table's first column, but for the prefix before the first _."""
    suffix = F.regexp_extract("column_name", "^[^_]*_(.+key)$", 1)
    named = columns.select("table_name", "position", "column_name", suffix.alias("suffix")).filter("suffix <> ''")
    first = named.filter("position = 1").groupBy("suffix").agg(F.min_by("table_name", F.struct(F.length("table_name"), "table_name")).alias("dst"))
    # two tables may begin with the same key: the one that is named like it, or else the shorter name, owns it
    return named.join(first, "suffix").filter("table_name <> dst").select(F.col("table_name").alias("src"), F.col("column_name").alias("rel"), "dst")


def enum_profile(df: DataFrame, columns: list[str], max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(column_name, total, distinct_values, is_enum, looks_categorical) of text columns, in one pass over all of them.

    Nulls and empty texts count for nothing. A column is an enum with 1 to max_distinct values and three rows a value.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null and v <> ''")
    values = rows.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    words = F.size(F.split("v", r"\s+"))
    out = values.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"), F.avg(F.length("v")).alias("chars"), F.avg(words).alias("words"))
    enum = (F.col("distinct_values") <= max_distinct) & (F.col("total") >= ROWS_PER_VALUE * F.col("distinct_values"))
    return out.select("column_name", "total", "distinct_values", enum.alias("is_enum"), ((F.col("chars") <= 40) & (F.col("words") <= 3)).alias("looks_categorical"))


def enum_values(df: DataFrame, columns: list[str], max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(column_name, value) of the columns that enum_profile calls enums."""
    enums = enum_profile(df, columns, max_distinct).filter("is_enum").select("column_name")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return rows.filter("value is not null and value <> ''").distinct().join(enums, "column_name", "left_semi")


def fingerprints(columns: DataFrame) -> DataFrame:
    """(table_name, fingerprint): 16 hex digits over the sorted (column, type family) pairs."""
    pair = F.concat_ws(":", F.lower("column_name"), type_family(F.col("data_type")))
    return columns.groupBy("table_name").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ","), 256), 1, 16).alias("fingerprint"))


def rescan(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(table_name, action): insert, revise or unchanged, by name and fingerprint."""
    k = known.select("table_name", F.col("fingerprint").alias("old"))
    s = scanned.join(k, "table_name", "left")
    return s.select("table_name", F.when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("fingerprint"), "revise").otherwise("unchanged").alias("action"))


def upsert(stored: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """Scanned rows, and stored rows that were not scanned."""
    return scanned.unionByName(stored.join(scanned.select(key), key, "left_anti"))


def mapping_rows(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, class_name, column_name, property, kind, ref_table): what each column maps to.

    A referencing column is an object property with its target table, any other a datatype property.
    """
    from tessera.functions.names import camel_case, pascal_case

    fk = keys.filter("kind = 'FOREIGN KEY'").select("table_name", "column_name", "ref_table")
    c = columns.join(fk, ["table_name", "column_name"], "left")
    return c.select("table_name", pascal_case(F.col("table_name")).alias("class_name"), "column_name", camel_case(F.col("column_name")).alias("property"), F.when(F.col("ref_table").isNotNull(), "object").otherwise("datatype").alias("kind"), F.coalesce("ref_table", F.lit("")).alias("ref_table"))


def subtypes(keys: DataFrame) -> DataFrame:
    """(child, parent, status): a table whose only key column refers to the only key column of another; two children confirm."""
    pk = keys.filter("kind = 'PRIMARY KEY'").groupBy("table_name").agg(F.count("*").alias("n"), F.first("column_name").alias("key")).filter("n = 1")
    fk = keys.filter("kind = 'FOREIGN KEY'")
    child = fk.join(pk.select("table_name", F.col("key").alias("column_name")), ["table_name", "column_name"], "left_semi")
    parent = pk.select(F.col("table_name").alias("ref_table"), F.col("key").alias("ref_column"))
    pairs = child.join(parent, ["ref_table", "ref_column"], "left_semi").filter("table_name <> ref_table").select(F.col("table_name").alias("child"), F.col("ref_table").alias("parent"))
    count = pairs.groupBy("parent").agg(F.count("*").alias("n"))
    return pairs.join(count, "parent").select("child", "parent", F.when(F.col("n") >= 2, "confirmed").otherwise("suggested").alias("status"))
