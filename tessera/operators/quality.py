"""Data quality: required, unique, referenced, typed, positive and patterned columns; unknown names; cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graphs import cyclic


def profile(df: DataFrame, required=(), positive=(), patterns: dict[str, str] | None = None, castable: dict[str, str] | None = None) -> DataFrame:
    """(check_name, column_name, violations) of all row-wise checks, in one pass."""
    checks = [("required", c, F.col(c).isNull()) for c in required]
    checks += [("positive", c, F.col(c) <= 0) for c in positive]
    checks += [("pattern", c, F.col(c).isNotNull() & ~F.col(c).rlike(p)) for c, p in (patterns or {}).items()]
    checks += [("datatype", c, F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()) for c, t in (castable or {}).items()]
    one = df.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(f"_{i}") for i, (_, _, v) in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("violations")) for i, (k, c, _) in enumerate(checks)])).alias("x")).select("x.*")


def not_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that more than one row has, table-wide."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def many_valued(df: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects with more than one value."""
    return df.groupBy(subject).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def unreferenced(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but finds no parent."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def unknown(references: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Names, ignoring case, that a catalog doesn't have."""
    low = lambda d: d.select(*[F.lower(k).alias(k) for k in keys]).distinct()
    return low(references).join(low(known), keys, "left_anti")


def type_conflicts(filters: DataFrame, columns: DataFrame) -> DataFrame:
    """(column_name, operator): > < BETWEEN on what is no number or date, LIKE on what is no text or date."""
    from tessera.functions.names import type_family

    f = filters.join(columns.select("column_name", type_family(F.col("data_type")).alias("family")), "column_name")
    order = F.col("operator").isin(">", "<", ">=", "<=", "BETWEEN") & ~F.col("family").isin("int", "float", "decimal", "date", "timestamp")
    like = (F.col("operator") == "LIKE") & ~F.col("family").isin("string", "date", "timestamp")
    return f.filter(order | like).select("column_name", "operator")


def cycles(pairs: DataFrame) -> DataFrame:
    """(node) of pairs(child, parent): the nodes that are their own ancestor, at any distance."""
    return cyclic(pairs)
