"""One entry for SQL: register the tables, pass the gate, cap the rows, run on Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import sqlgate
from tessera.sources import tables

#: No statement returns more rows than this.
ROW_CAP = 10_000


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str, names=tables.TABLES):
        self.spark, self.sf_dir = spark, sf_dir
        tables.register(spark, sf_dir, names)

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)

    def sql(self, statement: str, profile: sqlgate.Profile | None = None, max_rows: int | None = ROW_CAP, args: dict | None = None) -> DataFrame:
        """The rows of a read-only statement, max_rows at most; named parameters (:name) are bound, never pasted."""
        if profile is None:
            sqlgate.validate(self.spark, statement)
        else:
            sqlgate.evaluate(self.spark, statement, profile, args)
        rows = self.spark.sql(statement, args=args or {})
        return rows if max_rows is None else rows.limit(min(max_rows, ROW_CAP))


def truncated(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """At most max_rows rows, and whether there were more."""
    rows = df.limit(max_rows + 1)
    return rows.limit(max_rows), rows.count() > max_rows
