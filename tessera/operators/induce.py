"""Deriving classes and properties from extracted facts, and the statistics that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import literal_type, normal_predicate

#: A class needs so many instances; a sample has at least K_MIN of them.
FLOOR, K_MIN = 3, 5


def classes(instances: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(class, n) of the classes with at least `floor` instances."""
    return instances.groupBy("class").agg(F.count("*").alias("n")).filter(F.col("n") >= floor)


def relations(edges: DataFrame, least: int = 1) -> DataFrame:
    """(domain, predicate, range, freq): predicates in normal form, empty ones dropped, counts added."""
    e = edges.withColumn("predicate", normal_predicate(F.col("predicate"))).filter("predicate <> ''")
    return e.groupBy("domain", "predicate", "range").agg(F.sum("count").alias("freq")).filter(F.col("freq") >= least)


def class_contexts(edges: DataFrame) -> DataFrame:
    """(class, outgoing, incoming): sums of counts; a loop counts in both."""
    out = edges.select(F.col("domain").alias("class"), F.col("count").alias("o"), F.lit(0).cast("long").alias("i"))
    into = edges.select(F.col("range").alias("class"), F.lit(0).cast("long").alias("o"), F.col("count").alias("i"))
    return out.unionByName(into).groupBy("class").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def _label(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent spelling of each key, the smallest of equals."""
    n = facts.groupBy(*keys, "predicate").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "predicate")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, F.col("predicate").alias("label"))


def object_properties(facts: DataFrame) -> DataFrame:
    """(domain, name, label, ranges) of facts(subject_class, predicate, object_class) that have an object."""
    f = facts.filter("object_class is not null").select(F.col("subject_class").alias("domain"), normal_predicate(F.col("predicate")).alias("name"), "predicate", "object_class").filter("name <> ''")
    ranges = f.groupBy("domain", "name").agg(F.array_sort(F.collect_set("object_class")).alias("ranges"))
    return ranges.join(_label(f, ["domain", "name"]), ["domain", "name"]).select("domain", "name", "label", F.array_join("ranges", ",").alias("ranges"))


def datatype_properties(facts: DataFrame) -> DataFrame:
    """(domain, name, label, datatype) of facts(subject_class, predicate, complement) that have a literal.

    The type all values that aren't blank agree on, else string.
    """
    f = facts.filter("complement is not null").select(F.col("subject_class").alias("domain"), normal_predicate(F.col("predicate")).alias("name"), "predicate", "complement").filter("name <> ''")
    kind = F.when(F.trim("complement") != "", literal_type(F.col("complement")))
    types = f.groupBy("domain", "name").agg(F.count_distinct(kind).alias("kinds"), F.min(kind).alias("kind"))
    types = types.select("domain", "name", F.when(F.col("kinds") == 1, F.col("kind")).otherwise("string").alias("datatype"))
    return types.join(_label(f, ["domain", "name"]), ["domain", "name"]).select("domain", "name", "label", "datatype")


def stratified_sample(rows: DataFrame, stratum: str, key: str, k_min: int = K_MIN, floor: int = FLOOR) -> DataFrame:
    """max(k_min, ceil(sqrt n)) rows of each stratum with at least `floor`; which ones is decided by a hash of the key."""
    w = Window.partitionBy(stratum)
    order = F.md5(F.col(key).cast("string"))
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order, key)))
    return ranked.filter((F.col("_n") >= floor) & (F.col("_r") <= F.greatest(F.lit(k_min), F.ceil(F.sqrt("_n"))))).drop("_n", "_r")


def unique_names(rows: DataFrame, base: str, identity: str) -> DataFrame:
    """Adds `name`: the smallest identity of those with one base keeps it, the others get 8 hex digits behind it."""
    w = Window.partitionBy(base).orderBy(identity)
    return rows.withColumn("_r", F.row_number().over(w)).withColumn("name", F.when(F.col("_r") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.substring(F.sha2(F.col(identity), 256), 1, 8)))).drop("_r")


def protected_upsert(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored references and the candidates that neither a protected one on their column nor an equal one forbids."""
    fresh = candidates.join(stored.filter("protected").select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    fresh = fresh.join(stored.select("table_name", "column_name", "ref_table", "ref_column"), ["table_name", "column_name", "ref_table", "ref_column"], "left_anti")
    return stored.unionByName(fresh)


def budget_trim(items: DataFrame, kind: str, order: str, cost: str, budget: int, at_least_one: tuple[str, ...] = ("class", "metric"), untouched: tuple[str, ...] = ("glossary",)) -> DataFrame:
    """Each kind's list, in order, cut to the share of the budget that the whole costs."""
    total = items.agg(F.sum(cost).alias("_total"))
    w = Window.partitionBy(kind)
    ranked = items.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order))).crossJoin(F.broadcast(total))  # one row
    ratio = F.least(F.lit(1.0), F.lit(float(budget)) / F.col("_total"))
    least = F.when(F.col(kind).isin(*at_least_one), 1).otherwise(0)
    keep = F.col(kind).isin(*untouched) | (F.col("_r") <= F.greatest(F.floor(F.col("_n") * ratio), least))
    return ranked.filter(keep).drop("_n", "_r", "_total")


def calibrated(confidence: Column, rows: Column) -> Column:
    """Halved without rows, and kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(rows == 0, confidence * 0.5).otherwise(confidence)))
