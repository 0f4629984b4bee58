"""Vectors as array<float> columns: cosine, exact filtered top-k, joins of small query sets, hybrid scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def top_k(rows: DataFrame, vector: list[float], k: int, column: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one vector among those the filter lets through; a bounded heap per task, no full sort."""
    rows = rows if where is None else rows.filter(where)
    query = F.array(*[F.lit(float(v)) for v in vector])
    return rows.withColumn("score", cosine(F.col(column), query)).orderBy(F.desc("score"), key).limit(k)


def top_k_join(rows: DataFrame, queries: DataFrame, k: int, column: str = "embedding", key: str = "vec_id", by: str | None = None, at_once: int = 4096) -> DataFrame:
    """For each of a stated set of queries(query_id, query) the k nearest rows (of each group, if named), with their place.

    Queries are sent to every task in blocks of about at_once. A task multiplies its rows with them batch by batch and
    keeps k rows for each query (and group); only these are shuffled. Cosines equal to twelve digits are ties.
    """
    spark = rows.sparkSession
    blocks = max(1, math.ceil(queries.count() / at_once))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [key, *([by] if by else [])]}
    own = rows.select(*kinds, F.col(column).cast("array<double>").alias("_v"))
    schema = ", ".join(["_q int", *(f"{c} {t}" for c, t in kinds.items()), "score double"])
    found = None
    for block in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", F.col("query").cast("array<double>").alias("query")).collect()
        sent = spark.sparkContext.broadcast(_unit(np.array([r["query"] for r in got], float)) if got else np.zeros((0, 0)))
        best = own.mapInArrow(_nearest(sent, k, key, by), schema)
        ids = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(got)], f"_q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        part = best.join(ids, "_q").drop("_q")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), F.col(key))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _nearest(sent, k: int, key: str, by: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, kept, kinds = sent.value, {}, {}
        for b in batches:
            kinds = {f.name: f.type for f in b.schema}
            if not b.num_rows or not len(unit):
                continue
            v = b.column("_v")
            score = np.round(unit @ _unit(np.asarray(v.flatten()).reshape(b.num_rows, -1)).T, 12)
            keys = b.column(key).to_numpy(zero_copy_only=False)
            groups = b.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(b.num_rows, int)
            for g in set(groups.tolist()):
                at = np.flatnonzero(groups == g)
                old_score, old_key = kept.get(g, (np.zeros((len(unit), 0)), np.zeros((len(unit), 0), keys.dtype)))
                all_score = np.concatenate([old_score, score[:, at]], axis=1)
                all_key = np.concatenate([old_key, np.broadcast_to(keys[at], (len(unit), len(at)))], axis=1)
                top = np.lexsort((all_key, -all_score), axis=1)[:, :k]
                kept[g] = np.take_along_axis(all_score, top, 1), np.take_along_axis(all_key, top, 1)
        for g, (score, keys) in kept.items():
            q = np.repeat(np.arange(len(score), dtype=np.int32), score.shape[1])
            columns = [pa.array(q), pa.array(keys.ravel(), kinds[key]), *([pa.array([g] * len(q), kinds[by])] if by else []), pa.array(score.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["_q", key, *([by] if by else []), "score"])

    return run


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of the documents that have any of a few terms; two aggregates, no token table is kept."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = docs.select(key, F.filter(F.split(low, r"[^a-z0-9]+"), lambda w: w != "").alias("t"), *[F.instr(low, term).alias(f"in{i}") for i, term in enumerate(terms)])
    # only a text that holds the letters of a term is looked through for it
    times = lambda i, term: F.when(F.col(f"in{i}") > 0, F.size(F.filter("t", lambda w: w == term))).otherwise(0)
    counts = tokens.select(key, F.size("t").alias("dl"), *[times(i, term).alias(f"tf{i}") for i, term in enumerate(terms)])
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    rows = counts.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select(key, score.alias("bm25")).filter("bm25 > 0")


def weighted_fusion(parts: list[tuple[DataFrame, float]], key: str = "id", score: str = "score") -> DataFrame:
    """Sum of weighted scores by key over several retrievers' results."""
    out = None
    for df, weight in parts:
        part = df.select(key, (F.col(score) * F.lit(weight)).alias("_s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("_s").alias(score))
