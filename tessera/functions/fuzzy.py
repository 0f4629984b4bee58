"""What no built-in expresses: sequence similarity, Unicode normal forms, sequential clustering. Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
import uuid
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from tessera.sources.tables import shared_folder


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by their matching blocks; 0 if either is null."""
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _best_ratio(text: str, label: str) -> float:
    """Runs whose upper bounds don't exceed the best ratio so far are passed over."""
    words, n = text.lower().split(), len(label.split())
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] + [" ".join(words)]
    best, m = 0.0, difflib.SequenceMatcher(None, "", label.lower())
    for r in dict.fromkeys(runs):
        m.set_seq1(r)
        if m.real_quick_ratio() > best and m.quick_ratio() > best:
            best = max(best, m.ratio())
    return best


@pandas_udf(DoubleType())
def best_window_ratio(text: pd.Series, label: pd.Series) -> pd.Series:
    """Best similarity of a label with any run of as many words of the text, or with the whole text; equal pairs of a batch once."""
    pairs = [(t or "", name or "") for t, name in zip(text, label, strict=True)]
    score = {pair: _best_ratio(*pair) for pair in set(pairs)}
    return pd.Series([score[pair] for pair in pairs], dtype=float)


@pandas_udf(StringType())
def iri_segment(s: pd.Series) -> pd.Series:
    """Any name as an IRI segment: NFC, white space as -, the rest percent-encoded, hyphens collapsed and trimmed."""

    def one(x):
        if x is None:
            return None
        out = quote("-".join(unicodedata.normalize("NFC", x).split()), safe="-_.")
        while "--" in out:
            out = out.replace("--", "-")
        return out.strip("-")

    return s.map(one)


#: More labels than this are no lookup table: each is compared with every question.
MOST_LABELS = 10_000


def fuzzy_matches(questions: DataFrame, labels: DataFrame, least: float = 0.88) -> DataFrame:
    """(qid, metric, score) of the labels(metric, label), MOST_LABELS at most, that a question nearly says."""
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    pairs = questions.join(F.broadcast(labels), F.length("label") <= F.length("question") * 2)
    return pairs.withColumn("score", best_window_ratio("question", "label")).filter(F.col("score") >= least).groupBy("qid", "metric").agg(F.max("score").alias("score"))


#: Names of a group that one task puts in order; those it compares with each other at once.
CHUNK, BLOCK = 16384, 512
#: What single precision may change in the cosine of two unit vectors, for each of their numbers.
_SINGLE = 2.0**-22


def _units(v: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (or 0), and which rows have one: it isn't null and all its numbers are finite."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    valid = v.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(v.drop_null()).to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors of different lengths")
    unit = np.zeros((len(v), int(sizes[0]) if len(sizes) else 0))
    unit[valid] = v.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), unit.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.linalg.norm(unit, axis=1)
    valid &= np.isfinite(size)
    unit[~valid] = 0
    return np.divide(unit, size[:, None], out=np.zeros_like(unit), where=valid[:, None] & (size[:, None] > 0)), valid


def _nearest(index: np.ndarray, unit: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the best cosine with those of the index, to twelve digits, and the first place that has it.

    Single precision finds what may be the best; only that is computed in double. (-1, -1) where the best is below `low`.
    """
    score, place = np.full(len(unit), -1.0), np.full(len(unit), -1)
    if not unit.shape[1]:
        index, unit = np.zeros((len(index), 1)), np.zeros((len(unit), 1))
    slack = _SINGLE * (unit.shape[1] + 8)
    for start in range(0, len(index), CHUNK):
        part = index[start : start + CHUNK]
        part32 = part.astype(np.float32)
        for at in range(0, len(unit), BLOCK):
            own = unit[at : at + BLOCK]
            near = own.astype(np.float32) @ part32.T
            most = near.max(axis=1)
            rows = np.flatnonzero(most >= low - slack)
            i, j = np.nonzero(near[rows] >= most[rows, None] - 2 * slack)
            exact = np.concatenate([np.round(np.einsum("ij,ij->i", own[rows[i[c : c + CHUNK]]], part[j[c : c + CHUNK]]), 12) for c in range(0, len(i), CHUNK)] or [np.zeros(0)])
            order = np.lexsort((j, -exact, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            better = (exact[first] >= low) & (exact[first] > score[at + rows[i[first]]])
            score[at + rows[i[first[better]]]], place[at + rows[i[first[better]]]] = exact[first[better]], start + j[first[better]]
    return score, place


def _in_order(unit: np.ndarray, valid: np.ndarray, score: np.ndarray, exact: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fold over the rows of a chunk: best score, its place (-1: before the chunk, or below `low`), and which rows are
    added to the index. score: the best that names before the chunk give."""
    score, place, added = score.copy(), np.full(len(unit), -1), np.zeros(len(unit), bool)
    for at in range(0, len(unit), BLOCK):
        end = min(at + BLOCK, len(unit))
        before = np.flatnonzero(added[:at])
        if len(before):
            found, where = _nearest(unit[before], unit[at:end], low)
            better = found > score[at:end]
            score[at:end][better], place[at:end][better] = found[better], before[where[better]]
        own = unit[at:end]
        near = np.round(np.einsum("ik,jk->ij", own, own, optimize=True), 12)
        inside = np.zeros(0, np.int64)  # rows of this block in the index
        for i in range(at, end):
            if not valid[i]:
                continue
            if len(inside):
                mine = near[i - at, inside - at]
                best = int(mine.argmax())
                if mine[best] >= low and mine[best] > score[i]:
                    score[i], place[i] = mine[best], inside[best]
            if score[i] < exact:
                added[i] = True
                inside = np.append(inside, i)
    return score, place, added


def cluster_classes(rows: DataFrame, group: str, order: str, name: str, vector: str, exact: float = 0.95, close: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """Sequential normalisation of names within each group, in order: (group, name, canonical, band).

    A name as near as `exact` to one before takes its place; a close or new one is added to the index itself. Cosines equal
    to twelve digits are ties, the earliest name wins. A name whose vector is null or not finite is novel and not added, one
    with a zero vector has a cosine of 0 with all.

    The order decides, so a group goes through in chunks of at most `chunk` names, all groups' chunks at the same time. A
    chunk is compared with the index of the chunks before it, one task for each of these; only what is left, its names
    among themselves, is one task.
    """
    if not -1 < min(exact, close):
        raise ValueError("exact and close must be above -1")
    low, spark = min(exact, close), rows.sparkSession
    kinds = rows.schema
    g, n, v = (kinds[c].dataType.simpleString() for c in (group, name, vector))
    picked = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(name).alias("n"), F.col(vector).alias("v"))
    types = f"g {g}, n {n}, canonical {n}, band string, v {v}"

    def fold(own: pa.Table, found: pa.Table | None) -> pa.Table:
        own = own.sort_by([("o", "ascending"), ("n", "ascending")])
        unit, valid = _units(own["v"])
        score, names = np.full(len(unit), -1.0), pa.nulls(len(unit), own["n"].type)
        if found is not None and found.num_rows:
            found = found.sort_by([("r", "ascending"), ("score", "descending"), ("c", "ascending")])
            r = found["r"].to_numpy()
            first = np.flatnonzero(np.diff(r, prepend=-1))
            at = np.searchsorted(own["r"].to_numpy(), r[first])
            score[at] = found["score"].to_numpy()[first]
            take = np.full(len(unit), -1)
            take[at] = first
            names = found["canonical"].combine_chunks().take(pa.array(take, mask=take < 0))
        score, place, added = _in_order(unit, valid, score, exact, low)
        mine = own["n"].combine_chunks()
        inside = mine.take(pa.array(np.where(place >= 0, place, np.arange(len(unit)))))
        canonical = pc.if_else(pa.array(added | ~valid | (place >= 0)), inside, names)
        canonical = pc.if_else(pa.array(added | ~valid), mine, canonical)
        band = np.where(valid & ~added, "exact", np.where(valid & (score >= close), "close_match", "novel"))
        vectors = pc.if_else(pa.array(added), own["v"].combine_chunks(), pa.scalar(None, own["v"].type))
        return pa.table([own["g"], mine, canonical, pa.array(band, pa.string()), vectors], ["g", "n", "canonical", "band", "v"])

    def alone(own: pa.Table) -> pa.Table:
        return fold(own, None)

    def compare(own: pa.Table, index: pa.Table) -> pa.Table:
        (unit, valid), (leaders, _) = _units(own["v"]), _units(index["v"])
        if own.num_rows and index.num_rows and leaders.shape[1] != unit.shape[1] and valid.any():
            raise ValueError("vectors of different lengths")
        score, place = _nearest(leaders, unit, low) if valid.any() else (np.zeros(0), np.full(own.num_rows, -1))
        some = np.flatnonzero(valid & (place >= 0))
        return pa.table([own["g"].take(some), own["r"].take(some), pa.array(score[some]), own["c"].take(some), index["n"].take(place[some])], ["g", "r", "score", "c", "canonical"])

    most = picked.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if most <= chunk:
        return picked.groupBy("g").applyInArrow(alone, types).drop("v").withColumnsRenamed({"g": group, "n": name})

    from pyspark.sql import Window

    folder = f"{shared_folder(spark)}/tessera-classes-{uuid.uuid4().hex}"
    at = F.row_number().over(Window.partitionBy("g").orderBy(F.asc_nulls_last("o"), F.asc_nulls_last("n"))) - 1
    picked.withColumn("r", at).withColumn("k", F.floor(F.col("r") / chunk).cast("int")).write.partitionBy("k").parquet(f"{folder}/rows")
    ranked = spark.read.schema(f"g {g}, o {kinds[order].dataType.simpleString()}, n {n}, v {v}, r int")
    done, index = None, None
    for k in range(-(-most // chunk)):
        own = ranked.parquet(f"{folder}/rows/k={k}")
        if index is None:
            out = own.groupBy("g").applyInArrow(alone, types)
        else:
            pieces = own.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            found = pieces.groupBy("g", "c").cogroup(index.groupBy("g", "c")).applyInArrow(compare, f"g {g}, r int, score double, c int, canonical {n}")
            out = own.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(fold, types)
        out.write.parquet(f"{folder}/out-{k}")
        out = spark.read.schema(types).parquet(f"{folder}/out-{k}")
        added = out.filter("v is not null").select("g", "n", "v", F.lit(k).alias("c"))
        index = added if index is None else index.unionByName(added)
        done = out.drop("v") if done is None else done.unionByName(out.drop("v"))
    return done.withColumnsRenamed({"g": group, "n": name})
