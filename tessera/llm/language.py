"""Language identification by nearest centroid.

A text is the vector of its byte trigrams (letters only, hashed), weighted by TF-IDF and normalised. Each
language has several centroids, found by spherical k-means on a bounded sample of its labelled texts (so a
language may hold several kinds of text); the nearest centroid by cosine names the language. A text farther
from every centroid than the reach learned from the sample is `rejected`.

Nulls and texts without a letter are `und`, rejected, with score 0. Rows without a label are not learned
from. Ties go to the language that sorts first. With no labelled row at all every text is `und`. Repeated
rows are each judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import letters_map, steps

#: Hashed trigrams; labelled texts to learn from: in all, and of one language, at most; centroids of one.
DIMS, SAMPLE_ROWS, SAMPLE_LANG, CENTROIDS = 4096, 4000, 500, 4
#: A text is rejected if its cosine is below this share of the lowest hundredth in the sample.
REACH = 0.25
_LETTERS = letters_map()
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMS), normalised
    owner: np.ndarray  # language of each centroid
    reach: np.ndarray  # least cosine accepted, of each language


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Trigram counts of runs of rows, as (first, last + 1, matrix)."""
    for i, j, data, edges in steps(column):
        for a in range(i, j, 128):  # a bounded matrix
            b = min(j, a + 128)
            e = edges[a - i : b - i + 1]
            t = _LETTERS[data[e[0] : e[-1]]].astype(np.uint32)
            e = e - e[0]
            rows = np.zeros((b - a, DIMS), np.float32)
            if len(t) >= 3:
                code = ((t[:-2] << 16 | t[1:-1] << 8 | t[2:]) * np.uint32(2654435761)) >> np.uint32(20)
                row = np.repeat(np.arange(b - a), np.diff(e))[: len(code)]
                inside = (np.arange(len(code)) + 2 < e[1:][row]) & ~((t[:-2] == 32) & (t[1:-1] == 32))
                rows = np.bincount((row * DIMS + code)[inside], minlength=(b - a) * DIMS).reshape(b - a, DIMS).astype(np.float32)
            yield a, b, rows


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(rows) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("language")
    for b in batches:
        for i, j, rows in counts(b.column("text")):
            yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "grams"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_lang: int = SAMPLE_LANG) -> Model:
    """Learns from about sample_rows different texts (twice as many at the most, about sample_lang a language), chosen by a
    hash of the text."""
    common.ready(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0))
    quota = max(1, min(sample_lang, sample_rows // len(per)))
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))])
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) / 1_000_000.0
    # copies count once, so that one text with very many can't fill the sample
    drawn = rows.filter(draw < share[F.col("lang")]).distinct().orderBy(F.xxhash64("text", "lang"), "text", "lang").limit(2 * sample_rows)
    got = drawn.mapInArrow(_count_rows, "lang string, grams binary").collect()
    got = sorted((r["lang"], r["grams"]) for r in got)
    names = np.array([a for a, _ in got])
    grams = np.stack([np.frombuffer(g, np.float32) for _, g in got]) if got else np.zeros((0, DIMS), np.float32)
    idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(axis=0))) + 0.05
    langs = sorted(set(names.tolist()))
    v = vectors(grams, idf.astype(np.float32))
    cents, owner, reach = [], [], []
    for k, name in enumerate(langs):
        own = v[names == name]
        c = _clusters(own, CENTROIDS)
        cents.append(c)
        owner += [k] * len(c)
        reach.append(REACH * float(np.quantile((own @ c.T).max(axis=1), 0.01)))
    return Model(langs, idf.astype(np.float32), np.concatenate(cents).astype(np.float32), np.array(owner), np.array(reach))


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean and, one after the other, the vector farthest from all chosen."""
    mean = v.mean(axis=0)
    cents = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(cents) < min(k, len(v)):
        cents.append(v[int((v @ np.stack(cents).T).max(axis=1).argmin())])
    c = np.stack(cents)
    for _ in range(10):
        at = (v @ c.T).argmax(axis=1)
        new = np.stack([v[at == i].sum(axis=0) if (at == i).sum() >= max(2, len(v) // 50) else c[0] for i in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    return np.unique(c, axis=0)


def predict_rows(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    lang, score, rejected = [], [], []
    texts = column.to_pylist()
    for i, j, rows in counts(column):
        letter = np.array([t is not None and _LETTER.search(t) is not None for t in texts[i:j]])
        if not model.langs:
            letter[:] = False
            cos, best, near = np.zeros(j - i), np.zeros(j - i, int), np.zeros(j - i)
        else:
            sim = vectors(rows, model.idf) @ model.centroids.T
            by = np.stack([sim[:, model.owner == k].max(axis=1) for k in range(len(model.langs))], axis=1)
            best = by.argmax(axis=1)
            cos = np.clip(by.max(axis=1), 0, 1)
            near = model.reach[best]
        lang += [model.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
        score.append(np.where(letter, cos, 0.0))
        rejected.append(~letter | (cos < near))
    return lang, np.concatenate(score) if score else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected."""
    spark = docs.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(model)  # DIMS x CENTROIDS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("language")
        for b in batches:
            lang, score, rejected = predict_rows(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", key)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay."""
    spark = docs.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("language")
        for b in batches:
            yield b.filter(pa.array(~predict_rows(sent.value, b.column(text))[2]))

    return docs.mapInArrow(run, docs.schema)
