"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other labelled-or-not text is unlabelled, a mixture with the
class prior's share of toxic ones. A linear model over hashed words and word stems (each counted once a text) is trained
with numpy on the non-negative risk: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),
logistic loss, Adam.

Null and empty texts have no word and score by the bias alone. Repeated rows are scored alike. Rows whose
label or id is null are not learned from as positives. With no confirmed toxic text every score is that of a
bias of -20, 2e-9, and nothing is predicted. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import letters_map, steps, word_hash, words

#: Hashed words; texts to learn from at most, toxic and unlabelled; toxic texts a word must be in, and by
#: how many standard deviations more of them than chance among all texts would have it.
BITS, POSITIVES, UNLABELLED, LEAST_TEXTS, LEAST_SIGMA = 20, 2000, 8000, 5, 6.0
STEPS, RATE, DECAY = 300, 0.1, 3e-5
#: A word longer than so many bytes also counts by those first ones, its stem, under another hash.
STEM = 4
_LETTERS = letters_map()


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the hashed words, float32
    bias: float


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, hashed word or stem), each once a row."""
    for i, j, data, edges in steps(column):
        h, starts, ends, upto = words(data, edges, _LETTERS)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(upto))
        long = ends - starts > STEM
        stem = word_hash(_LETTERS[data], starts[long], starts[long] + STEM, 1)
        both = np.unique(np.r_[row << np.uint64(BITS) | h >> np.uint64(64 - BITS), row[long] << np.uint64(BITS) | stem >> np.uint64(64 - BITS)])
        yield i, j, (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("toxicity")
    for b in batches:
        for i, j, row, word in features(b.column("text")):
            cut = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([b.column("y").slice(i, j - i), pa.array([word[s:e].astype(np.uint32).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["y", "words"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sparse(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in names) of the words that names holds."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, word), max(0, len(names) - 1))
    known = names[at] == word if len(names) else np.zeros(len(word), bool)
    return row[known], at[known]


def risk_gradient(w: np.ndarray, b: float, p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], n_p: int, n_u: int, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk (weights, then bias), and the corrected risk of the negatives.

    p, u: (row, place) of the words of the positive and the unlabelled texts. Where the negatives' risk is below zero,
    the gradient is that of stepping back up.
    """
    z_p, z_u = (np.bincount(row, w[at], n) + b for (row, at), n in ((p, n_p), (u, n_u)))
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    # logistic loss: l(+) = log(1 + exp(-z)), l(-) = log(1 + exp(z)), so l(+) - l(-) = -z
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    if negative >= 0:
        g_p, g_u = np.full(n_p, -prior / n_p), s_u / n_u
    else:
        g_p, g_u = prior * s_p / n_p, -s_u / n_u
    return np.r_[np.bincount(p[1], g_p[p[0]], len(w)) + np.bincount(u[1], g_u[u[0]], len(w)), g_p.sum() + g_u.sum()], float(negative)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps_: int = STEPS) -> Model:
    """Minimises the non-negative risk; full-batch, so the result depends on the rows alone."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive or not unlabelled:
        return Model(weights, -20.0)
    in_p, in_u = (np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for x in (positive, unlabelled))
    expected = len(positive) * (in_u + 1) / (len(unlabelled) + 2)
    names = np.flatnonzero((in_p >= LEAST_TEXTS) & (in_p - expected >= LEAST_SIGMA * np.sqrt(expected)))
    p, u = _sparse(positive, names), _sparse(unlabelled, names)
    w, b = np.zeros(len(names)), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    n_p, n_u = len(positive), len(unlabelled)
    for t in range(1, steps_ + 1):
        g, _ = risk_gradient(w, b, p, u, n_p, n_u, prior)
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[names] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic), both already without what must not be learned from.

    At most `positives` toxic and `unlabelled` other texts, chosen by a hash of their id. The class prior is the share
    of toxic rows among all labels.
    """
    common.ready(docs.sparkSession)
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return train([], [], 0.5)
    order = F.xxhash64("doc_id")
    yes = labels.filter("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("y"))
    texts = docs.select("doc_id", "text").filter("text is not null")
    some = texts.select("doc_id").orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("y"))
    picked = F.broadcast(yes.unionByName(some))  # at most positives + unlabelled ids
    got = texts.join(picked, "doc_id").select("y", "text").mapInArrow(_feature_rows, "y int, words binary").collect()
    got = sorted((r["y"], bytes(r["words"])) for r in got)
    rows = {y: [np.frombuffer(w, np.uint32).astype(np.int64) for k, w in got if k == y] for y in (0, 1)}
    return train(rows[1], rows[0], min(0.9, max(0.01, toxic / n)))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, row, word in features(column):
        z = np.bincount(row, model.weights[word], j - i) + model.bias
        out[i:j] = _sigmoid(z)
    return out


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, score (0 to 1), predicted (1 from the threshold on)."""
    spark = docs.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("toxicity")
        for b in batches:
            s = scores(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", key)
