"""Governed metrics: finding them in a question, binding their dimensions, checking and running their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine

#: Longest dimension name and value.
NAME_CHARS, VALUE_CHARS = 128, 4000
#: Labels are broadcast while their measured size is within this many bytes.
LABEL_BYTES = 32 << 20
_PLACEHOLDER = re.compile(r"(?<!:):([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}")


class BadDimension(ValueError):
    """A dimension is undeclared, missing, unused, of the wrong kind or too long."""


def normalized_dimensions(given: dict | list[dict] | None) -> dict[str, object]:
    """Dimensions as a dict: a list has name, operator (only `=`) and value; names are unique ignoring case."""
    pairs = [(d.get("name"), d.get("operator", "="), d.get("value")) for d in given] if isinstance(given, list) else [(k, "=", v) for k, v in (given or {}).items()]
    out, seen = {}, set()
    for name, operator, value in pairs:
        if not isinstance(name, str) or not name or len(name) > NAME_CHARS:
            raise BadDimension("a dimension needs a name of bounded length")
        if operator != "=":
            raise BadDimension(f"dimension {name}: only = is supported")
        if not isinstance(value, str | int | float | bool) or (isinstance(value, float) and not math.isfinite(value)):
            raise BadDimension(f"dimension {name}: a finite scalar is needed")
        if isinstance(value, str) and len(value) > VALUE_CHARS:
            raise BadDimension(f"dimension {name}: the value is too long")
        if name.lower() in seen:
            raise BadDimension(f"dimension {name} is given twice")
        seen.add(name.lower())
        out[name] = value
    return out


def bound(template: str, dimensions: dict | list[dict] | None, allowed) -> tuple[str, dict]:
    """The template with named parameters, and their values; every placeholder needs one and none is left over."""
    values = {k.lower(): v for k, v in normalized_dimensions(dimensions).items()}
    names = [a or b for a, b in _PLACEHOLDER.findall(template)]
    declared = {a.lower() for a in allowed}
    for n in values:
        if n not in declared:
            raise BadDimension(f"dimension {n} is not declared")
    for n in names:
        if n.lower() not in values:
            raise BadDimension(f"dimension {n} is missing")
    for n in values:
        if n not in {x.lower() for x in names}:
            raise BadDimension(f"dimension {n} is not used")
    sql = _PLACEHOLDER.sub(lambda m: ":" + (m[1] or m[2]).lower(), template)
    return sql, values


def run_metric(engine: Engine, template: str, dimensions=None, allowed=(), max_rows: int | None = None) -> DataFrame:
    """Binds, gates and runs a metric."""
    sql, values = bound(template, dimensions, allowed)
    return engine.sql(sql, max_rows=max_rows, args=values)


def match_metrics(questions: DataFrame, metrics: DataFrame, namespace: str = "", label_bytes: int = LABEL_BYTES) -> DataFrame:
    """Exact matches of metric names and synonyms in questions, `_` read as space, at word boundaries.

    questions(qid, question), metrics(metric, namespace, label, is_name) meet by the label's first word and are then
    compared whole. An empty namespace sees all metrics, a metric without one is seen by all. One row per question and metric: name hits before
    synonym hits, and the number of hits. A question is repeated for each of its words, so its side is never broadcast: the
    labels are, up to label_bytes, and more of them are joined by a shuffle.
    """
    seen = F.lit(namespace == "") | (F.lower("namespace") == namespace.lower()) | (F.col("namespace") == "")
    pattern = F.concat(F.lit(r"(^|\W)"), F.regexp_replace(F.regexp_replace(F.lower("label"), r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\$1"), "[_ ]", "[_ ]"), F.lit(r"(\W|$)"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    first = F.coalesce(F.get(words("label"), F.lit(0)), F.lit(""))  # a label without such a word is looked for in all
    m = metrics.filter(seen).withColumn("pattern", pattern).withColumn("_w", first)
    asked = questions.withColumn("_w", F.explode(F.array_append(F.array_distinct(words("question")), F.lit(""))))
    size = m.agg(F.sum(128 + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("metric", "label", "pattern", "_w")))).first()[0] or 0
    hit = asked.join(F.broadcast(m) if size <= label_bytes else m.hint("merge"), "_w").filter(F.rlike(F.lower("question"), F.col("pattern")))
    return hit.groupBy("qid", "metric").agg(F.max(F.col("is_name").cast("int")).alias("by_name"), F.count("*").alias("hits"))


def residual_tokens(text: Column, stop_words) -> Column:
    """Tokens of a question that are no stop word; duplicates and order are kept."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_%$]+)"), F.lit(1))
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def merge_spans(spans: DataFrame, key: str = "key") -> DataFrame:
    """Overlapping or touching spans (start, end) of each key as one; a null start or end comes after all others."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
