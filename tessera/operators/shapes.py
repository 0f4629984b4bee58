"""Checks of triples and of metric definitions: shapes, ranges, linkage, ambiguous matches, grouping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sqlgate import _expressions, _nodes, _seq, parse

#: Each numeric type and the types whose values it takes in.
WIDER = {
    "decimal": ("decimal", "integer", "long", "int", "short", "byte"),
    "integer": ("integer", "long", "int", "short", "byte"),
    "long": ("long", "int", "short", "byte"),
    "int": ("int", "short", "byte"),
    "short": ("short", "byte"),
}
SHAPES = "class string, path string, min_count int, max_count int, datatype string, pattern string, node_class string, min_value double"
#: What try_cast tells of a literal's type.
_CASTS = {"integer": "bigint", "long": "bigint", "int": "int", "short": "smallint", "byte": "tinyint", "decimal": "decimal(38,10)", "double": "double", "float": "float", "date": "date", "dateTime": "timestamp", "boolean": "boolean"}


def shape_findings(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """(check_name, class, path, subject) of what breaks shapes (see SHAPES; null is no constraint).

    triples(s, p, o) with rdf:type for the classes. minCount, maxCount (per subject), datatype, pattern, class of the
    object, and a least value; one row for each subject and check.
    """
    typed = triples.filter("p = 'rdf:type'").select(F.col("s").alias("subject"), F.col("o").alias("class")).distinct()
    focus = typed.join(shapes, "class")  # shapes are written by hand
    values = triples.filter("p <> 'rdf:type'").select(F.col("s").alias("subject"), F.col("p").alias("path"), "o")
    joined = focus.join(values, ["subject", "path"], "left").join(typed.select(F.col("subject").alias("o"), F.col("class").alias("o_class")), "o", "left")
    wrong = F.lit(False)
    for name, kind in _CASTS.items():
        wrong = wrong | ((F.col("datatype") == name) & F.col("o").try_cast(kind).isNull())
    flag = lambda c: F.max(F.coalesce(F.col("o").isNotNull() & c, F.lit(False)))
    right_class = F.max(F.coalesce(F.col("o_class") == F.col("node_class"), F.lit(False)))
    each = joined.groupBy("class", "path", "subject", "o").agg(
        *[F.first(c).alias(c) for c in ("min_count", "max_count", "node_class")],
        flag(wrong).alias("datatype"), flag(~F.rlike("o", "pattern")).alias("pattern"), flag(F.col("o").try_cast("double") < F.col("min_value")).alias("min_value"), right_class.alias("right_class"),
    )
    n = F.count("o")
    per = each.groupBy("class", "path", "subject").agg(
        (n < F.first("min_count")).alias("minCount"), (n > F.first("max_count")).alias("maxCount"), F.max("datatype").alias("datatype"), F.max("pattern").alias("pattern"),
        F.max("min_value").alias("minInclusive"), F.max(F.col("o").isNotNull() & F.col("node_class").isNotNull() & ~F.col("right_class")).alias("class_"),
    )
    checks = [F.when(F.col(c), F.lit(c.rstrip("_"))) for c in ("minCount", "maxCount", "datatype", "pattern", "minInclusive", "class_")]
    return per.select(F.explode(F.array_compact(F.array(*checks))).alias("check_name"), "class", "path", "subject")


def range_compatible(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """asked(prop, literal_type) and whether it fits: the range itself or a narrower number; null if the property has no range."""
    wider = F.create_map(*[x for k, v in WIDER.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    j = asked.join(ranges.groupBy("prop").agg(F.collect_set("range").alias("ranges")), "prop", "left")
    fits = F.exists("ranges", lambda r: (r == F.col("literal_type")) | F.coalesce(F.array_contains(F.try_element_at(wider, r), F.col("literal_type")), F.lit(False)))
    return j.select(*asked.columns, F.when(F.col("ranges").isNotNull(), fits).alias("compatible"))


def ambiguous(triples: DataFrame) -> DataFrame:
    """(s, o) of matches that were left open: related, not exact."""
    return triples.filter(F.col("p").isin("skos:relatedMatch", "http://www.w3.org/2004/02/skos/core#relatedMatch")).select("s", "o").distinct()


def unlinked(concepts: DataFrame, classes: DataFrame) -> DataFrame:
    """concepts(metric, concept) that name no class(class), by its name or the last part of its IRI, ignoring case."""
    last = lambda c: F.lower(F.regexp_extract(c, r"([^#/]*)$", 1))
    return concepts.withColumn("_k", last("concept")).join(classes.select(last("class").alias("_k")).distinct(), "_k", "left_anti").select("metric", "concept")


def grouping_columns(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """(table, column) of what a statement groups by, of each of its aggregates; the table is '' where several are read."""
    out = []
    for node in _nodes(parse(spark, sql)):
        if node.getClass().getSimpleName() != "Aggregate":
            continue
        tables = sorted({".".join(_seq(n.multipartIdentifier())).lower() for n in _nodes(node.child()) if n.getClass().getSimpleName() == "UnresolvedRelation"})
        for top in _seq(node.groupingExpressions()):
            for e in _expressions(top):
                if e.getClass().getSimpleName() == "UnresolvedAttribute":
                    out.append((tables[0] if len(tables) == 1 else "", _seq(e.nameParts())[-1].lower()))
    return out


def unknown_groupings(spark: SparkSession, metrics: dict[str, str], columns: DataFrame) -> DataFrame:
    """(metric, column_name) that metrics(name -> SQL) group by and the catalog's tables don't have.

    Tables the catalog knows no columns of aren't judged.
    """
    rows = [(m, t, c) for m, sql in metrics.items() for t, c in grouping_columns(spark, sql)]
    asked = spark.createDataFrame(rows, "metric string, table_name string, column_name string")
    low = columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    known = asked.join(low.select("table_name").distinct(), "table_name", "left_semi")
    return known.join(low, ["table_name", "column_name"], "left_anti").select("metric", "column_name").distinct()


def in_class(iri: str, prefix: str) -> bool:
    """Whether an IRI is the prefix or goes on from it behind a boundary."""
    if not prefix or iri == prefix:
        return True
    return iri.startswith(prefix) and (prefix[-1] in "#/:" or iri[len(prefix)] in "#/:")


def split_top(text: str) -> list[str]:
    """Parts between the commas that stand in no bracket and no quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*parts, last] if last or parts else []


def projection(spark: SparkSession, sparql: str, header: str) -> dict | None:
    """Which output variable comes from which helper of a translator's header: `[?name/1 AS v0, ?n AS v1]`.

    Variables are matched by name, not by place; DISTINCT is read from the query alone. None if a projected variable has
    no helper: a partial projection is worse than none.
    """
    import re

    m = re.match(r"\s*SELECT\s+(DISTINCT\s+|REDUCED\s+)?(.*?)\s*(?:WHERE\s*)?\{", sparql, re.S | re.I)
    if not m:
        return None
    names = re.findall(r"\(.*?\bAS\s+\?(\w+)\s*\)|\?(\w+)", m[2], re.S | re.I)
    wanted = [a or b for a, b in names]
    terms = {}
    for part in split_top(header.strip().removeprefix("[").removesuffix("]")):
        t = re.match(r"\?(\w+)(?:/\d+)?\s+AS\s+(\w+)$", part, re.I)
        if t:
            terms[t[1]] = t[2]
    if m[2].strip() == "*":
        wanted = list(terms)
    if not wanted or any(w not in terms for w in wanted):
        return None
    return {"variables": {w: terms[w] for w in wanted}, "distinct": bool(m[1] and m[1].strip().upper() == "DISTINCT")}


# --- composite keys --------------------------------------------------------


def composite_usable(columns: list[str], referred: list[tuple[str, str]]) -> bool:
    """Whether a reference of several columns can be one join: as many referred columns, all named, of one table."""
    return len(columns) > 1 and len(columns) == len(referred) and all(t and c for t, c in referred) and len({t for t, _ in referred}) == 1


def absorbed(table_columns: list[str], references: list[tuple[list[str], list[tuple[str, str]]]]) -> dict[str, str]:
    """Columns that a composite reference takes in, with the column that carries it; '' for those of unusable ones.

    Columns are walked in the table's order: one that no reference has taken in yet claims the first usable reference
    it is in that isn't claimed, and carries it.
    """
    open_ = [cols for cols, referred in references if composite_usable(cols, referred)]
    carried: dict[str, list[str]] = {}
    inside: set[str] = set()
    for c in table_columns:
        if c in inside:
            continue
        mine = next((r for r in open_ if c in r), None)
        if mine is not None:
            open_ = [r for r in open_ if r is not mine]
            carried[c] = mine
            inside.update(mine)
    out = {c: "" for cols, referred in references if len(cols) > 1 and not composite_usable(cols, referred) for c in cols if c in table_columns}
    for owner, cols in carried.items():
        for c in cols:
            if c != owner and c in table_columns:
                out.setdefault(c, owner)
    return {c: o for c, o in out.items() if c not in carried}
