"""Triples (g, s, p, o, kind) as DataFrames: reading a Turtle subset, ontologies from tables, sinks, export, merge."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import camel_case, pascal_case, xsd_type

RDF_TYPE = "rdf:type"
SCHEMA = "g string, s string, p string, o string, kind string"
_TERM = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<lit>\"\"\"(?:.|\n)*?\"\"\"|"(?:[^"\\\n]|\\.)*")(?P<tail>@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?|(?P<word>[\w-]*:(?=\s)|@?[\w-]*:?[\w.-]*[\w-])|(?P<op>[;,.\[\]()])""")


def sniff(text: str) -> str | None:
    """turtle, rdfxml or jsonld by how a document starts."""
    head = text.lstrip("﻿ \t\r\n")[:512]
    if head.startswith(("<?xml", "<rdf:RDF")):
        return "rdfxml"
    if head.startswith(("{", "[")):
        return "jsonld"
    return "turtle" if re.match(r"(@prefix|@base|PREFIX|BASE|#|<|[\w-]*:)", head) else None


def read_turtle(text: str) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind) of a Turtle document without collections and blank-node lists; kind is iri or literal."""
    prefixes, out, terms = {}, [], []
    at = 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read Turtle at {text[at : at + 30]!r}")
        if m.lastgroup:
            terms.append((m["iri"] or m["lit"] or m["word"] or m["op"], "literal" if m["lit"] else "op" if m["op"] else "iri"))
        at = m.end()

    def full(term: str) -> str:
        if term == "a":
            return RDF_TYPE
        if term.startswith("<"):
            return term[1:-1]
        name, _, local = term.partition(":")
        return prefixes[name] + local if name in prefixes else term

    def unquoted(term: str) -> str:
        n = 3 if term.startswith('"""') else 1
        return term[n:-n].replace('\\"', '"').replace("\\n", "\n")

    i = 0
    while i < len(terms):
        word = terms[i][0]
        if word.lower() in ("@prefix", "prefix"):
            prefixes[terms[i + 1][0].rstrip(":")] = terms[i + 2][0][1:-1]
            i += 4 if i + 3 < len(terms) and terms[i + 3][0] == "." else 3
            continue
        subject, i = full(word), i + 1
        while terms[i][0] != ".":
            predicate, i = full(terms[i][0]), i + 1
            while True:
                value, kind = terms[i]
                i += 1
                out.append((subject, predicate, unquoted(value) if kind == "literal" else full(value), kind))
                if terms[i][0] != ",":
                    break
                i += 1
            while terms[i][0] == ";":
                i += 1
        i += 1
    return out


def triples(spark: SparkSession, text: str, graph: str) -> DataFrame:
    return spark.createDataFrame([(graph, *t) for t in read_turtle(text)], SCHEMA)


def ontology(columns: DataFrame, keys: DataFrame, graph: str = "default") -> DataFrame:
    """A class for each table; an object property for each reference, a datatype property for any other column."""
    fk = keys.filter("kind = 'FOREIGN KEY'").select("table_name", "column_name", "ref_table")
    c = columns.join(fk, ["table_name", "column_name"], "left").select(pascal_case(F.col("table_name")).alias("class"), camel_case(F.col("column_name")).alias("prop"), F.col("column_name").alias("label"), "data_type", F.when(F.col("ref_table").isNotNull(), pascal_case(F.col("ref_table"))).alias("ref"))
    row = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"))
    name = F.concat_ws(".", "class", "prop")
    is_ref = F.col("ref").isNotNull()
    out = c.select(F.explode(F.array(
        row(F.col("class"), RDF_TYPE, F.lit("owl:Class"), "iri"),
        row(name, RDF_TYPE, F.when(is_ref, "owl:ObjectProperty").otherwise("owl:DatatypeProperty"), "iri"),
        row(name, "rdfs:label", F.col("label"), "literal"),
        row(name, "rdfs:domain", F.col("class"), "iri"),
        row(name, "rdfs:range", F.when(is_ref, F.col("ref")).otherwise(F.concat(F.lit("xsd:"), xsd_type(F.col("data_type")))), "iri"),
    )).alias("t")).select("t.*").distinct()
    return out.select(F.lit(graph).alias("g"), "s", "p", "o", "kind")


def write(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Appends triples, a folder for each graph; a graph's rows may go to many files."""
    df.write.mode("append").partitionBy("g").option("maxRecordsPerFile", rows_per_file).parquet(path)


def delete_subject(df: DataFrame, subject: str) -> DataFrame:
    return df.filter(F.col("s") != subject)


def turtle_lines(df: DataFrame) -> DataFrame:
    """(s, turtle): each subject's statements as one Turtle block, type first, then by predicate and object."""
    term = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), F.replace("o", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.when(F.col("o").contains("://"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.col("o")))
    line = F.struct((F.col("p") != RDF_TYPE).alias("k"), F.col("p").alias("p"), term.alias("o"))
    parts = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(" ", F.when(x["p"] == RDF_TYPE, "a").otherwise(x["p"]), x["o"]))
    subject = F.when(F.col("s").contains("://"), F.concat(F.lit("<"), "s", F.lit(">"))).otherwise(F.col("s"))
    return df.groupBy("s").agg(parts.alias("parts")).select("s", F.concat(subject, F.lit(" "), F.array_join("parts", " ;\n    "), F.lit(" .")).alias("turtle"))


def search(df: DataFrame, text: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(s, label) of subjects whose local name or label holds the text; * or nothing matches all. Ordered by (lower label, s)."""
    label = df.filter("p = 'rdfs:label'").groupBy("s").agg(F.min("o").alias("label"))
    typed = df.filter(F.col("p") == RDF_TYPE)
    typed = typed.filter(F.col("o").isin(*kinds)) if kinds else typed
    rows = typed.select("s").distinct().join(label, "s", "left").withColumn("label", F.coalesce("label", F.lit("")))
    if text not in ("", "*"):
        rows = rows.filter(F.lower(F.regexp_extract("s", r"([^#/.]*)$", 1)).contains(text.lower()) | F.lower("label").contains(text.lower()))
    return rows.orderBy(F.lower(F.when(F.col("label") == "", F.col("s")).otherwise(F.col("label"))), "s")


def edges(df: DataFrame) -> DataFrame:
    """(source, label, target) of the object properties whose domain and range are both known; sorted."""
    prop = df.filter((F.col("p") == RDF_TYPE) & (F.col("o") == "owl:ObjectProperty")).select("s")
    pick = lambda p, name: df.filter(F.col("p") == p).select("s", F.col("o").alias(name))
    return prop.join(pick("rdfs:label", "label"), "s").join(pick("rdfs:domain", "source"), "s").join(pick("rdfs:range", "target"), "s").select("source", "label", "target").distinct().orderBy("source", "label", "target")


def individuals(entities: DataFrame) -> DataFrame:
    """(s, p, o) of entities(iri, class, label, scheme): each is typed, labelled and put into its scheme if it has one."""
    rows = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(p).alias("p"), F.col(c).alias("o"))) for p, c in ((RDF_TYPE, "class"), ("rdfs:label", "label"), ("skos:inScheme", "scheme"))])
    return entities.select(F.col("iri").alias("s"), F.explode(F.array_compact(rows)).alias("x")).select("s", "x.p", "x.o").distinct()


def context(hits: DataFrame, properties: DataFrame, budget: int, class_cost: int = 20, property_cost: int = 30) -> DataFrame:
    """(class, properties) of hits(class, place), best first, as long as the tokens they take stay within the budget.

    properties(class, property). Hits are the few classes near a question; their running sum is one small window.
    """
    from pyspark.sql import Window

    c = hits.join(properties, "class", "left").groupBy("class", "place").agg(F.count("property").alias("n"), F.array_join(F.array_sort(F.collect_set("property")), ",").alias("properties"))
    used = F.sum(class_cost + property_cost * F.col("n")).over(Window.orderBy("place", "class").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("used", used).filter(F.col("used") <= budget).select("class", "properties")


def ingest(stored: DataFrame, new: DataFrame, append: bool = False) -> DataFrame:
    """stored with a graph's new triples: appended to it, or in its place; a triple is there once."""
    graphs = new.select("g").distinct()
    kept = stored if append else stored.join(graphs, "g", "left_anti")
    return kept.unionByName(new).distinct()
