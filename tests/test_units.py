"""Units without a query of their own: globs, Turtle, metric files, dialects, documents, plug-ins, streams."""

import io
import zipfile

import pytest

from tessera import protocols
from tessera.functions import fuzzy
from tessera.operators import graphs, triples
from tessera.sources import catalog, documents, jdbc, metric_files
from tessera.sources.tables import read
from tests.conftest import SF


def test_globs():
    import re

    assert catalog.split_globs("a|b*, log_[a,b]") == ["a", "b*", "log_[a,b]"]
    r = re.compile(catalog.glob_regex("circuits|driver?,log_[!a]"))
    assert r.match("circuits") and r.match("drivers") and r.match("log_b") and not r.match("log_a") and not r.match("xcircuits")


def test_turtle(spark):
    text = '@prefix ex: <http://x/> .\n# note\nex:A a owl:Class ; rdfs:label "An \\"A\\""@en , "B" .\nex:p a owl:ObjectProperty; rdfs:label "p"; rdfs:domain ex:A ; rdfs:range ex:B .\n'
    rows = triples.read_turtle(text)
    assert ("http://x/A", "rdfs:label", 'An "A"', "literal") in rows and len(rows) == 7
    df = triples.triples(spark, text, "g")
    assert [tuple(r) for r in triples.edges(df).collect()] == [("http://x/A", "p", "http://x/B")]
    assert triples.sniff(text) == "turtle" and triples.sniff(' {"a": 1}') == "jsonld" and triples.sniff("<rdf:RDF>") == "rdfxml"
    assert triples.search(df, "b", ("owl:Class",)).count() == 0 and triples.search(df, "*").count() == 2


def test_metric_files(spark):
    text = '{"datasets": [{"name": "d"}], "metrics": [{"name": "m", "dataset": "d", "expression": [{"dialect": "trino", "expression": "count(*)"}]}, {"name": "n"}, {"expression": "1"}, {"name": "o", "dataset": "z", "expression": "1"}]}'
    metrics, errors = metric_files.parse_metrics(text)
    assert [m["name"] for m in metrics] == ["m", "o"] and len(errors) == 3
    assert metric_files.parse_metrics(metric_files.dump_metrics(metrics))[0] == metrics
    assert metric_files.metrics_frame(spark, text).count() == 2 and metric_files.parse_metrics("[")[1]
    assert metric_files.ddl(catalog.discover_columns(spark, SF, ("region",))).first()["ddl"] == 'CREATE TABLE "region" ("r_regionkey" INTEGER, "r_name" VARCHAR)'


def test_dialects():
    assert jdbc.dialect("Postgres").port == 5432 and jdbc.dialect("nope") is None
    assert jdbc.dialect("mssql").limited("SELECT 1", 5) == "SELECT TOP (5) * FROM (SELECT 1) t" and jdbc.dialect("mssql").quoted("a]b") == "[a]]b]"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("  ")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>te</w:t><w:t>xt</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["reason"]) for r in documents.read_documents(documents.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("hello", None), "b.md": (None, "empty"), "c.bin": (None, "ending"), "d.docx": ("## Top\n\ntext", None), "e.docx": (None, "unreadable")}
    assert documents.docx_text(io.BytesIO((tmp_path / "d.docx").read_bytes()).getvalue()).startswith("##")


def test_graph_bounds(spark):
    e = spark.createDataFrame([("a", "x", "b"), ("b", "x", "a"), ("b", "y", "c")], "src string, rel string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert graphs.expand(e, seeds, hops=2).count() == 3 and graphs.expand(e, seeds, limit=1).count() == 1
    none = graphs.components(e.limit(0), spark.createDataFrame([("z",)], "node string"))
    assert [tuple(r) for r in none.collect()] == [("z", "z")]


def test_iri_segment(spark):
    rows = spark.createDataFrame([("  Café  Noir -- x ",), (None,)], "s string").select(fuzzy.iri_segment("s").alias("i")).collect()
    assert [r["i"] for r in rows] == ["Caf%C3%A9-Noir-x", None]


def test_plugins():
    class S:
        def __init__(self, name, answer):
            self.name, self.answer = name, answer

        def resolve(self, query, namespace, context):
            if self.answer is None:
                raise RuntimeError
            return self.answer

    rows = object()
    miss, low, high = protocols.Answer(rows, 0.1, found=0), protocols.Answer(rows, 0.5), protocols.Answer(rows, 0.9)
    assert protocols.first_answer([S("a", miss), S("b", low), S("c", high)], "q")[0] == "b"
    assert protocols.best_answer([S("x", None), S("a", miss), S("b", low), S("c", high)], "q")[0] == "b"
    assert protocols.best_answer([S("a", miss)], "q") is None
    r = protocols.Registry(protocols.Strategy)
    r.add(S("a", low))
    with pytest.raises(ValueError):
        r.add(S("a", low))
    with pytest.raises(TypeError):
        r.add(3)
    now = [0.0]
    c = protocols.TtlCache(1, 10, lambda: now[0])
    assert c.get("k", lambda: 1) == 1 and c.get("k", lambda: 2) == 1
    now[0] = 11
    assert c.get("k", lambda: 3) == 3


def test_event_windows(spark):
    from tessera.streaming import jobs

    events = jobs.stream(spark, SF, "events")
    assert events.isStreaming
    q = jobs.windowed(events).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM w").first()["n"] == read(spark, SF, "events").count()
