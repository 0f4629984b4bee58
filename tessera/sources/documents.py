"""Document files: listing, reading text, Markdown and docx, gating, exact dedup, elements to Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings that are read, and the largest file, in bytes.
ENDINGS, MAX_BYTES = ("txt", "md", "docx"), 50 << 20
#: Characters a page below which a PDF counts as scanned.
SPARSE_CHARS = 50
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content); content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def docx_text(content: bytes) -> str:
    """Paragraphs of a docx file as Markdown; headings by their style."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.match(r"Heading(\d)", style.get(f"{_W}val", "")) if style is not None else None
        if text.strip():
            out.append(("#" * int(level[1]) + " " if level else "") + text)
    return "\n\n".join(out)


def read_documents(files: DataFrame) -> DataFrame:
    """(path, text, reason): the text, or why there is none (ending, too_large, unreadable, empty)."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    gated = files.select("path", "content", ending.alias("ending"), F.when(~ending.isin(*ENDINGS), "ending").when(F.col("length") > MAX_BYTES, "too_large").alias("reason"))
    plain = F.when(F.col("reason").isNull() & F.col("ending").isin("txt", "md"), F.decode("content", "UTF-8"))

    def docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for content, end, reason in zip(f["content"], f["ending"], f["reason"], strict=True):
                try:
                    texts.append(docx_text(content) if end == "docx" and reason is None else None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append("\x00")
            yield pd.DataFrame({"path": f["path"], "text": f["text"].where(f["text"].notna(), pd.Series(texts, index=f.index)), "reason": f["reason"]})

    rows = gated.withColumn("text", plain).select("path", "content", "ending", "text", "reason").mapInPandas(docx, "path string, text string, reason string")
    reason = F.coalesce("reason", F.when(F.col("text") == "\x00", "unreadable").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"))
    return rows.select("path", F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("reason"))


def gate(docs: DataFrame, least: int = 1, most: int = 1_000_000, text: str = "text") -> DataFrame:
    """Adds `reason`: why a document is not taken (empty, too_small, too_large), or null."""
    n = F.octet_length(F.col(text))
    return docs.withColumn("reason", F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "empty").when(n < least, "too_small").when(n > most, "too_large"))


def first_of_copies(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The first document, by the order column, of those with equal bytes."""
    w = Window.partitionBy(F.sha2(F.col(text), 256)).orderBy(order)
    return docs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def is_scanned(chars: Column, pages: Column) -> Column:
    return (pages == 0) | (chars / pages < SPARSE_CHARS)


def elements_to_markdown(kind: Column, text: Column) -> Column:
    """One element as Markdown; a blank one is null."""
    t = F.trim(text)
    out = F.when(kind == "Title", F.concat(F.lit("## "), t)).when(kind == "Header", F.concat(F.lit("# "), t)).when(kind == "ListItem", F.concat(F.lit("- "), t))
    return F.when(t != "", out.when(kind == "Table", F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(t))
