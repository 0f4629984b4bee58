"""Helpers that the corpus operators share: shared storage, size-checked joins, shipping code."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import shared_folder

#: The white space of the text contracts: space and 0x09 to 0x0D.
WHITE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only while its measured size is within this many bytes.
BROADCAST_BYTES = 128 << 20
#: Rows that go to a Python worker at once.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame, row_bytes: int) -> int:
    """What a written table takes in a broadcast: its rows, at least 16 bytes a column and 32 a row, its arrays' elements
    and its binary columns' bytes.

    Counting rows reads Parquet footers only, counting elements and bytes these columns.
    """
    more = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            each = 8 + 16 * len(f.dataType.elementType.fields) if isinstance(f.dataType.elementType, T.StructType) else 8
            more.append(F.sum(F.size(f.name)) * each)
        elif isinstance(f.dataType, T.BinaryType):
            more.append(F.sum(F.octet_length(f.name)))
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{i}") for i, c in enumerate(more)]).first()
    return (counted[0] or 0) * max(row_bytes, 32 + 16 * len(df.columns)) + sum(v or 0 for v in counted[1:])


def within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it takes at most `limit` bytes; else left to a shuffled join."""
    return F.broadcast(df) if table_bytes(df, row_bytes) <= limit else df


def ready(spark: SparkSession) -> None:
    """Small batches for Python workers, and the package on every executor's path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "tessera_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._tessera_shipped = True


_tenant: list[str] = []


def tenant(who: str) -> None:
    """Called where a worker begins a task: if another operator ran here before, what it kept for reuse is let go."""
    if _tenant and _tenant[0] != who:
        for module, clear in (("packing", lambda m: m.words.cache_clear()), ("bpe", lambda m: m.codec.cache_clear())):
            if m := sys.modules.get(f"{__package__}.{module}"):
                clear(m)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
    _tenant[:] = [who]


def row_keys(key: str, text: str) -> dict:
    """Two hashes that name a row by its content; equal rows share them."""
    return {"k1": F.xxhash64(key, text), "k2": F.hash(key, text)}


def without(docs: DataFrame, verdicts: DataFrame, key: str, text: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that verdicts(k1, k2, kept) drops; of equal rows with one kept, one is kept."""
    per = verdicts.groupBy("k1", "k2").agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    per = written(per.filter("not any or n > 1").withColumnsRenamed({"k1": "_tessera_k1", "k2": "_tessera_k2"}), "verdicts")
    on = ["_tessera_k1", "_tessera_k2"]
    rows = docs.withColumns({f"_tessera_{k}": v for k, v in row_keys(key, text).items()})
    out = rows.join(within(per.filter("not any").select(*on), 24, broadcast_bytes), on, "left_anti")
    again = per.filter("any").select(*on)
    if not again.isEmpty():
        again = within(again, 24, broadcast_bytes)
        out = out.join(again, on, "left_anti").unionByName(out.join(again, on, "left_semi").dropDuplicates(on))
    return out.select(*docs.columns)


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


__all__ = ["BATCH_ROWS", "BROADCAST_BYTES", "WHITE", "crc_of_id", "ready", "row_keys", "table", "table_bytes", "tenant", "within", "without", "written"]
