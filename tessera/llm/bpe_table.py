"""Byte-level BPE over a table: ids of whole texts, and the bytes that they decode to.

Null texts count as empty and have no ids. Repeated rows and ids are encoded each for itself. An empty table
gives an empty result; extra columns are ignored. The vocabulary is read on the executors from the path
given, which every machine has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import codec


def _encode(path: str, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("bpe")
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_out, bytes_out = [], [], []
                for ids in c.encode(texts):
                    n.append(len(ids))
                    if digest:
                        ids_out.append(hashlib.sha256(" ".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                        bytes_out.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    else:
                        ids_out.append(ids)
                        bytes_out.append(c.decode(ids))
                types = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_out, types[0]), pa.array(bytes_out, types[1])], ["id", "n_tokens", "ids", "decoded"])

    return run


def encode_table(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_tokens, and ids (array<int>) and decoded (binary), or the SHA-256 of both if `digest`."""
    common.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    ids, decoded = ("string", "string") if digest else ("array<int>", "binary")
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_encode(path, pattern, digest), f"id {kind}, n_tokens long, ids {ids}, decoded {decoded}")
    return out.withColumnRenamed("id", key) if key != "id" else out
