"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every partition sorts the short fingerprints of its texts, codes their gaps (Golomb-Rice, numpy) and
sends one blob to each owner of a fingerprint range. An owner answers each sender with a bitmap of the
fingerprints that are seen elsewhere or twice. Only the rows so marked, the suspects, are shuffled with
their text, and their bytes decide.

Nulls in the text count as the empty text; the empty text is a text like any other; rows with a null id
are kept, as their own group's members like the rest (null sorts before every id). Repeated rows are
copies of each other. An empty table gives an empty result. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprint bits beyond log2 of the row count: one text in 2**EXTRA_BITS is a suspect by chance.
EXTRA_BITS = 12
#: Fingerprints that one owner, and one sender's chunk, handle at most on average.
OWNER_ROWS, CHUNK_ROWS = 1 << 19, 1 << 16


def normal(text: str = "text"):
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.WHITE, " ")


def rice_encode(sorted_values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of the gaps of ascending unsigned values below 2**bits.

    Layout: count (8 bytes), parameter (1 byte), unary quotients, then remainders of fixed width, each part
    padded to bytes; so both parts decode without a loop.
    """
    n = len(sorted_values)
    if not n:
        return b""
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, bits - max(1, math.ceil(math.log2(n + 1))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    remainder = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(8, "little") + bytes([k]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(remainder.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, m = int.from_bytes(blob[:8], "little"), blob[8], int.from_bytes(blob[9:17], "little")
    raw = np.frombuffer(blob, np.uint8)[17:]
    cut = -(-m // 8)
    ends = np.flatnonzero(np.unpackbits(raw[:cut], count=m))
    quotient = np.diff(ends, prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(raw[cut:], count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


_SENT = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("codes", pa.binary()), ("rows", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _send(bits: int, owner_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("exact_dedup")
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            src, num, h = (np.concatenate(x) for x in zip(*kept, strict=True))
            f = h.view(np.uint64) >> np.uint64(64 - bits)
            order = np.argsort(f, kind="stable")
            f, num = f[order], num[order]
            value, first = np.unique(f, return_index=True)
            which = np.cumsum(np.r_[0, (np.diff(f) != 0).astype(np.int32)]).astype(np.int32)
            owner = (value >> np.uint64(bits - owner_bits)).astype(np.int32) if owner_bits else np.zeros(len(value), np.int32)
            cut = np.flatnonzero(np.r_[True, np.diff(owner) != 0, True])
            edge = np.r_[first, len(f)]
            sender = int(src[0]) << 24 | flush.chunk
            flush.chunk += 1
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                low = np.uint64(int(owner[a]) << (bits - owner_bits)) if owner_bits else np.uint64(0)
                s, e = edge[a], edge[b]
                rows.append({"sender": sender, "owner": int(owner[a]), "codes": rice_encode(value[a:b] - low, bits - owner_bits), "rows": num[s:e], "at": which[s:e] - a})
            return pa.RecordBatch.from_pylist(rows, _SENT)

        flush.chunk = 0
        for b in batches:
            if b.num_rows:
                kept.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                held += b.num_rows
                if held >= CHUNK_ROWS:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner's answer: for each sender the bitmap of its values that another sender has too."""
    sent = [rice_decode(x.as_py()) for x in table.column("codes")]
    value, n = np.unique(np.concatenate(sent), return_counts=True)
    twice = value[n > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
    return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers whose fingerprint the bitmap marks or that share one within their sender."""
    for b in batches:
        out = []
        for rows, at, bitmap in zip(b.column("rows"), b.column("at"), b.column("bitmap"), strict=True):
            num, which = np.asarray(rows.values), np.asarray(at.values)
            here = np.bincount(which)
            marked = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8), count=len(here)).astype(bool) | (here > 1)
            out.append(num[marked[which]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], ["row_num"])


def suspects(prints: DataFrame) -> DataFrame:
    """row_num of every row of prints(src, row_num, h) whose short fingerprint is not alone."""
    n = max(1, prints.count())
    bits = min(60, max(8, math.ceil(math.log2(n + 1)) + EXTRA_BITS))
    owner_bits = max(0, math.ceil(math.log2(max(1, n / OWNER_ROWS)))) + 3
    sent = common.written(prints.select("src", "row_num", "h").mapInArrow(_send(bits, owner_bits), "sender long, owner int, codes binary, rows array<long>, at array<int>"), "sent")
    maps = sent.select("sender", "owner", "codes").groupBy("owner").applyInArrow(_answer, "sender long, owner int, bitmap binary")
    maps = common.written(maps, "maps")  # if `sent` is broadcast, one task would hold a worker for this step and one for the next
    joined = sent.select("sender", "owner", "rows", "at").join(maps, ["sender", "owner"])
    return joined.select("rows", "at", "bitmap").mapInArrow(_suspects, "row_num long")


def _verdicts(docs: DataFrame, key: str, text: str, broadcast_bytes: int) -> DataFrame:
    common.ready(docs.sparkSession)
    base = docs.select(*[v.alias(k) for k, v in common.row_keys(key, text).items()], F.col(key).alias("id"), normal(text).alias("norm"))
    # the long hash is what a row is known by from here on; ties within it are settled by bytes
    prints = common.written(base.select("k1", "k2", "id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), F.spark_partition_id().cast("long").alias("src"), F.monotonically_increasing_id().alias("row_num")), "prints")
    marked = common.written(prints.join(suspects(prints), "row_num", "left_semi").select("h").distinct(), "marked")
    # the suspects' texts meet by fingerprint and are compared whole; copies are counted before they are dealt
    texts = base.select("norm").withColumn("h", F.xxhash64("norm")).join(common.within(marked, 24, broadcast_bytes), "h", "left_semi")
    groups = texts.groupBy("h", "norm").agg(F.count("*").alias("group_size"))
    verified = common.written(groups.filter("group_size > 1").select("h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "group_size"), "verified")
    verified = common.within(verified, 72, broadcast_bytes)
    first = F.min(F.struct("id", "row_num")).alias("first")
    keep = common.written(prints.join(verified, ["h", "sha"]).groupBy("h", "sha", "group_size").agg(first), "keep")
    out = prints.join(common.within(keep, 88, broadcast_bytes), ["h", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1))
    return out.select(
        F.col("id").alias(key),
        F.when(size > 1, F.col("first.id")).otherwise(F.col("id")).alias("keep_id"),
        size.cast("long").alias("group_size"),
        ((size == 1) | (F.col("row_num") == F.col("first.row_num"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "k1",
        "k2",
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256 of the normalised text.

    Of rows with equal normalised text the one with the smallest key stays; if that key repeats, one of its rows.
    """
    return _verdicts(docs, key, text, broadcast_bytes).drop("k1", "k2")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; all columns stay."""
    verdicts = common.written(_verdicts(docs, key, text, broadcast_bytes).select("k1", "k2", "kept"), "kept")
    return common.without(docs, verdicts, key, text, broadcast_bytes)
