"""Removal of repeated passages by seed and extend.

Seeds: every run of SEED words is hashed; of the seeds inside each window of `window` words the smallest hash
is the window's anchor (winnowing), so equal windows have equal anchors at equal offsets. Consecutive windows
with the same anchor form a run: the anchor, and the words that its windows reach to the left and to the right.

Join: runs meet by anchor; runs that are equal as a whole are one kind. Extend: where an anchor has several
kinds, one of them, the pivot, meets each other one, and the match is extended word by word to the left and to
the right, as far as the bytes agree. Matched words that make up a window are repeated in both. Two kinds can
share more with each other than with the pivot only where they leave it at the same place with the same next
word; these go on as groups of their own, with pivots of their own, until no group can give anything new. So no
pair is formed but with a pivot, and every maximal repeat is found: pieces of neighbouring anchors are joined up.

A group's members meet their pivot in an ordinary join, which can be split, and are never gathered in one task;
counting goes through partial aggregates. Kinds are told apart by 128 bits (of two independent hashes of the
words), extension compares bytes.

Null texts have no words; texts shorter than a window keep all words. Repeated rows are texts of their own
(each repeats the other), also under one id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import _WHITE, gram_hash, mix, ranges, spans, steps, word_hash

#: Words of a seed; a mask of offsets has room for so many more words in a window.
SEED, MASK_BITS = 12, 62
#: Bytes of contexts that a task gathers before it hands them on.
FLUSH = 4 << 20
_KIND = ["k1", "k2", "first"]
_CONTEXT = pa.schema([("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("first", pa.int32()), ("n", pa.int16()), ("left", pa.int16()), ("twice", pa.bool_()), ("seed", pa.binary()), ("after", pa.binary()), ("before", pa.binary())])


def seed_words(window: int) -> int:
    return max(min(SEED, window), window - MASK_BITS)


def _anchors(seeds: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w consecutive seeds, the first of equals (by their upper 40 bits)."""
    slab = 1 << 23
    parts = [_anchors_of(seeds[a : a + slab + w - 1], w) + a for a in range(0, max(1, len(seeds) - w + 1), slab)]
    return np.concatenate(parts)


def _anchors_of(seeds: np.ndarray, w: int) -> np.ndarray:
    n = len(seeds)
    key = (seeds & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    width = 1
    best = key
    while 2 * width <= w:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    m = n - w + 1
    return (np.minimum(best[:m], best[w - width : w - width + m]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _runs(h: np.ndarray, upto: np.ndarray, window: int):
    """Runs of windows with one anchor, inside rows: row, first window, windows, anchor hash, anchor position."""
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    seeds = gram_hash(h, seed_words(window))
    at = _anchors(seeds, window - seed_words(window) + 1)
    first = np.arange(len(at))
    row = np.searchsorted(upto, first, "right") - 1
    inside = first + window <= upto[row + 1]
    new = np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])] & inside
    starts = np.flatnonzero(new)
    # windows inside a row are contiguous, so a run ends before the next run or at its row's last window
    ends = np.minimum(np.r_[starts[1:], len(at)], upto[row[starts] + 1] - window + 1)
    return row[starts], starts, ends - starts, seeds[at[starts]], at[starts]


def _find(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("substring_dedup")
        for b in batches:
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for i, _, data, edges in steps(b.column("text")):
                s, e, upto = spans(_WHITE[data], edges)
                row, first, n, anchor, at = _runs(word_hash(data, s, e), upto, window)
                if not len(row):
                    continue
                # a run is its first and its last window (they overlap or touch) and where the anchor stands in it
                grams = gram_hash(word_hash(data, s, e, 1), window, 1)
                left = at - first
                whole = mix(mix(grams[first] + left.astype(np.uint64)) * np.uint64(3) + grams[first + n - 1] + n.astype(np.uint64))
                cols = (anchor.view(np.int64), whole.view(np.int64), k1[i + row], k2[i + row], (first - upto[row]).astype(np.int32), n.astype(np.int16), left.astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["anchor", "span", *_KIND, "n", "left"])

    return run


def _contexts(window: int):
    """The words around the anchors that are asked for: of the seed, to the right, and (backwards) to the left.

    Each word is followed by one space.
    """
    size = seed_words(window)

    def spaced(words: list[bytes]) -> bytes:
        return b" ".join(words) + b" " if words else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("substring_dedup")
        for b in batches:
            held, size_held = [], 0
            for r in range(b.num_rows):
                words = (b.column("text")[r].as_py() or "").encode().split()
                asked = b.column("asked")[r].values
                anchor, first, n, left, twice = (asked.field(c).to_pylist() for c in ("anchor", "first", "n", "left", "twice"))
                k1, k2 = b.column("k1")[r].as_py(), b.column("k2")[r].as_py()
                for x in zip(anchor, first, n, left, twice, strict=True):
                    at = x[1] + x[3]
                    parts = words[at : at + size], words[at + size : x[1] + x[2] - 1 + window], words[x[1] : at][::-1]
                    seed, after, before = (spaced(p) for p in parts)
                    held.append((x[0], k1, k2, *x[1:], seed, after, before))
                    size_held += len(seed) + len(after) + len(before)
                if held and (size_held > FLUSH or r == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)
                    held, size_held = [], 0

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [(data, edges) for _, _, data, edges in steps(column, 1 << 62)]
    return parts[0] if parts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def common_words(one: pa.Array, other: pa.Array) -> np.ndarray:
    """Words that both start with, row by row; every word ends in a space."""
    (a, ea), (b, eb) = _flat(one), _flat(other)
    n = np.minimum(np.diff(ea), np.diff(eb))
    row = np.repeat(np.arange(len(n)), n)
    x, y = ranges(ea[:-1], ea[:-1] + n), ranges(eb[:-1], eb[:-1] + n)
    differ = a[x] != b[y]
    bad = np.flatnonzero(differ)
    same = n.copy()
    np.minimum.at(same, row[bad], x[bad] - ea[:-1][row[bad]])
    spaces = np.r_[0, np.cumsum(a == 0x20)]
    return spaces[ea[:-1] + same] - spaces[ea[:-1]]


def offsets_mask(left: np.ndarray, right: np.ndarray, room: int) -> np.ndarray:
    """Bit d is set for each window that has d words left of the seed, if at most `left` and `right` words match there.

    room: the words of a window besides the seed.
    """
    high = (np.int64(1) << (np.minimum(left, room) + 1)) - 1
    low = (np.int64(1) << np.clip(room - right, 0, room + 1)) - 1
    return np.where((left >= 0) & (left + right >= room), high & ~low, 0)


def _extend(window: int):
    """Extends each member's match with its group's pivot.

    Gives, of both, the mask of repeated windows; and of a member the groups in which it may share more with
    others: those that leave the pivot at the same word, to the right or to the left.
    """
    size = seed_words(window)
    room = window - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("substring_dedup")
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            seed, after, before = (b.column(c).to_pylist() for c in ("seed", "after", "before"))
            alike = np.array([x == y for x, y in zip(seed, b.column("p_seed").to_pylist(), strict=True)])
            right = np.where(alike, common_words(b.column("after"), b.column("p_after")), -1)
            left = np.where(alike, common_words(b.column("before"), b.column("p_before")), -1)
            own_left = col("left").astype(np.int64)
            own_right = col("n").astype(np.int64) - 1 + room - own_left
            found = offsets_mask(left, right, room)
            mask = col("mask") | found
            missing = np.where(col("twice"), 0, offsets_mask(own_left, own_right, room) & ~mask)
            known_left, known_right = col("known_left"), col("known_right")
            out: dict[str, list] = {c: [] for c in ("key", "rid", "known_left", "known_right", "mask", "needy")}

            def put(r, key, kl, kr, needy):
                for c, v in zip(out, (key, int(b.column("rid")[r].as_py()), int(kl), int(kr), int(mask[r]), bool(needy)), strict=True):  # noqa: B023
                    out[c].append(v)

            for r in range(b.num_rows):
                if not alike[r]:  # another seed under the same hash: its kinds go on among themselves
                    put(r, _key(seed[r], b"", b"", 0, 0), 0, 0, missing[r])
                    continue
                on_right, on_left = right[r] < own_right[r], left[r] < own_left[r]
                if on_right:  # windows that need the next word to the right
                    more = missing[r] & ((np.int64(1) << (room - right[r])) - 1)
                    put(r, _key(seed[r], before[r], after[r], known_left[r], right[r] + 1), known_left[r], right[r] + 1, more)
                if on_left:  # the next word to the left
                    more = missing[r] & ~((np.int64(1) << (left[r] + 1)) - 1)
                    put(r, _key(seed[r], before[r], after[r], left[r] + 1, known_right[r]), left[r] + 1, known_right[r], more)
                if mask[r] and not (on_right or on_left):
                    put(r, None, 0, 0, False)
            pivot, at = np.unique(col("pivot"), return_inverse=True)
            total = np.zeros(len(pivot), np.int64)
            np.bitwise_or.at(total, at, found)
            for p, m in zip(pivot[total != 0].tolist(), total[total != 0].tolist(), strict=True):
                for c, v in zip(out, (None, p, 0, 0, m, False), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), pa.array(out["rid"], pa.int64()), pa.array(out["known_left"], pa.int32()), pa.array(out["known_right"], pa.int32()), pa.array(out["mask"], pa.int64()), pa.array(out["needy"], pa.bool_())], list(out))

    return run


def _key(seed: bytes, before: bytes, after: bytes, left: int, right: int) -> bytes:
    """Name of the kinds with this seed and these many words around it."""
    known = b"\n".join((seed, b" ".join(before.split(b" ", left)[:left]), b" ".join(after.split(b" ", right)[:right])))
    return blake2b(known, digest_size=16).digest()


def _shared(kinds: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """(rid, mask) of the kinds that share windows with others of their anchor."""
    context = kinds.select("rid", "n", "left", "twice", "seed", "after", "before")
    members = kinds.select(F.col("anchor").cast("string").cast("binary").alias("key"), "rid", F.lit(0).alias("known_left"), F.lit(0).alias("known_right"), F.lit(0).cast("long").alias("mask"), (~F.col("twice")).alias("needy"))
    masks = []
    while True:
        groups = members.groupBy("key").agg(F.count("*").alias("size"), F.max("needy").alias("needy"), F.min("rid").alias("pivot")).filter("size > 1 and needy").select("key", "pivot")
        groups = common.written(groups, "groups")
        if groups.isEmpty():
            break
        pivot = context.select(F.col("rid").alias("pivot"), *[F.col(c).alias(f"p_{c}") for c in ("seed", "after", "before")])
        pivots = common.written(groups.join(pivot, "pivot"), "pivots")
        met = members.drop("needy").join(common.within(pivots, 96, broadcast_bytes), "key").filter("rid <> pivot").join(context, "rid")
        out = met.mapInArrow(_extend(window), "key binary, rid long, known_left int, known_right int, mask long, needy boolean")
        out = common.written(out, "extended")
        masks.append(out.filter("mask <> 0").select("rid", "mask"))
        # the same group may be reached by going right, then left, and the other way round
        members = out.filter("key is not null").groupBy("key", "rid", "known_left", "known_right").agg(F.bit_or("mask").alias("mask"), F.max("needy").alias("needy"))
        members = common.written(members, "members")
    if not masks:
        return kinds.select("rid", F.lit(0).cast("long").alias("mask")).limit(0)
    found = masks[0]
    for m in masks[1:]:
        found = found.unionByName(m)
    return found.groupBy("rid").agg(F.bit_or("mask").alias("mask"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one text that follow each other and touch, as one: first word << 32 | word after the last."""
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, first, end = (b.column(c).to_numpy() for c in (*_KIND, "end"))
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (first[1:] > end[:-1]) | (first[1:] < first[:-1])]
        s = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(k1[s]), pa.array(k2[s]), pa.array(first[s].astype(np.int64) << 32 | np.maximum.reduceat(end, s))], ["k1", "k2", "span"])


def _mask_spans(window: int):
    """The windows of the masks, those that touch as one span."""
    room = window - seed_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("substring_dedup")
        away = np.arange(room, -1, -1)  # from the window farthest to the left
        for b in batches:
            at = b.column("first").to_numpy() + b.column("left").to_numpy()
            row, k = np.nonzero((b.column("mask").to_numpy()[:, None] >> away) & 1)
            start = at[row] - away[k]
            cols = b.column("k1").to_numpy()[row], b.column("k2").to_numpy()[row], start, start + window
            yield from _joined(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [*_KIND, "end"])]))

    return run


def _once(rows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """rows(k1, k2, text) without repeated rows; only those that repeat are shuffled."""
    again = common.written(rows.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"), "again")
    if again.isEmpty():
        return rows
    again = common.within(again, 12, broadcast_bytes)
    return rows.join(again, ["k1", "k2"], "left_anti").unionByName(rows.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))


def repeats(rows: DataFrame, window: int = 35, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """Repeated spans of rows(k1, k2, text): k1, k2, span (first word << 32 | word after the last); they may overlap."""
    common.ready(rows.sparkSession)
    rows = rows.select("k1", "k2", "text")
    runs = common.written(rows.mapInArrow(_find(window), "anchor long, span long, k1 long, k2 int, first int, n short, left short"), "runs")
    kinds = runs.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("span") != F.max("span")).alias("mixed")).filter("times > 1").select("anchor", "mixed")
    kinds = common.written(kinds, "anchors")
    met = common.written(runs.join(common.within(kinds, 17, broadcast_bytes), "anchor"), "met")
    alike = met.groupBy("anchor", "span", "mixed").agg(F.count("*").alias("times"), F.min(F.struct(*_KIND, "n", "left")).alias("one"))
    alike = common.written(alike, "alike")
    whole = common.within(alike.filter("times > 1").select("anchor", "span"), 24, broadcast_bytes)
    done = met.join(whole, ["anchor", "span"], "left_semi").select(*_KIND, (F.col("first") + F.col("n") + (window - 1)).alias("end"))
    done = done.mapInArrow(_joined, "k1 long, k2 int, span long")
    # anchors with several kinds: one run of each kind, with the words around it
    asked = alike.filter("mixed").select("one.*", "anchor", (F.col("times") > 1).alias("twice"))
    asked = common.written(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "first", "n", "left", "twice")).alias("asked")), "asked")
    texts = _once(rows, broadcast_bytes).join(common.within(asked, 48, broadcast_bytes), ["k1", "k2"])
    context = texts.mapInArrow(_contexts(window), "anchor long, k1 long, k2 int, first int, n short, left short, twice boolean, seed binary, after binary, before binary")
    context = common.written(context.withColumn("rid", F.xxhash64(*_KIND)), "contexts")
    mask = _shared(context, window, broadcast_bytes)
    parts = context.filter("not twice").select("rid", *_KIND, "left").join(common.within(common.written(mask, "masks"), 16, broadcast_bytes), "rid")
    parts = parts.mapInArrow(_mask_spans(window), "k1 long, k2 int, span long")
    return done.unionByName(parts)


def kept_words(text: str | None, removed: np.ndarray | None) -> tuple[list[bytes], int]:
    """The words that no removed span covers, and how many there were."""
    words = (text or "").encode().split()  # splits at 0x20 and 0x09 to 0x0D
    n = len(words)
    if removed is not None:
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, removed >> 32, 1)
        np.add.at(cover, removed & 0xFFFFFFFF, -1)
        words = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
    return words, n


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("substring_dedup")
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, removed in zip(b.column("text"), b.column("removed"), strict=True):
            words, n = kept_words(text.as_py(), removed.values.to_numpy() if removed.is_valid else None)
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])


def _rewrite(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("substring_dedup")
        for b in batches:
            old, spans_of = b.column(text), b.column("_tessera_removed")
            new = old.to_pylist()
            for r in np.flatnonzero(spans_of.is_valid().to_numpy(zero_copy_only=False)):
                new[r] = b" ".join(kept_words(new[r], spans_of[r].values.to_numpy())[0]).decode()
            b = b.set_column(b.schema.get_field_index(text), text, pa.array(new, old.type))
            yield b.drop_columns(["_tessera_removed"])

    return run


def _removed(docs: DataFrame, key: str, text: str, window: int, broadcast_bytes: int) -> DataFrame:
    """(k1, k2, removed) of the texts with repeated windows; removed holds their spans."""
    rows = docs.select(*[v.alias(k) for k, v in common.row_keys(key, text).items()], F.col(text).alias("text"))
    found = repeats(rows, window, broadcast_bytes)
    return common.written(found.groupBy("k1", "k2").agg(F.collect_list("span").alias("removed")), "removed")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """key, n_words, n_removed, kept (the kept words joined by one space, UTF-8 bytes).

    A word goes if a window of `window` words covers it whose words also start elsewhere, in any document.
    """
    common.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    removed = _removed(docs, key, text, window, broadcast_bytes)
    rows = docs.select(*[v.alias(k) for k, v in common.row_keys(key, text).items()], F.col(key).alias("id"), F.col(text).alias("text"))
    out = rows.join(common.within(removed, 96, broadcast_bytes), ["k1", "k2"], "left").select("id", "text", "removed")
    out = out.mapInArrow(_keep, f"id {kind}, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """docs with the repeated windows' words taken out of the text; a text without any stays as it is."""
    common.ready(docs.sparkSession)
    removed = _removed(docs, key, text, window, broadcast_bytes).withColumnsRenamed({"k1": "_tessera_k1", "k2": "_tessera_k2", "removed": "_tessera_removed"})
    on = ["_tessera_k1", "_tessera_k2"]
    rows = docs.withColumns({f"_tessera_{k}": v for k, v in common.row_keys(key, text).items()})
    rows = rows.join(common.within(removed, 96, broadcast_bytes), on, "left").select(*docs.columns, "_tessera_removed")
    return rows.mapInArrow(_rewrite(text), docs.schema)
