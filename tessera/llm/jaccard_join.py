"""Jaccard similarity join on word shingles by chosen paths.

A document is the set of its runs of five words; equal sets are one node. Each set has a signature of
min-wise tokens. A run sends every set down a random tree: at each node the set follows each of its tokens
with probability 1 / (threshold * tokens), decided by a hash of path and token, so similar sets tend to take
the same paths. Small buckets are compared by brute force on signatures; large ones are split again, and what
is still large at the last level is compared block by block. Runs are repeated until a pair at the threshold
is met with the target probability.

Buckets give spanning edges, not pairs, between sets whose signatures may reach the threshold. In each
component of these edges the true shingle sets are then compared where their sizes allow a link, block by
block, and give every set's exact number of links and the links' components; a pair is never a row. Shingles
are compared by 64-bit hashes that mix every byte of their words.

A text with one to four words has one shingle, all its words. Null and wordless texts have no shingle and no
link, also not with each other. Copies (equal sets, repeated rows) link to each other and to all that links
to one of them. Ids may repeat and may be null. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .text import gram_hash, mix, steps, words

#: Tokens of a signature; bucket size for brute force; members of a block; levels of the tree; recall at the threshold.
TOKENS, SMALL, BLOCK, LEVELS, RECALL = 96, 64, 512, 3, 0.999
#: Members of a block where true sets are compared, and shingles that are compared at once.
EXACT_BLOCK, SPAN = 256, 4096
#: Shingles of a component that a block holds on average at most.
BLOCK_SHINGLES = 1 << 18
_rng = np.random.default_rng(7_301)
_MUL = (_rng.integers(1, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32)[:, None]


def runs_needed(levels: int = LEVELS, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold has met with probability `recall` at the last level.

    Such a pair has on average one common child at each node, a critical branching process.
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingles(column: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingle hashes, edges): each row's set, sorted."""
    for i, j, data, edges in steps(column):
        h, _, _, upto = words(data, edges)
        n = np.diff(upto)
        row = np.repeat(np.arange(j - i), n)
        if len(h) >= width:
            s = gram_hash(h, width)
            at = np.arange(len(s))
            full = at + width <= upto[row[: len(s)] + 1]
            s, srow = s[full], row[: len(s)][full]
        else:
            s, srow = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < width))
        extra = np.zeros(len(short), np.uint64)
        for x, r in enumerate(short):
            extra[x] = gram_hash(h[upto[r] : upto[r + 1]], int(n[r]))[0]
        s, srow = np.r_[s, extra], np.r_[srow, short]
        order = np.lexsort((s, srow))
        s, srow = s[order], srow[order]
        keep = np.r_[True, (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])] if len(s) else np.zeros(0, bool)
        s, srow = s[keep], srow[keep]
        yield i, j, s, np.searchsorted(srow, np.arange(j - i + 1))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("jaccard_join")
        for b in batches:
            for i, j, s, edge in shingles(b.column("text"), width):
                has = np.flatnonzero(np.diff(edge) > 0)
                n = np.diff(edge).astype(np.int64)
                sums = np.zeros((2, j - i), np.uint64)
                sig: list[bytes | None] = [None] * (j - i)
                low8: list[bytes | None] = [None] * (j - i)
                if len(has):
                    starts = edge[has]
                    sums[0, has] = np.add.reduceat(mix(s + np.uint64(0x51ED270B)), starts)
                    sums[1, has] = np.add.reduceat(mix(s ^ np.uint64(0x9FB21C651E98DF25)), starts)
                    low = (s >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((len(has), TOKENS), np.uint32)
                    for t in range(TOKENS):
                        v = low * _MUL[t] + _ADD[t]
                        v ^= v >> np.uint32(15)
                        least[:, t] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
                    for r, x in zip(has, least, strict=True):
                        sig[r] = x.tobytes()
                        low8[r] = (x * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()  # the least values' own high bits are zero
                cols = [b.column(c).slice(i, j - i) for c in ("k1", "k2", "id")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(n), pa.array(sig, pa.binary()), pa.array(low8, pa.binary())], ["k1", "k2", "id", "s1", "s2", "n", "sig", "short"])

    return run


def _hash(path: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Hash of every (path, place, token); path (n,), sig (n, TOKENS)."""
    place = np.arange(TOKENS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(path[:, None] * np.uint64(0xD6E8FEB86659FD93) + place + (sig.astype(np.uint64) << np.uint64(7)))


def _paths(threshold: float, runs: int = 0):
    """Children that each set goes to; runs > 0: from the roots of that many runs."""
    limit = np.uint64(int(2**64 / (threshold * TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("jaccard_join")
        for b in batches:
            if not b.num_rows:
                continue
            sid = b.column("sid").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)
            paths = [mix(np.full(len(sid), r + 1, np.uint64)) for r in range(runs)] if runs else [b.column("path").to_numpy(zero_copy_only=False).view(np.uint64)]
            for p in paths:
                h = _hash(p, sig)
                row, at = np.nonzero(h < limit)
                yield pa.RecordBatch.from_arrays([pa.array(mix(h[row, at] + np.uint64(1)).view(np.int64)), pa.array(sid[row])], ["path", "sid"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        cut = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            cut[1:] |= v[1:] != v[:-1]
        edge = np.r_[0, np.flatnonzero(cut)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            yield table.slice(s, e - s)
        held = table.slice(edge[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spread(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix, named by its first row."""
    n = len(near)
    root = np.full(n, -1)
    for v in range(n):
        if root[v] >= 0:
            continue
        root[v] = v
        front = np.array([v])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[front] = v
    return root


_BATCH = 4096


def _edges_out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in rows]).astype(np.int64)) for k in (0, 1)], ["a", "b"])


def _brute(least: float):
    """Spanning edges between sets of a bucket (and of its two blocks) whose signatures agree enough.

    A byte of each token is compared; that two tokens agree by chance in it only adds candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("jaccard_join")
        out, held = [], 0
        for g in _groups(batches, ["path", "i", "j"]):
            if g.num_rows < 2:
                continue
            sid = g.column("sid").to_numpy()
            sig = np.frombuffer(b"".join(g.column("short").to_pylist()), np.uint8).reshape(-1, TOKENS)
            # ordered by set: buckets of one group then agree on roots, and their edges fall together
            order = np.argsort(sid)
            sid, sig = sid[order], sig[order]
            if len(sid) == 2:
                near = (sig[0] == sig[1]).mean() >= least
                if near and sid[0] != sid[1]:
                    out.append((sid[:1], sid[1:]))
                    held += 1
            else:
                same = np.zeros((len(sid), len(sid)), np.uint8)
                for t in range(TOKENS):
                    same += sig[:, t, None] == sig[None, :, t]
                root = _spread(same >= least * TOKENS)
                linked = root != np.arange(len(sid))
                if linked.any():
                    out.append((sid[linked], sid[root[linked]]))
                    held += int(linked.sum())
            if held >= _BATCH:
                yield _edges_out(out)
                out, held = [], 0
        if held:
            yield _edges_out(out)

    return run


_GROUP = ["comp", "lo", "across", "i", "j"]


def _exact(threshold: float, width: int):
    """True links inside a block or between two: for each set its links (copies counted) and its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("jaccard_join")
        for g in _groups(batches, _GROUP):
            sid = g.column("sid").to_numpy()
            sid, first = np.unique(sid, return_index=True)
            if len(sid) < 2:
                continue
            g = g.take(pa.array(first))
            copies, part_of = g.column("copies").to_numpy(), g.column("part").to_numpy()
            sets: list[np.ndarray] = []
            for i, j, s, edge in shingles(g.column("text").combine_chunks(), width):
                sets += [s[edge[r] : edge[r + 1]] for r in range(j - i)]
            size = np.array([len(s) for s in sets], np.float64)
            value, name, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = n > 1
            place = np.cumsum(shared) - 1
            row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
            keep = shared[name]
            row, col = row[keep], place[name[keep]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            both = np.zeros((len(sets), len(sets)), np.float32)
            span = SPAN
            cuts = np.searchsorted(col, np.arange(0, int(shared.sum()) + span, span))
            for at, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if e > s:
                    part = np.zeros((len(sets), span), np.float32)
                    part[row[s:e], col[s:e] - at * span] = 1
                    both += part @ part.T
            inter = both.astype(np.float64)
            near = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            np.fill_diagonal(near, False)
            if g.column("across")[0].as_py() or g.column("i")[0].as_py() != g.column("j")[0].as_py():
                near &= part_of[:, None] != part_of[None, :]
            links = near @ copies.astype(np.int64)
            some = links > 0
            if some.any():
                root = _spread(near)
                yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(links[some].astype(np.int64)), pa.array(sid[root[some]])], ["sid", "links", "root"])

    return run


def _block(n: str):
    """The block, of as many as column n says, that a set is in."""
    return F.pmod(F.xxhash64("sid", F.lit(11)), F.col(n)).cast("int")


def _places(n: str):
    return F.when(F.col(n) > 0, F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Deals each bucket's rows into nb blocks by their hash, and each pair of blocks into one group (path, i, j)."""
    rows = rows.withColumn("blk", _block("nb")).withColumn("o", F.explode(_places("nb")))
    return rows.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "nb")


def _bands(member: DataFrame, threshold: float, broadcast_bytes: int) -> DataFrame:
    """member with its size band, and the blocks of that band, of the next and of the one below in its component.

    Sets as similar as the threshold differ in size by a factor of at most 1 / threshold, a little less than a band is
    wide: they are in one band or in two that follow each other.
    """
    member = member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.04 / threshold)).cast("int"))
    blocks = F.greatest(F.ceil(F.count("*") / EXACT_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    total = common.written(member.groupBy("comp", "band").agg(blocks.alias("nb")), "bands")
    near = [total.select("comp", (F.col("band") + d).alias("band"), F.col("nb").alias(c)) for d, c in ((-1, "up"), (1, "down"))]
    total = total.join(near[0], ["comp", "band"], "left").join(near[1], ["comp", "band"], "left").fillna(0, ["up", "down"])
    total = common.written(total, "total")
    return member.join(common.within(total, 48, broadcast_bytes), ["comp", "band"])


def _band_blocks(rows: DataFrame) -> DataFrame:
    """Deals rows into groups (comp, lo, across, i, j): pairs of blocks of a band, and of a band and the next; `part` tells the two apart."""
    blk = F.col("blk")
    group = lambda lo, across, i, j, part: F.struct(lo.alias("lo"), F.lit(across).alias("across"), i.alias("i"), j.alias("j"), part.alias("part"))
    groups = F.concat(
        F.transform(_places("nb"), lambda o: group(F.col("band"), 0, F.least(blk, o), F.greatest(blk, o), blk)),
        F.transform(_places("up"), lambda o: group(F.col("band"), 1, blk, o, F.lit(0))),
        F.transform(_places("down"), lambda o: group(F.col("band") - 1, 1, o, blk, F.lit(1))),
    )
    return rows.withColumn("blk", _block("nb")).withColumn("g", F.explode(groups)).select("comp", "g.*", "sid", "copies", "text")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def candidate_edges(sets: DataFrame, threshold: float, broadcast_bytes: int) -> DataFrame:
    """Spanning edges (a, b) of the buckets that sets(sid, sig) fall into."""
    least = threshold - 3.7 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    runs = runs_needed()
    rows = common.written(sets.select("sid", "sig").mapInArrow(_paths(threshold, runs), "path long, sid long"), "paths")
    found = []
    for level in range(1, LEVELS + 1):
        size = common.written(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
        met = common.written(rows.join(common.within(size, 24, broadcast_bytes), "path"), "met")
        final = met if level == LEVELS else met.filter(F.col("size") <= SMALL)
        big = met.filter(F.col("size") > SMALL)
        with_sig = final.join(sets.select("sid", "short"), "sid").withColumn("nb", F.ceil(F.col("size") / BLOCK))
        dealt = _dealt(_blocks(with_sig.select("path", "sid", "short", "nb")), ["path", "i", "j"])
        found.append(common.written(dealt.select("path", "i", "j", "sid", "short").mapInArrow(_brute(least), "a long, b long").distinct(), "found"))
        if level == LEVELS or big.isEmpty():
            break
        rows = common.written(big.select("path", "sid").join(sets.select("sid", "sig"), "sid").select("path", "sid", "sig").mapInArrow(_paths(threshold), "path long, sid long"), "paths")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _classes(docs: DataFrame, key: str, text: str, threshold: float, width: int, broadcast_bytes: int) -> DataFrame:
    common.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(*[v.alias(k) for k, v in common.row_keys(key, text).items()], F.col(key).alias("id"), F.col(text).alias("text"))
    signed = rows.mapInArrow(_sign(width), f"k1 long, k2 int, id {kind}, s1 long, s2 long, n long, sig binary, short binary")
    signed = common.written(signed.withColumn("sid", F.when(F.col("n") > 0, F.xxhash64("s1", "s2", "n"))), "signed")
    one = F.min(F.struct("k1", "k2")).alias("one")
    sets = signed.filter("n > 0").groupBy("sid").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"), one)
    sets = common.written(sets, "sets")
    maybe = components(candidate_edges(sets, threshold, broadcast_bytes), broadcast_bytes)
    member = sets.join(common.within(maybe.withColumnRenamed("node", "sid"), 32, broadcast_bytes), "sid").select("sid", "comp", "copies", "n", "one.k1", "one.k2")
    member = common.written(member, "member")
    member = common.written(_bands(member, threshold, broadcast_bytes), "members")
    texts = rows.select("k1", "k2", "text").join(common.within(member, 96, broadcast_bytes), ["k1", "k2"])
    dealt = _dealt(_band_blocks(texts), _GROUP)
    linked = common.written(dealt.mapInArrow(_exact(threshold, width), "sid long, links long, root long"), "linked")
    comp = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")), broadcast_bytes)
    links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    own = sets.select("sid", "copies", "least").join(links, "sid", "left").join(comp.withColumnRenamed("node", "sid"), "sid", "left")
    own = own.filter("copies > 1 or links is not null").withColumn("comp", F.coalesce("comp", "sid"))
    own = common.written(own, "own")
    names = common.written(own.groupBy("comp").agg(F.min("least").alias("class_id")), "names")
    own = own.join(common.within(names, 32, broadcast_bytes), "comp").select("sid", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = common.written(own, "classes")
    out = signed.select("k1", "k2", "id", "sid").join(common.within(own, 48, broadcast_bytes), "sid", "left")
    return out.select("k1", "k2", F.col("id").alias(key), F.when(F.col("copies").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """One row per document: key, class_id, n_links, copies.

    class_id is the smallest key of the component of links that the document is in (its own key if it has no
    link), n_links the number of other documents with a similarity of the threshold or more, copies those of
    them (itself included) with the same shingles.
    """
    return _classes(docs, key, text, threshold, width, broadcast_bytes).drop("k1", "k2")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """docs with one document of each class, that of the smallest key; all columns stay."""
    linked = _classes(docs, key, text, threshold, width, broadcast_bytes).filter("n_links > 0").withColumnRenamed(key, "id")
    linked = common.written(linked.select("k1", "k2", "id", "class_id"), "linked")
    first = common.written(linked.groupBy("class_id").agg(F.min(F.struct("id", "k1", "k2")).alias("first")), "first")
    kept = F.struct("id", "k1", "k2").eqNullSafe(F.col("first"))
    verdicts = linked.join(common.within(first, 48, broadcast_bytes), "class_id").select("k1", "k2", kept.alias("kept"))
    return common.without(docs, verdicts, key, text, broadcast_bytes)
