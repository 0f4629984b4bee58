"""Exact BM25 top-k search over a sharded inverted index by block-max WAND.

Index: each shard holds a bounded number of documents, ordered so that like ones are neighbours, its words, and for
each word its postings (document, frequency) in blocks of 64 documents.

Search: every word of a query has a cursor in its list of blocks. The cursors are sorted by the block they stand at,
and the lists' largest impacts, times the words' weights, are added up in that order; where the sum first reaches the
threshold (the k-th best score so far) is the pivot, and no document before it can be among the best: all cursors
seek it. Of the STRETCH blocks from the pivot on, those are scored whose words' block maxima reach the threshold, the
others are skipped, and the cursors move on. Postings of skipped blocks aren't read; a shard whose lists can't
reach the threshold isn't entered. Words that are in every block anyway have no cursor: a matrix holds their impacts,
their share of the scores is a product with it for many queries at once, and counts in full in the bounds.

A shard is searched region by region, a region being documents with the same most frequent word. For many queries at once
the matrix and the other words' postings give a limit for each document, from above; only queries with a limit that
reaches the threshold are searched, and in the blocks with such limits only.

The threshold starts from a lower bound: for each query the most promising blocks of a few shards are scored first,
and the k-th best of these documents' scores is what the search of every shard begins with. Weights come from
statistics of the whole corpus, so the shards' best lists merge exactly. Words are compared by their bytes.

Words are runs of letters, ASCII capitals made small. Null and wordless texts are found by no query and, as
queries, find nothing. Ties go to the smaller document id. Repeated rows are documents and queries of their
own, equal query rows count once. Null ids are no queries and are found with a null id. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .text import letters_map, mix, ranges

K1, B = 1.2, 0.75
#: Documents and text bytes of a shard; documents of a block (a power of two) and blocks of a stretch.
SHARD_DOCS, SHARD_BYTES, BLOCK_BITS, STRETCH = 4096, 16 << 20, 6, 64
#: A word in one of so many documents of a shard, or more, is a row of its matrix; queries whose products are made at once.
DENSE, AT_ONCE = 32, 128
#: Documents with the same most frequent word are a region if they are one in so many of a shard, or more.
REGIONS = 10
#: Postings, about, whose impacts are added up at once for the documents' limits; words whose block maxima are.
POSTINGS, WORDS = 1 << 16, 1 << 16
#: Blocks whose largest impacts are taken together to leave out queries before anything of theirs is read.
GROUP = 2
#: Where one in so many blocks of a stretch is to be scored, or more, its postings are read through.
MANY = 8
#: Queries, and bytes of their words, that are searched at once; shards and blocks that give the first threshold.
QUERIES, QUERY_BYTES, TRIED_SHARDS, TRIED_BLOCKS = 8192, 32 << 20, 4, 8
#: Of many shards, such a share gives the first threshold.
TRIED_SHARE = 1 / 24
_TABLE = letters_map().tobytes()
_NULL = np.iinfo(np.int64).min
_COLUMNS = ["docs", "lengths", "words", "starts", "posting_doc", "posting_tf", "regions"]
#: Bounds are raised by this share, more than what adding up in another order can change.
_SLACK = 1 + 1e-9


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    place_of: defaultdict[bytes, int] = defaultdict()
    place_of.default_factory = place_of.__len__
    docs, terms = [], []
    for b in parts:
        docs.append(b.column(0).fill_null(int(_NULL)).to_numpy(zero_copy_only=False).astype(np.int64))
        for text in b.column(1).to_pylist():
            own = split(text)
            terms.append(np.fromiter(map(place_of.__getitem__, own), np.int32, len(own)))
    ids, n = np.concatenate(docs), len(terms)
    length = np.array([len(t) for t in terms])
    key = np.concatenate(terms).astype(np.int64) * n + np.repeat(np.arange(n), length)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // n, key % n
    # neighbours are documents with the same most frequent word (often: the same language), by length; words that are the
    # most frequent one of many documents make regions, other documents go to the region whose word they have most often
    top = np.minimum(tf, (1 << 30) - 1) << 32 | term
    kind = np.zeros(n, np.int64)
    np.maximum.at(kind, doc, top)
    kind &= 0xFFFFFFFF
    often = np.isin(term, np.flatnonzero(np.bincount(kind, minlength=1) * REGIONS >= max(n, 1)))
    region = np.zeros(n, np.int64)
    np.maximum.at(region, doc[often], top[often] + 1)
    region &= 0xFFFFFFFF
    order = np.lexsort((length, np.where(region > 0, 0, kind), region))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.argsort(term * n + place[doc])
    starts = np.searchsorted(term, np.arange(len(place_of) + 1))
    regions = np.flatnonzero(np.diff(region[order], prepend=-1)).astype(np.int32)
    values = [ids[order], length[order].astype(np.int32), None, starts.astype(np.int32), place[doc][by].astype(np.uint16), tf[by].astype(np.uint32), regions]
    cells = [b" ".join(place_of) if v is None else v.tobytes() for v in values]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells] + [pa.array([n], pa.int64()), pa.array([int(length.sum())], pa.int64())], [*_COLUMNS, "n", "total"])


def _build(shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("topk_search")
        parts, n, size = [], 0, 0
        step = min(256, shard_docs)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                parts.append(part)
                n += part.num_rows
                size += part.column(1).nbytes
                if n + step > shard_docs or size >= SHARD_BYTES:
                    yield _shard(parts)
                    parts, n, size = [], 0, 0
        if parts:
            yield _shard(parts)

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a shard of at most shard_docs (65536 or fewer) documents, written to the shared folder."""
    common.ready(docs.sparkSession)
    types = ", ".join(f"{c} binary" for c in _COLUMNS)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_build(shard_docs), f"{types}, n long, total long")
    return common.written(out.withColumn("shard", F.monotonically_increasing_id()), "index")


def _numbers(words: list[bytes], asked: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(asked.get, words, repeat(-1)), np.int64, len(words))


def _split(row: dict, asked: dict[bytes, int]) -> Iterator[dict]:
    """A row of the index as one for each region, with the words asked for only, by their numbers."""
    read = lambda c, t: np.frombuffer(row[c], t)
    words = row["words"].split(b" ") if row["words"] else []
    numbers = _numbers(words, asked)
    held = np.flatnonzero(numbers >= 0)
    docs, lengths, starts = read("docs", np.int64), read("lengths", np.int32), read("starts", np.int32).astype(np.int64)
    p, size = ranges(starts[held], starts[held + 1]), starts[held + 1] - starts[held]
    word, doc, tf = np.repeat(held, size), read("posting_doc", np.uint16)[p], read("posting_tf", np.uint32)[p]
    first = read("regions", np.int32)
    of = np.searchsorted(first, np.arange(len(docs)), side="right").astype(np.int16)[doc]
    for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(docs)], strict=True)):
        at = np.flatnonzero(of == i + 1)
        new = np.flatnonzero(np.diff(word[at], prepend=-1))
        values = {"docs": docs[a:b], "lengths": lengths[a:b], "starts": np.r_[new, len(at)].astype(np.int32), "posting_doc": (doc[at] - a).astype(np.uint16), "posting_tf": tf[at]}
        yield {c: v.tobytes() for c, v in values.items()} | {"numbers": numbers[word[at[new]]]}


class Shard:
    """A shard, or a region of one, in memory: impacts of postings, and for each word the blocks it is in with their largest impact.

    Words in one of DENSE documents or more are in most blocks, so a cursor could skip little in their lists: these
    are rows of a matrix, and the part of the scores that is theirs is a product with it, for many queries at once.
    """

    def __init__(self, row: dict, mean: float, asked: dict[bytes, int] | None = None):
        """asked: the words to be held, numbered; all if None. A row with numbers holds these only, and has no words."""
        read = lambda c, t: np.frombuffer(row[c], t)
        words = row["words"].split(b" ") if row.get("words") else []
        self.docs, lengths = read("docs", np.int64), read("lengths", np.int32)
        starts, self.doc, tf = read("starts", np.int32).astype(np.int64), read("posting_doc", np.uint16), read("posting_tf", np.uint32)
        if "numbers" in row:
            self.numbers = row["numbers"]
        elif asked is not None:
            numbers = _numbers(words, asked)
            held = np.flatnonzero(numbers >= 0)
            self.numbers, words = numbers[held], [words[i] for i in held.tolist()]
            p = ranges(starts[held], starts[held + 1])
            starts, self.doc, tf = np.r_[0, np.cumsum(starts[held + 1] - starts[held])], self.doc[p], tf[p]
        self.place_of = {w: i for i, w in enumerate(words)}
        self.doc = self.doc.astype(np.int64)
        room = K1 * (1 - B + B * lengths / mean)
        self.impact = tf * (K1 + 1) / (tf + room[self.doc])
        n, docs = len(starts) - 1, len(self.docs)
        self.blocks = -(-docs // (1 << BLOCK_BITS))
        place = np.repeat(np.arange(n), np.diff(starts))
        at = place * self.blocks + (self.doc >> BLOCK_BITS)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.entry = at[first]  # (word, block), ascending
        self.entry_block = np.r_[self.entry % max(1, self.blocks), self.blocks]
        self.entry_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.entry_post = np.r_[first, len(at)]  # the entry's first posting
        self.entry_of = np.searchsorted(self.entry, np.arange(n + 1) * self.blocks)  # the word's first entry
        # the same as matrices, a line for each word: the blocks' largest impacts, and the entries (-1: none)
        self.block_max = np.zeros((n, self.blocks))
        self.block_max.ravel()[self.entry] = self.entry_max
        # the largest impacts in GROUP blocks each, the last line for words that aren't here (-1)
        self.group_max = np.zeros((n + 1, -(-self.blocks // GROUP)), np.float32)
        if n and self.blocks:
            self.group_max[:n] = np.maximum.reduceat(self.block_max, np.arange(0, self.blocks, GROUP), axis=1)
        self.entry_at = np.full((n, self.blocks), -1, np.int32)
        self.entry_at.ravel()[self.entry] = np.arange(len(self.entry))
        self.list_post = starts  # the word's first posting
        self.list_max = np.maximum.reduceat(self.entry_max, self.entry_of[:-1]) if n else np.zeros(0)
        many = np.flatnonzero(np.diff(starts) * DENSE >= docs)
        self.row_of = np.full(n, -1)
        self.row_of[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), self.blocks << BLOCK_BITS))
        held = self.row_of[place] >= 0
        self.dense[self.row_of[place[held]], self.doc[held]] = self.impact[held]
        self.dense32 = self.dense.astype(np.float32)
        # sums of products that aren't negative: what rounding can change, as a share
        self.loose = 1 + (len(many) + 16) * 2.0**-23
        self.scored = 0

    def query(self, at: np.ndarray, weight: np.ndarray) -> Query | None:
        """The query whose words stand at these places (-1: not in this shard), in an order that is the same for all shards."""
        row = np.where(at >= 0, self.row_of[at], -1)
        many, few = np.flatnonzero(row >= 0), np.flatnonzero((at >= 0) & (row < 0))
        return Query(weight, many, row[many], few, at[few]) if len(many) or len(few) else None

    def product(self, queries: list[Query]) -> np.ndarray:
        """The most that the words of the matrix give to every document, a line for each query; in single precision."""
        weights = np.zeros((len(queries), len(self.dense)), np.float32)
        for line, q in zip(weights, queries, strict=True):
            line[q.rows] = q.weight[q.many]
        return self._times(weights)

    def _times(self, weights: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(weights.any(axis=0))
        out = weights[:, used] @ self.dense32[used] if 2 * len(used) < len(self.dense) else weights @ self.dense32
        out *= np.float32(self.loose)
        return out

    def limits(self, at: np.ndarray, weight: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the matrix gives, and the most that a document of each block can score, a line for each query.

        The queries' words (their places, -1: not here) and weights stand end to end, `size` of each query.
        """
        line, row = np.repeat(np.arange(len(size)), size), np.where(at >= 0, self.row_of[at], -1)
        many, few = np.flatnonzero(row >= 0), np.flatnonzero((at >= 0) & (row < 0))
        weights = np.zeros((len(size), len(self.dense)), np.float32)
        weights[line[many], row[many]] = weight[many]
        base = self._times(weights)
        out, width = np.empty((len(size), self.blocks)), base.shape[1]
        line, weight, start, end = line[few], weight[few], self.list_post[at[few]], self.list_post[at[few] + 1]
        count = np.bincount(line, end - start, len(size))
        piece = (count.cumsum() // POSTINGS).astype(np.int64)
        for a in np.flatnonzero(np.diff(piece, prepend=-1)).tolist():
            b = int(np.searchsorted(piece, piece[a], side="right"))
            i, j = np.searchsorted(line, (a, b))
            p, n = ranges(start[i:j], end[i:j]), end[i:j] - start[i:j]
            score = base[a:b]
            if len(p):
                score = score + np.bincount(np.repeat((line[i:j] - a) * width, n) + self.doc[p], np.repeat(weight[i:j], n) * self.impact[p], (b - a) * width).reshape(b - a, width)
            out[a:b] = score.reshape(b - a, self.blocks, -1).max(axis=2)
        return base, out * _SLACK

    def _runs(self, q: Query, first: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings (from, to) of the words with cursors in the good blocks from block `first` on, word by word, and their words."""
        e = self.entry_at[q.places, first : first + len(good)][:, good]
        some = e >= 0
        entries, word = e[some], np.repeat(q.few, some.sum(axis=1))
        if not len(entries):
            return entries, entries, word
        # entries that follow each other are one run
        last = np.flatnonzero((entries[1:] != entries[:-1] + 1) | (word[1:] != word[:-1]))
        new, last = np.concatenate(([0], last + 1)), np.concatenate((last, [len(entries) - 1]))
        return self.entry_post[entries[new]], self.entry_post[entries[last] + 1], word[new]

    def _score(self, q: Query, score: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, first: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, and their equals, that reach `least`, from document `first` on.

        score: what the matrix gives; start, end, word: runs of postings of the words with cursors, word by word. Scores
        are added up word by word in the query's order, so that equal documents have equal scores in all shards.
        """
        p, size = ranges(start, end), end - start
        doc, impact = self.doc[p], self.impact[p]
        if first:
            doc = doc - first
        self.scored += len(p)
        if len(p):
            score = score + np.bincount(doc, np.repeat(q.weight[word], size) * impact, len(score))
        most = score.max()
        if most <= 0 or most * _SLACK < least:
            return np.zeros(0, np.int64), np.zeros(0)
        hit = np.flatnonzero((score * _SLACK >= least) & (score > 0))
        if len(hit) > k:
            own = score[hit]
            hit = hit[own * (_SLACK * self.loose**2) >= np.partition(own, len(own) - k)[len(own) - k]]
        parts = np.zeros((len(q.weight), len(hit)))
        parts[q.many] = self.dense[np.ix_(q.rows, first + hit)]
        column = np.full(len(score), -1)
        column[hit] = np.arange(len(hit))
        at = column[doc]
        some = np.flatnonzero(at >= 0)
        parts[np.repeat(word, size)[some], at[some]] = impact[some]
        exact = (parts * q.weight[:, None]).cumsum(axis=0)[-1]
        ok = (exact >= least) & (exact > 0)
        return first + hit[ok], exact[ok]

    def glance(self, q: Query, base: np.ndarray, k: int, limit: np.ndarray | None = None) -> np.ndarray:
        """The k best scores in the TRIED_BLOCKS blocks with the largest limits, where given, or else bounds."""
        bound = limit if limit is not None else base.reshape(self.blocks, -1).max(axis=1) + q.weight[q.few] @ self.block_max.take(q.places, axis=0)
        tried = np.zeros(self.blocks, bool)
        tried[np.argsort(-bound)[:TRIED_BLOCKS]] = True
        held = np.where(np.repeat(tried, 1 << BLOCK_BITS), base, 0.0)
        return np.sort(self._score(q, held, *self._runs(q, 0, tried), 0, k, 0.0)[1])[::-1][:k]

    def search(self, q: Query, base: np.ndarray, k: int, least: float, best: tuple[np.ndarray, np.ndarray], limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merges this shard's documents with scores of `least` or more into best = (scores, ids).

        limit: the most that a document of each block can score, where that is known better than from the block maxima.
        """
        if len(best[0]) == k:
            least = max(least, best[0][-1])
        room = base.reshape(self.blocks, -1).max(axis=1) * _SLACK  # the most that the matrix gives in each block
        rest = np.maximum.accumulate(room[::-1])[::-1]  # and from it on
        top = q.weight[q.few] * self.list_max[q.places] * _SLACK
        if rest[0] + top.sum() < least:
            return best
        first, end = q.places * self.blocks, self.entry_of[q.places + 1]
        cursor = self.entry_of[q.places]
        block = self.entry_block[cursor]
        done = 0
        while done < self.blocks:
            # the pivot: the first block whose lists so far, and the matrix from here on, can reach the threshold
            pivot = done
            if rest[done] < least:
                order = block.argsort(kind="stable")
                i = int(np.searchsorted(top[order].cumsum(), least - rest[done]))
                if i == len(order) or (pivot := max(done, int(block[order[i]]))) >= self.blocks:
                    return best
            till = min(pivot + STRETCH, self.blocks)
            if pivot > done:
                cursor = np.maximum(cursor, np.searchsorted(self.entry, first + pivot))
            after = np.searchsorted(self.entry, first + till) if till < self.blocks else end
            if limit is None:
                good = room[pivot:till] + (q.weight[q.few] @ self.block_max.take(q.places, axis=0)[:, pivot:till]) * _SLACK >= least
            else:
                good = limit[pivot:till] >= least
            if good.any():
                # many good blocks: runs through all of the stretch cost less than leaving out the other blocks' postings,
                # whose documents can't reach the threshold in any case
                runs = (self.entry_post[cursor], self.entry_post[np.maximum(cursor, after)], q.few) if np.count_nonzero(good) * MANY >= len(good) else self._runs(q, pivot, good)
                found, score = self._score(q, base[pivot << BLOCK_BITS : till << BLOCK_BITS], *runs, pivot << BLOCK_BITS, k, least)
                if len(found):
                    scores, ids = np.concatenate((best[0], score)), np.concatenate((best[1], self.docs[found]))
                    order = np.lexsort((ids, -scores))[:k]
                    best = scores[order], ids[order]
                    if len(order) == k:
                        least = max(least, best[0][-1])
            cursor, done = after, till
            block = np.where(cursor < end, self.entry_block[cursor], self.blocks)
        return best


@dataclass(frozen=True)
class Query:
    """A query in a shard: its words' weights; which are rows of the matrix, and which have cursors, at what places."""

    weight: np.ndarray
    many: np.ndarray
    rows: np.ndarray
    few: np.ndarray
    places: np.ndarray


class Bounds:
    """Queries' words and weights end to end, for the most that each query can score in a shard."""

    def __init__(self, queries: list):
        self.places = np.concatenate([p for p, _ in queries]).astype(np.int32) if queries else np.zeros(0, np.int32)
        self.weights = np.concatenate([w for _, w in queries]) if queries else np.zeros(0)
        self.starts = np.r_[0, np.cumsum([len(p) for p, _ in queries])][: len(queries)].astype(np.int64)

    def most(self, shard: Shard, names_at: np.ndarray) -> np.ndarray:
        top = np.where(names_at >= 0, shard.list_max[names_at], 0.0)
        return np.add.reduceat(self.weights * top[self.places], self.starts) * _SLACK if len(self.starts) else np.zeros(0)


def _many(shard: Shard, names_at: np.ndarray, queries: list) -> Iterator[tuple[int, Query, np.ndarray]]:
    """(number, query, product) of the numbered queries that have a word in the shard, AT_ONCE products at a time."""
    for first in range(0, len(queries), AT_ONCE):
        part = [(number, shard.query(names_at[places], weight)) for number, places, weight in queries[first : first + AT_ONCE]]
        part = [x for x in part if x[1] is not None]
        yield from ((number, q, base) for (number, q), base in zip(part, shard.product([q for _, q in part]), strict=True))


def _reaching(shard: Shard, names_at: np.ndarray, queries: list, numbers: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, places and weights of words end to end, and how many each has, of about AT_ONCE queries whose groups' maxima
    reach what they need in some group."""
    if not len(numbers):
        return
    size = np.array([len(queries[q][0]) for q in numbers.tolist()], np.int64)
    piece = np.maximum(np.arange(len(size)) // AT_ONCE, size.cumsum() // WORDS)
    kept: list = []
    starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
        own, n = [queries[q] for q in numbers[a:b].tolist()], size[a:b]
        at, weight = names_at[np.concatenate([p for p, _ in own])], np.concatenate([w for _, w in own])
        most = np.add.reduceat(weight.astype(np.float32)[:, None] * shard.group_max[at], n.cumsum() - n).max(axis=1)
        ok = most * (1 + (n + 16) * 2.0**-23) >= need[numbers[a:b]]
        held = np.repeat(ok, n)
        kept.append((numbers[a:b][ok], at[held], weight[held], n[ok]))
        if sum(len(x[0]) for x in kept) >= AT_ONCE or sum(len(x[1]) for x in kept) >= WORDS or b == len(size):
            if any(len(x[0]) for x in kept):
                yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
            kept = []


def _shards(batches: Iterator[pa.RecordBatch], mean: float, names: list[bytes]) -> Iterator[tuple[int, Shard, np.ndarray]]:
    """Number of the shard, each region of it with the words that are named, and the place of each name in it (-1: none)."""
    asked = {w: i for i, w in enumerate(names)}
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            for part in _split(row, asked):
                shard = Shard(part, mean)
                if len(shard.numbers):
                    names_at = np.full(len(names), -1)
                    names_at[shard.numbers] = np.arange(len(shard.numbers))
                    yield row["shard"], shard, names_at
                del shard  # before the next one is read
            del row, part


def _frequencies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        total, asked = np.zeros(len(names), np.int64), {w: i for i, w in enumerate(names)}
        for b in batches:
            for row in b.to_pylist():
                numbers = _numbers(row["words"].split(b" ") if row["words"] else [], asked)
                held = np.flatnonzero(numbers >= 0)
                total[numbers[held]] += np.diff(np.frombuffer(row["starts"], np.int32))[held]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "df"])

    return run


def _first_scores(sent, mean: float, k: int, shards: int):
    """Scores from the most promising blocks of about TRIED_SHARDS shards, or TRIED_SHARE of them, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("topk_search")
        names, queries = sent.value
        share = np.uint64(min(1.0, max(TRIED_SHARDS / shards, TRIED_SHARE)) * (2**64 - 2**12))
        bounds, own = Bounds(queries), np.zeros(len(queries))  # own: the best k-th scores so far
        for number, shard, names_at in _shards(batches, mean, names):
            chosen = np.flatnonzero(mix(np.arange(len(queries), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)) <= share)
            chosen = chosen[bounds.most(shard, names_at)[chosen] > own[chosen]] if len(chosen) else chosen
            q, score = [np.zeros(0, np.int32)], [np.zeros(0)]
            for numbers, at, weight, size in _reaching(shard, names_at, queries, chosen, own):
                bases, limits = shard.limits(at, weight, size)
                for n in np.flatnonzero(limits.max(axis=1) >= own[numbers]).tolist():
                    i = int(numbers[n])
                    query = shard.query(names_at[queries[i][0]], queries[i][1])
                    if query is not None:
                        score.append(shard.glance(query, bases[n], k, limits[n]))
                        if len(score[-1]) == k:
                            own[i] = max(own[i], score[-1][-1])
                        q.append(np.full(len(score[-1]), i, np.int32))
            del shard
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(score))], ["q", "score"])

    return run


def _search(sent, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("topk_search")
        names, queries, least = sent.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        bounds, need = Bounds(queries), least.copy()
        for _, shard, names_at in _shards(batches, mean, names):
            most = bounds.most(shard, names_at)
            for numbers, at, weight, size in _reaching(shard, names_at, queries, np.flatnonzero((most >= need) & (most > 0)), need):
                bases, limits = shard.limits(at, weight, size)
                for i in np.flatnonzero(limits.max(axis=1) >= need[numbers]).tolist():
                    q = int(numbers[i])
                    query = shard.query(names_at[queries[q][0]], queries[q][1])
                    best[q] = best[q] if query is None else shard.search(query, bases[i], k, need[q], best[q], limits[i])
                    if len(best[q][0]) == k:
                        need[q] = max(need[q], best[q][0][-1])
            del shard
        if queries:
            q = np.repeat(np.arange(len(queries), dtype=np.int32), [len(s) for s, _ in best])
            found = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found, mask=found == _NULL), pa.array(np.concatenate([s for s, _ in best]))], ["q", "doc_id", "score"])

    return run


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [sorted(Counter(split(t)).items()) for t in b.column(1).to_pylist()]
        words = [b" ".join(w for w, _ in bag) for bag in bags]
        tf = [np.array([n for _, n in bag], np.uint32).tobytes() for bag in bags]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(tf, pa.binary())], ["query_id", "words", "tf"])


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", at_once: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), doc_id, score of the k best documents of every query.

    Queries are searched in blocks of about `at_once` and QUERY_BYTES bytes of words, each block sent to every task; a
    block's words, not the corpus's, are what the driver holds. Queries with equal words are searched once.
    """
    spark = index.sparkSession
    common.ready(spark)
    n, total, shards = index.agg(F.sum("n"), F.sum("total"), F.count("*")).first()
    mean = max(1e-9, (total or 0) / max(1, n or 0))
    rows = queries.select(F.col(key).cast("long").alias("query_id"), F.col(text).alias("text")).filter("query_id is not null").distinct()
    rows = common.written(rows.mapInArrow(_query_rows, "query_id long, words binary, tf binary").withColumn("bag", F.sha2(F.concat("words", F.lit(b"\n"), "tf"), 256)), "queries")
    asked = common.written(rows.filter("octet_length(words) > 0").groupBy("bag").agg(F.first("words").alias("words"), F.first("tf").alias("tf")), "bags")
    count, size = asked.agg(F.count("*"), F.sum(F.octet_length("words"))).first()
    blocks = max(1, math.ceil(count / at_once), math.ceil((size or 0) / QUERY_BYTES))
    found = []
    for block in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("bag"), F.lit(blocks)) == block).orderBy("bag").collect()
        if not got:
            continue
        bags = [bytes(r["words"]).split(b" ") for r in got]
        # neighbours, whose products are made together, have the same most frequent word
        kind = [bag[int(np.frombuffer(bytes(r["tf"]), np.uint32).argmax())] for r, bag in zip(got, bags, strict=True)]
        order = sorted(range(len(got)), key=kind.__getitem__)
        got, bags = [got[i] for i in order], [bags[i] for i in order]
        names = sorted(set().union(*bags))
        place = {w: i for i, w in enumerate(names)}
        df = np.zeros(len(names), np.int64)
        for r in index.select("words", "starts").mapInArrow(_frequencies(spark.sparkContext.broadcast(names)), "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
            df[r["place"]] = r["df"]
        idf = np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5))
        terms = []
        for r, bag in zip(got, bags, strict=True):
            places = np.array([place[w] for w in bag], np.int32)
            terms.append((places, np.frombuffer(bytes(r["tf"]), np.uint32) * idf[places]))
        first = index.mapInArrow(_first_scores(spark.sparkContext.broadcast((names, terms)), mean, k, shards), "q int, score double")
        least = np.zeros(len(terms))
        for r in first.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best")).filter(F.size("best") >= k).select("q", F.col("best")[k - 1].alias("least")).collect():
            least[r["q"]] = r["least"] / _SLACK
        best = index.mapInArrow(_search(spark.sparkContext.broadcast((names, terms, least)), mean, k), "q int, doc_id long, score double")
        known = spark.createDataFrame([(q, r["bag"]) for q, r in enumerate(got)], "q int, bag string")  # as many as queries are sent at once
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(best.join(F.broadcast(known), "q").select("bag", F.col("rank").cast("long").alias("rank"), "doc_id", "score"))
    if not found:
        return rows.select("query_id", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return rows.select("query_id", "bag").join(out, "bag").select("query_id", "rank", "doc_id", "score")
