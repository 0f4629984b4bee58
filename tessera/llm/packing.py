"""Online sum-of-squares packing of documents into sequences of fixed length.

Each task keeps a level array: how many open sequences are filled to each level. A document goes to the
level (or a new sequence) that makes the sum of the squared counts smallest; a full sequence is written and
leaves the array. What a document has beyond whole sequences is the piece that is placed; whole sequences
need no placing. Only at the end of a task the sequences still open are emptied into one another, pieces cut
where needed, and the last one is cut into sequences whose lengths are powers of two, which need no padding.
The open sequences are all that a task holds: a few hundred for mixed lengths, its input partition at the most.

Null texts count as empty and have the end token only. Repeated rows and ids are packed each for itself. An
empty table gives an empty result. Extra columns are ignored. A task depends on its input partition alone,
so it can be run again after a loss; sequence ids hold the partition's number above bit 32.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose ids a worker keeps in each of two generations.
KEPT = 300_000
_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Control characters that are white space to some libraries only.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Ids(dict):
    """Ids of words; a new word's come from an older generation or are learned."""

    def __init__(self, learn, older: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.older = learn, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids


class Words:
    """Ids of texts by a tokenizer that composes (NFC), makes letters small, drops white space and never looks across it.

    A text is made small as a whole and split at white space; each word that differs is taken apart as the tokenizer
    does, and its parts go to the tokenizer's model. What can't be settled so (texts that aren't composed or that hold a
    capital sigma, control strings) goes through the whole tokenizer, word by word.
    """

    #: What the tokenizer splits a word at.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = regex.compile(self.PARTS)
        self.letters = _byte_letters()
        self.kept = _Ids(self._learn, {})

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(part)]).tobytes()

    def _learn(self, word: bytes) -> bytes:
        """The ids of a word that is small and composed already."""
        text = word.decode()
        if text.isalpha():
            return self._part(text)
        if text[-1] in ".," and text[:-1].isalpha():  # a word before a comma or full stop
            return self.kept[word[:-1]] + self.kept[word[-1:]]
        if _ODD.search(text):
            return self._whole([text])
        return b"".join(map(self._part, self.parts.findall(text)))

    def _whole(self, words: list[str]) -> bytes:
        return b"".join(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        if len(self.kept) > KEPT:
            self.kept = _Ids(self._learn, dict(self.kept))
        if text.isascii() or ("\u03a3" not in text and is_normalized("NFC", text)):
            small = text.lower()
            if "<|" not in small or not any(s in small for s in self.special):
                return b"".join(map(self.kept.__getitem__, small.encode().split()))
        return self._whole(text.split())


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class Packer:
    """Sum-of-squares packing; pieces are (document, start, ids as bytes, tokens of the document)."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def _close(self, pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        return out

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, whole = len(ids) // 4, 4 * self.size
        at = 0
        while len(ids) - at >= whole:
            yield from self._close([(doc, at // 4, ids[at : at + whole], total)])
            at += whole
        s = total - at // 4
        if not s:
            return
        piece = (doc, at // 4, ids[at:], total)
        n, size = self.level, self.size
        # change of the sum of squares: a new sequence, then one more token run at each level that has room
        change = 2 * (n[s : size + 1] - n[: size + 1 - s]) + 2
        change[-1] = 1 - 2 * n[size - s]  # a full sequence leaves the array
        change[0] = 2 * n[s] + 1 if s < size else 0
        usable = n[: size + 1 - s] > 0
        usable[0] = True
        h = int(np.flatnonzero(usable)[::-1][np.argmin(change[usable][::-1])])
        if h:
            pieces = self.open[h].pop()
            self.level[h] -= 1
        else:
            pieces = []
        pieces = [*pieces, piece]
        if h + s == size:
            yield from self._close(pieces)
        else:
            self.level[h + s] += 1
            self.open.setdefault(h + s, []).append(pieces)

    def drain(self) -> Iterator[tuple]:
        """Empties the least filled sequences into the fullest and cuts the last into powers of two."""
        held = [(h, p) for h in sorted(self.open) for p in self.open[h]]
        self.open = {}
        self.level[:] = 0
        low, taken = 0, []
        while low < len(held):
            h, pieces = held.pop()
            need = self.size - h
            while need and (taken or low < len(held)):
                if not taken:
                    taken = held[low][1]
                    low += 1
                doc, start, ids, total = taken.pop()
                cut = min(need, len(ids) // 4)
                pieces = [*pieces, (doc, start, ids[: 4 * cut], total)]
                if 4 * cut < len(ids):
                    taken.append((doc, start + cut, ids[4 * cut :], total))
                need -= cut
            if need:
                held, low, taken = [], 0, pieces
                break
            yield from self._close(pieces)
        rest = taken
        left = sum(len(p[2]) // 4 for p in rest)
        for power in (1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1):
            part, need = [], power
            while need:
                doc, start, ids, total = rest.pop()
                cut = min(need, len(ids) // 4)
                part.append((doc, start, ids[: 4 * cut], total))
                if 4 * cut < len(ids):
                    rest.append((doc, start + cut, ids[4 * cut :], total))
                need -= cut
            yield from self._close(part)


def _pack(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("packing")
        w = words(path)
        packer = Packer(size, TaskContext.get().partitionId() << 32)
        tail = np.array([end], "<u4").tobytes()
        out: list[tuple] = []

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
            out.clear()
            return b

        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += packer.add(doc, w.encode(text or "") + tail)
                if out:
                    yield batch()
        out += packer.drain()
        if out:
            yield batch()

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    path is a tokenizer file whose words are split at white space; `end` follows each document.
    """
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_pack(path, size, end), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key)
