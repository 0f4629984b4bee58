"""Byte-level BPE by a segment tree over byte positions.

The leaf of a position holds the key rank * width + position of the pair that starts there, an inner node
the smaller of its children, so the root names the leftmost pair of the lowest rank. A merge changes three
leaves (the pair's own, the swallowed one and the one before) and the path above each. Short pieces of like
width are merged together, one row of a matrix of trees each; a long piece has a tree of its own and takes
n log n steps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

_INF = np.int64(1) << 62
#: Pieces of more bytes than this get a tree of their own.
WIDE = 64
#: Pieces whose ids are kept for reuse in a worker at most.
KEPT = 200_000


class Codec:
    """Encoder and decoder for the ranks in a .tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], np.array(rank, np.int64)[order]
        self.pair = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist(), strict=True))
        self.kept: dict[str, tuple[int, ...]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge_together(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most `width` bytes, a power of two; one tree a row."""
        k = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(k, width)
        ids = self.byte[raw]
        pos = np.arange(width)
        nxt = np.broadcast_to(pos + 1, (k, width)).copy()
        prv = np.broadcast_to(pos - 1, (k, width)).copy()
        live = pos < size[:, None]
        tree = np.full((k, 2 * width), _INF, np.int64)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        pairs = live[:, 1:] & (rank >= 0)
        tree[:, width : 2 * width - 1][pairs] = (rank * width + pos[:-1])[pairs]
        node = width // 2
        while node:
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
            node //= 2

        def put(rows, at, value):
            at = at + width
            tree[rows, at] = value
            at = at >> 1
            while at[0]:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at = at >> 1

        rows = np.flatnonzero(tree[:, 1] < _INF)
        while len(rows):
            top = tree[rows, 1]
            i, merged = top % width, top // width
            j = nxt[rows, i]
            after = nxt[rows, j]
            ids[rows, i] = merged
            nxt[rows, i] = after
            live[rows, j] = False
            inner = after < size[rows]
            r = rows[inner]
            if len(r):
                prv[r, after[inner]] = i[inner]
            put(rows, j, _INF)
            value = np.full(len(rows), _INF)
            if len(r):
                got = self._ranks(merged[inner], ids[r, after[inner]])
                value[inner] = np.where(got >= 0, got * width + i[inner], _INF)
            put(rows, i, value)
            before = prv[rows, i]
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                got = self._ranks(ids[r, b], merged[has])
                put(r, b, np.where(got >= 0, got * width + b, _INF))
            rows = rows[tree[rows, 1] < _INF]
        flat, n = ids[live].tolist(), live.sum(axis=1).tolist()
        out, at = [], 0
        for m in n:
            out.append(tuple(flat[at : at + m]))
            at += m
        return out

    def merge_alone(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of any length, in n log n steps."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        inf, pair = 1 << 62, self.pair
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [inf] * (2 * width)
        for i in range(n - 1):
            r = pair.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at, value):
            at += width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                new = a if a < b else b
                if tree[at] == new:
                    break
                tree[at] = new
                at >>= 1

        alive = bytearray(b"\1") * n
        while tree[1] < inf:
            merged, i = divmod(tree[1], width)
            j = nxt[i]
            after = nxt[j]
            ids[i], nxt[i], alive[j] = merged, after, 0
            put(j, inf)
            r = None
            if after < n:
                prv[after] = i
                r = pair.get(merged << 32 | ids[after])
            put(i, inf if r is None else r * width + i)
            b = prv[i]
            if b >= 0:
                r = pair.get(ids[b] << 32 | merged)
                put(b, inf if r is None else r * width + b)
        return tuple(x for x, a in zip(ids, alive, strict=True) if a)

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of pieces not seen yet among those kept."""
        by_width: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.kept[p] = (r,)
            elif len(raw) > WIDE:
                self.kept[p] = self.merge_alone(raw)
            else:
                by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append(p)
        for width, group in by_width.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                self.kept.update(zip(part, self.merge_together([p.encode() for p in part], width), strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; equal pieces are merged once."""
        for at in range(0, len(texts), 64):
            split = [self.pattern.findall(t) for t in texts[at : at + 64]]
            if len(self.kept) > KEPT:
                self.kept.clear()
            self.learn(set(chain.from_iterable(split)).difference(self.kept))
            for pieces in split:
                yield list(chain.from_iterable(map(self.kept.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)
