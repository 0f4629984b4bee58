"""Vectorised reading of Arrow text columns: words and their hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of a word that are hashed in steps of eight; a longer word is hashed by blake2b.
LONG = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: (bytes, length, chain) multipliers of two independent hashes
_SALTS = tuple(tuple(int(x) | 1 for x in np.random.default_rng(20240229 + k).integers(1, 2**63, 3, dtype=np.uint64)) for k in (0, 1))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, edges) of runs of rows with at most `limit` bytes; null is empty.

    Row i's bytes are bytes[edges[i - first]:edges[i - first + 1]].
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(blank: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of not blank) and the number of words before each row's end."""
    n = len(blank)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    word = ~blank
    before = np.r_[False, word[:-1]]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.r_[word[1:], False]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, edges)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, and so on."""
    n = end - start
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(start - (total - n), n)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes data[start:end] of each word; `which` chooses one of two independent hashes.

    Eight bytes at a time are mixed into the state, so no algebraic structure of the bytes survives.
    """
    byte, length, chain = (np.uint64(x) for x in _SALTS[which])
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    h = mix(mix((eight[starts] & _LOW[np.minimum(n, 8)]) * byte) + n.astype(np.uint64) * length)
    left = np.flatnonzero((n > 8) & (n <= LONG))
    at = 8
    while len(left):
        part = eight[starts[left] + at] & _LOW[np.minimum(n[left] - at, 8)]
        h[left] = mix(h[left] * chain + mix(part * byte))
        at += 8
        left = left[n[left] > at]
    for i in np.flatnonzero(n > LONG):
        digest = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def gram_hash(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values, built from runs of half the length, mixed at each step."""
    c = np.uint64(_SALTS[which][2])
    n, total, done = len(h) - k + 1, None, 0
    part, width = h, 1
    while True:
        if k & width:
            piece = part[done : done + n]
            total = piece if total is None else mix(total * c + piece)
            done += width
        if 2 * width > k:
            break
        part = mix(part[: len(part) - width] * c + part[width:])
        width *= 2
    return mix(total + np.uint64(k))


def words(data: np.ndarray, edges: np.ndarray, map_to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the words before each row's edge.

    Words are runs of bytes other than the white space of the contracts; map_to first maps each byte.
    """
    if map_to is not None:
        data = map_to[data]
    starts, ends, upto = spans(_WHITE[data], edges)
    return word_hash(data, starts, ends), starts, ends, upto


def letters_map() -> np.ndarray:
    """Maps ASCII capitals to small letters and other ASCII than letters to a space; the rest stays."""
    m = np.arange(256, dtype=np.uint8)
    m[:128] = 0x20
    m[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    m[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return m
