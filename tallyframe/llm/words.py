"""Words, word hashes and n-gram hashes of Arrow text columns, in numpy.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Text is taken in
chunks of bounded bytes (one longer text makes a chunk of its own), so memory
follows the longest text, never the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Words of more bytes are hashed one by one.
LONG_WORD = 1024
_SEED, _ODD, _BLOCK = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_places = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(n: int) -> np.ndarray:
    """Odd multipliers for the first ``n`` places of a run."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, max(64, 2 * n) + 1, dtype=np.uint64) * _ODD + _SEED) | np.uint64(1)
    return _places[:n]


def spans(text: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text, at least one row each."""
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset: text.offset + len(text) + 1]
    lo = 0
    while lo < len(text):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(text))
        yield lo, hi
        lo = hi


def plain(column) -> pa.Array:
    """A text column as a plain string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


class Words:
    """The words of the rows ``lo:hi`` of a string array.

    ``start``/``end`` are byte positions in ``data``; the words of row k are
    ``first[k]:first[k + 1]``.
    """

    def __init__(self, text: pa.Array, lo: int, hi: int, lower: bool = False):
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset + lo: text.offset + hi + 1].astype(np.int64)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.rows = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_SPACE[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = self.rows[:-1][self.rows[:-1] < n]
        before[edges] = False
        edges = self.rows[1:][self.rows[1:] > 0] - 1
        after[edges] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.rows)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, the same for equal words everywhere: a chain over
        the word's 8-byte blocks, each mixed with what was before (words that differ
        in a regular way, for which sums of powers would agree, do not meet)."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        block_at = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        left = self.end - self.start
        out = mix(left.astype(np.uint64) * _ODD + _SEED)
        on = np.flatnonzero(left <= LONG_WORD)
        pos, left, h = self.start[on], left[on], out[on]
        while len(on):
            h = mix(h ^ mix((block_at[pos] & _MASK[np.minimum(left, 8)]) + _BLOCK))
            more = left > 8
            out[on[~more]] = h[~more]
            on, pos, left, h = on[more], pos[more] + 8, left[more] - 8, h[more]
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words (also across rows: the
    caller masks those), one per starting position."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    place = places(k)
    out = word_hash[:n] * place[0]
    for j in range(1, k):
        out += word_hash[j: n + j] * place[j]
    return mix(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of every row; a row of
    fewer words has its whole sequence as one shingle, a row without words an
    empty set."""
    h = words.hashes()
    g = grams(h, k)
    first, out = words.first, []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = hi - lo
        if n >= k:
            s = np.sort(g[lo: hi - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif n:
            out.append(mix((h[lo:hi] * places(n)).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
