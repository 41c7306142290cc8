"""Byte-level BPE encoding and decoding over padded numpy matrices.

A text is cut into the matches of ``SPLIT``; the distinct pieces of a chunk that the
task has not met yet are encoded together.  A piece that is a token itself is that
token.  The others are dealt into buckets of doubling lengths, a bucket being a
matrix with a piece's bytes per row, padded.  In every round each row merges its
leftmost pair of least rank: the merged token replaces the left one, the row is
compacted over the right one, and the two pairs beside it are looked up in a hash
table of pairs.  Rows without a mergeable pair leave the matrix.

A row of n bytes takes up to n rounds over its width.  Pieces of more than
``WIDEST`` bytes (a run of one sign, letters without a space) would make that
quadratic; they are merged in the same order with a heap.

The vocabulary (a rank file, checked against ``MAX_TOKENS``) and the table of
character classes are the only things broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.words import spans

#: The split whose rules ``starts`` follows.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the widest matrix row, cells of a matrix, tokens of a vocabulary, pieces
#: that a task remembers, and bytes decoded at a time.
WIDEST = 512
CELLS = 1 << 20
MAX_TOKENS = 1 << 22
REMEMBERED = 300_000
DECODE_IDS = 1 << 20

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_NONE = np.iinfo(np.int32).max
_FREE = np.uint64(2**64 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> id of a rank file (a base64 token and its rank per line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{path} has more than {MAX_TOKENS} tokens")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} lacks the single bytes {missing[:5]}")
    return ranks


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other.  The classes
    are asked of tiktoken's own pattern engine, so they are of its Unicode version."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(engine.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def starts(cp: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points begin a match of ``SPLIT``; ``rows`` are the positions where
    texts begin and, last, the end of all.  Every code point belongs to a match."""
    n = len(cp)
    kind = classes[cp]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[rows] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    start[n] = True
    run = np.flatnonzero(start)
    first, end = run[:-1], run[1:]
    # white space before a word of its text: all but the last go, a last blank joins the word
    space = (kind[first] == _SPACE) & ~edge[end]
    last = end[space] - 1
    start[last] = True
    joined = last[cp[last] == 0x20] + 1
    start[joined] = False
    # an apostrophe alone, no blank joined to it, takes an ending from the letters behind it
    lone = first[(cp[first] == 0x27) & (end - first == 1) & ~edge[end]]
    lone = lone[start[lone]]
    lone = lone[kind[lone + 1] == _LETTER]
    one = cp[lone + 1]
    two = np.where(edge[lone + 2], 0, cp[np.minimum(lone + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for size, at in ((2, lone[short]), (3, lone[long])):
        start[at + 1] = False
        start[at + size] = True
    return start[:n]


class Merges:
    """A vocabulary for encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        left, right, into = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        self._hash_pairs(np.array(left, np.uint64), np.array(right, np.uint64), np.array(into, np.int32))

    def _hash_pairs(self, left: np.ndarray, right: np.ndarray, into: np.ndarray) -> None:
        """Open addressing, at most a quarter full."""
        bits = max(8, int(4 * max(len(into), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _FREE), np.full(1 << bits, _NONE, dtype=np.int32)
        key = left << np.uint64(32) | right
        slot = self._slot(key)
        wait = np.arange(len(key))
        while len(wait):
            free = wait[self.keys[slot[wait]] == _FREE]
            self.keys[slot[free]] = key[free]
            won = free[self.keys[slot[free]] == key[free]]
            self.values[slot[won]] = into[won]
            wait = wait[self.keys[slot[wait]] != key[wait]]
            slot[wait] = (slot[wait] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, ``_NONE`` where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).ravel()
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.values[slot], _NONE)
        wait = np.flatnonzero((have != key) & (have != _FREE))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & self.mask
            have = self.keys[slot[wait]]
            hit = wait[have == key[wait]]
            out[hit] = self.values[slot[hit]]
            wait = wait[(have != key[wait]) & (have != _FREE)]
        return out.reshape(left.shape)

    def _matrix(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, ids, lengths) of pieces of at most ``width`` bytes, as they end."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        n = np.array([len(p) for p in pieces])
        ids = self.byte_id[raw]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        rank[np.arange(width - 1) >= (n - 1)[:, None]] = _NONE
        who = np.arange(len(pieces))
        while len(who):
            if not rank.shape[1]:
                yield who, ids, n
                return
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            over = best == _NONE
            if over.any():
                yield who[over], ids[over], n[over]
                on = ~over
                who, ids, n, rank, at, best = who[on], ids[on], n[on], rank[on], at[on], best[on]
                if not len(who):
                    return
            row = np.arange(len(who))
            ids[row, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(row), -1)
            n = n - 1
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], best[before])
            after = np.flatnonzero(at < n - 1)
            rank[after, at[after]] = self.rank(best[after], ids[after, at[after] + 1])

    def _heap(self, piece: bytes) -> list[int]:
        """The ids of one long piece: merges in the order (rank, position)."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        ranks = self.rank(ids[:-1], ids[1:])
        heap = [(int(ranks[i]), int(i), i + 1) for i in np.flatnonzero(ranks != _NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = self.tokens
        while heap:
            rank, i, j = heapq.heappop(heap)
            # out of date: a side is gone or has grown
            if ids[i] < 0 or after[i] != j or j >= n or self.ranks.get(text[ids[i]] + text[ids[j]]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(text[ids[a]] + text[ids[b]])) is not None:
                    heapq.heappush(heap, (r, a, b))
        return [i for i in ids if i >= 0]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids per piece)."""
        count = np.ones(len(pieces), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        buckets: dict[int, list[int]] = {}
        whole: dict[int, int] = {}  # pieces that are tokens
        for i, p in enumerate(pieces):
            own = self.ranks.get(p)
            if own is not None:
                whole[i] = own
            elif len(p) > WIDEST:
                ids = self._heap(p)
                found.append((np.array([i]), np.array([ids], dtype=np.int32), np.array([len(ids)])))
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        if whole:
            found.append((np.array(list(whole)), np.array(list(whole.values()), dtype=np.int32)[:, None], np.ones(len(whole), np.int64)))
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for lo in range(0, len(members), step):
                part = np.array(members[lo: lo + step])
                found.extend((part[who], ids, n) for who, ids, n in self._matrix([pieces[i] for i in part], width))
        for who, _, n in found:
            count[who] = n
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        for who, ids, n in found:
            inside = np.arange(ids.shape[1]) < n[:, None]
            flat[(begin[who][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return flat, count

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        upto = np.cumsum(size)
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.offset[ids] - (upto - size), size) + np.arange(int(upto[-1]))].tobytes()


_built: dict[str, tuple[Merges, np.ndarray]] = {}


def _tables(shared) -> tuple[Merges, np.ndarray]:
    """The vocabulary's tables, built once in a Python worker."""
    name, ranks, classes = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Merges(ranks), classes
    return _built[name]


def share_vocabulary(spark: SparkSession, path: str):
    """A broadcast of the rank file at ``path`` and of the character classes."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks, character_classes()))


class _Pieces:
    """The pieces that a task has met, with their ids."""

    def __init__(self, merges: Merges):
        self.merges, self.code = merges, {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.code) > REMEMBERED:
            self.__init__(self.merges)
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.code]
        if fresh:
            ids, count = self.merges.encode(fresh)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
            self.code.update(zip(fresh, range(len(self.code), len(self.code) + len(fresh))))
        return np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))


def _encode_rows(data: bytes, rows: np.ndarray, known: _Pieces, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per row) of the texts ``data[rows[k]:rows[k + 1]]``."""
    try:
        text = data.decode()
    except UnicodeDecodeError:  # bytes that are no UTF-8 count as U+FFFD, text by text
        parts = [data[a:b].decode(errors="replace").encode() for a, b in zip(rows[:-1], rows[1:])]
        rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        data = b"".join(parts)
        text = data.decode()
    if not data:
        return np.zeros(0, np.int32), np.zeros(len(rows) - 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    head = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of every code point
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    begin = head[starts(cp, np.searchsorted(head, rows), classes)]
    cut = begin.tolist() + [len(data)]
    code = known.codes([data[a:b] for a, b in zip(cut, cut[1:])])
    count, first = known.count[code], known.first[code]
    upto = np.cumsum(count)
    ids = known.ids[np.repeat(first - (upto - count), count) + np.arange(int(upto[-1]))]
    total = np.concatenate([[0], upto])
    return ids, np.diff(total[np.searchsorted(begin, rows)])


def bpe_encode(docs: DataFrame, vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, ids array<int>): every whole text encoded with a ``vocabulary`` of
    ``share_vocabulary``, each match of ``SPLIT`` by itself, without special tokens.

    Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD.  A row
    is encoded by itself: repeated rows, null ids and other columns (which are not
    returned) change nothing, and an empty table stays empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, classes = _tables(vocabulary)
        known = _Pieces(merges)
        for batch in batches:
            text = batch.column(1).cast(pa.binary()).fill_null(b"")
            for lo, hi in spans(text):
                at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset + lo: text.offset + hi + 1].astype(np.int64)
                data = text.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if at[-1] > at[0] else b""
                ids, count = _encode_rows(data, at - at[0], known, classes)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its ids as bytes in a further column ``decoded``.  No ids are
    no bytes; a null array, a null id or one that the vocabulary lacks makes the
    row's bytes null.  A column ``decoded`` that is there already is replaced."""
    keep = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*keep, T.StructField("decoded", T.BinaryType())])
    place = [f.name for f in keep].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = _tables(vocabulary)
        for batch in batches:
            out = []
            for row in batch.column(place).cast(pa.list_(pa.int64())):
                ids = row.values if row.is_valid else None
                if ids is None or ids.null_count:
                    out.append(None)
                    continue
                ids = ids.to_numpy()
                known = not len(ids) or bool((ids.min() >= 0) and (ids.max() < len(merges.tokens)) and (merges.length[ids] > 0).all())
                out.append(b"".join(merges.decode(ids[lo: lo + DECODE_IDS]) for lo in range(0, len(ids), DECODE_IDS)) if known else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], schema=pa.schema([*batch.schema, pa.field("decoded", pa.binary())]))

    return encoded.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)
