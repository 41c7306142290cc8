"""Packed (hash, id) entries for shuffles of many small numbers.

A row holds the entries of one bucket as two binary columns, without per-row
overhead.  The hashes are sorted and sent as differences, all numbers byte plane by
byte plane, so the shuffle's compression halves the 16 bytes of an entry.  Equal hashes are combined
before the shuffle: a flush sends each distinct hash once, so a hash that a
third of all rows share arrives once per flush, not once per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries gathered before a flush (16 bytes each).
FLUSH_ENTRIES = 1_000_000
#: Entries a bucket should hold.
BUCKET_ENTRIES = 3_000_000

SCHEMA = "bucket int, hash binary, id binary, a binary, b binary"
#: With a smallest id beside each (a, b): ``keep="lead"``.
LEAD_SCHEMA = SCHEMA + ", c binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("id", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


class Combiner:
    """Gathers (hash, id) entries; ``flush`` yields one row per bucket.

    Of entries with equal hash only the smallest id is sent (``keep="id"``: as many
    of the smallest as ``most`` gives for the hashes).  The other ids are
    sent as (a, b) columns of some row, for they need no meeting with other
    tasks: ``b`` is the id, ``a`` is the hash or (``keep="id"``) the smallest id
    that it is connected with.  ``keep="lead"`` is the hash, with the smallest id of
    the flush that has it as ``c``.
    ``lead`` adds the smallest id of a repeated hash to (a, b), too.
    """

    def __init__(self, buckets: int, keep: str, lead: bool = False, most=None):
        self.buckets, self.keep, self.lead, self.most = buckets, keep, lead, most
        self.hashes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.ids.append(ids)
        self.size += len(hashes)

    @property
    def full(self) -> bool:
        return self.size >= FLUSH_ENTRIES

    def flush(self):
        if not self.size:
            return
        h, d = np.concatenate(self.hashes), np.concatenate(self.ids)
        self.hashes, self.ids, self.size = [], [], 0
        if self.keep == "id":
            h, d, lead, place, _ = distinct(h, d)
            rest = place >= (1 if self.most is None else self.most(h))
            new = ~rest
        else:
            h, d, lead = grouped(h, d)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            rest = d != lead
        if self.lead:
            group = np.cumsum(new) - 1
            repeated = np.zeros(group[-1] + 1, dtype=bool)
            repeated[group[rest]] = True
            rest |= repeated[group]
        if self.keep in ("hash", "lead"):
            a, b = h[rest].view(np.int64), d[rest]
        else:
            a, b = stars(lead[rest], d[rest])
        c = lead[rest]
        h, d = h[new], d[new] if self.keep == "id" else lead[new]
        # hashes are sorted: a bucket is a range of them
        which = bucket_of(h, self.buckets)
        cut = np.searchsorted(which, np.arange(self.buckets + 1))
        step = -(-len(a) // self.buckets) if len(a) else 0
        schema = _ARROW.append(pa.field("c", pa.binary())) if self.keep == "lead" else _ARROW
        out = {k: [] for k in schema.names}
        for k in range(self.buckets):
            lo, hi, x, y = cut[k], cut[k + 1], k * step, (k + 1) * step
            if lo == hi and x >= len(a):
                continue
            out["bucket"].append(k)
            out["hash"].append(planes(np.diff(h[lo:hi], prepend=np.uint64(0))))
            out["id"].append(planes(d[lo:hi]))
            out["a"].append(planes(a[x:y]))
            out["b"].append(planes(b[x:y]))
            if self.keep == "lead":
                out["c"].append(planes(c[x:y]))
        # rows of bounded size for the transfer
        table = pa.table(out, schema=schema)
        yield from table.to_batches(max_chunksize=64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Range partition of the 64-bit hash space."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def n_buckets(entries: int, least: int) -> int:
    return max(1, least, -(-int(entries) // BUCKET_ENTRIES))


def planes(x: np.ndarray) -> bytes:
    """8-byte numbers as their first bytes, then their second bytes, and so on."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The numbers of all rows of a binary column, in one array."""
    raws = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column(name)]
    out, at = np.empty(sum(map(len, raws)) // 8, dtype=dtype), 0
    for raw in raws:
        part = out[at: at + len(raw) // 8]
        if len(part):
            part.view(np.uint8).reshape(-1, 8)[:] = raw.reshape(8, -1).T
            if name == "hash":
                np.cumsum(part, out=part)
        at += len(part)
    return out


def grouped(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, smallest id of the hash) in the order of the hash."""
    if not len(h):
        return h, d, d
    order = np.argsort(h)
    h, d = h[order], d[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h, d, np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(h))))


def distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, smallest id of the hash, place among its ids, number of its ids),
    without repeats, in the order of hash and id."""
    order = np.argsort(h)
    h, d = h[order], d[order]
    del order
    same = h[1:] == h[:-1]
    many = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(h) else np.zeros(0, np.int64)
    d[many] = d[many][np.lexsort((d[many], h[many]))]  # most hashes have one id
    again = np.flatnonzero(same & (d[1:] == d[:-1])) + 1
    h, d = np.delete(h, again), np.delete(d, again)
    if not len(h):
        return h, d, d, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(at, len(h)))
    return h, d, np.repeat(d[at], size), np.arange(len(h)) - np.repeat(at, size), np.repeat(size, size)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest of its component, node) for the other nodes of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while len(nodes):
        before = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        np.minimum.at(low, before, low)  # a root follows its nodes
        low = low[low]
        if (low == before).all():
            break
    other = low != np.arange(len(nodes))
    return nodes[low[other]], nodes[other]
