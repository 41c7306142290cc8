"""Conflict-constrained best-fit packing of documents into sequences.

Open bins are kept in the order of their room left and carry two bitmaps: the
sources and the duplicate clusters of what they hold.  A piece goes to the
tightest bin that it fits and whose bitmaps have neither its source nor its
cluster; the search starts at the smallest room that suffices and moves on to the
successor until a compatible bin is found, else a bin is opened.  Larger
pieces go first.

Documents are dealt by a hash into groups of bounded size, one task each; only
narrow rows (id, words, source, cluster) are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.words import Words, mix, plain, spans
from tallyframe.session import stage

CAPACITY = 2048
#: Documents of a group.
GROUP_ROWS = 4096

_OUT = "bin_group int, bin int, doc_id long, piece int, first_word long, n_words long, source string, cluster long, room_left long"


def _measure(batches):
    """(doc_id, source, text) to (doc_id, source, words, cluster): the cluster is
    a hash of the lower-case word sequence."""
    for batch in batches:
        text = plain(batch.column(2))
        for lo, hi in spans(text):
            w = Words(text, lo, hi, lower=True)
            n = np.diff(w.first)
            place = (np.arange(len(w)) - np.repeat(w.first[:-1], n)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hashes() * mix(place)), dtype=np.uint64)])
            cluster = mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(cluster, pa.int64())],
                                             ["doc_id", "source", "words", "cluster"])


class Bins:
    """Open bins by room left, with their source and cluster bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.levels: list[int] = []  # distinct rooms of the open bins, ascending
        self.at: dict[int, list[int]] = {}

    def _put(self, b: int) -> None:
        room = self.room[b]
        if room not in self.at:
            insort(self.levels, room)
            self.at[room] = []
        self.at[room].append(b)

    def place(self, size: int, source: int, cluster: int) -> int:
        for level in range(bisect_left(self.levels, size), len(self.levels)):
            row = self.at[self.levels[level]]
            for k, b in enumerate(row):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    row.pop(k)
                    if not row:
                        del self.at[self.levels[level]]
                        del self.levels[level]
                    return self._fill(b, size, source, cluster)
        self.room.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return self._fill(len(self.room) - 1, size, source, cluster)

    def _fill(self, b: int, size: int, source: int, cluster: int) -> int:
        self.room[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self._put(b)
        return b


def pack(rows: list[tuple], capacity: int) -> tuple[list[tuple], list[int]]:
    """Bins of one group: rows are (id, words, source, cluster); returns
    (bin, row, piece, first word, words) and the room left by bin."""
    sources: dict = {}
    times: dict = {}
    for _, _, s, c in rows:
        sources.setdefault(s, 1 << len(sources))
        times[c] = times.get(c, 0) + 1
    bits: dict = {}
    for c, n in times.items():
        if n > 1:
            bits[c] = 1 << len(bits)
    pieces = []
    for i, (d, n, _, _) in enumerate(rows):
        full = n // capacity
        if full and n % capacity == 0:
            full -= 1
        pieces += [(capacity, d, i, p) for p in range(full)]
        pieces.append((n - full * capacity, d, i, full))
    pieces.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[3]))
    bins, out = Bins(capacity), []
    for size, _, i, p in pieces:
        _, _, s, c = rows[i]
        out.append((bins.place(size, sources[s], bits.get(c, 0)), i, p, p * capacity, size))
    return out, bins.room


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("words", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        group = table.column("bin_group")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "words", "source", "cluster")), strict=True))
        out, room = pack(rows, capacity)
        return pa.table({
            "bin_group": pa.array([group] * len(out), pa.int32()), "bin": pa.array([o[0] for o in out], pa.int32()),
            "doc_id": pa.array([rows[o[1]][0] for o in out], pa.int64()), "piece": pa.array([o[2] for o in out], pa.int32()),
            "first_word": pa.array([o[3] for o in out], pa.int64()), "n_words": pa.array([o[4] for o in out], pa.int64()),
            "source": pa.array([rows[o[1]][2] for o in out], pa.string()), "cluster": pa.array([rows[o[1]][3] for o in out], pa.int64()),
            "room_left": pa.array([room[o[0]] for o in out], pa.int64())})
    return run


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(bin_group, bin, doc_id, piece, first_word, n_words, source, cluster,
    room_left): a row per piece of every row of ``docs``.

    A bin is (bin_group, bin); its pieces hold ``capacity`` words at most, come
    from different sources and from different duplicate clusters (equal
    lower-case word sequences).  Longer documents are cut into pieces of
    ``capacity`` words and a rest.  A null or empty text is one piece of no words;
    null sources are one source; a null id is packed like any other; repeated
    rows are copies of each other.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = stage(rows.mapInArrow(_measure, "doc_id long, source string, words long, cluster long"), "sizes")
    groups = max(1, -(-rows.count() // group_rows))
    # copies have ids of their own, which spread them; rows that repeat whole are spread by their place
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "source", "words", "cluster"))
    often = keyed.groupBy("_key").count().filter(F.col("count") > group_rows // 64 + 1).select("_key", F.lit(True).alias("_often"))
    dealt = keyed.withColumn("_place", F.monotonically_increasing_id()).join(often, "_key", "left")
    spread = F.when(F.col("_often"), F.xxhash64("_key", "_place")).otherwise(F.col("_key"))
    dealt = dealt.withColumn("bin_group", F.pmod(spread, F.lit(groups)).cast("int")).drop("_key", "_place", "_often")
    return dealt.groupBy("bin_group").applyInArrow(_pack_group(capacity), _OUT)
