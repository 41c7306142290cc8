"""Hard negatives by Four-Russians scoring.

Vectors are integers (floor(256 x)).  A candidate travels as packed bit planes: for
every bit of its components, low to high in two's complement, a byte for each group
of eight dimensions.  A task makes, for a block of anchors, the table of all 256
subset sums of each group's eight anchor components.  The inner product is then
lookups and shifts alone: over the planes from the highest (which counts negative)
down, double what there is and add the tables' entries under the plane's bytes.

Two passes over (candidate shard, anchor group) tasks.  The first scores an anchor
against the rows of its own label and keeps the best as positives; these are merged
over all shards and go along with the anchors into the second, which scores the
rows of other labels and keeps the best inside every positive's band of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stage

SCALE = 256
#: Components are kept within this, so that scores of up to 16,384 dimensions fit decimal(38,0).
LARGEST = 2**55
#: Bytes of lookups of a task's candidate shard, which with a task's anchors bounds its memory.
SHARD_BYTES = 32 << 20
#: Rows of a shard and anchors of a group at most; rows and anchors scored at a time,
#: and bytes of the anchors' tables.
SHARD_ROWS = 16_384
ROW_BLOCK, ANCHOR_BLOCK = 1024, 256
TABLE_BYTES = 8 << 20
_WIDE = pa.decimal128(38, 0)


def pack_planes(v: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit j of byte (r, b, g) is bit b of ``v[r, 8 g + j]``."""
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 8)))
    planes = (v[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers that ``pack_planes`` packed."""
    out = np.zeros((planes.shape[0], planes.shape[2] * 8), dtype=np.int64)
    for b in range(planes.shape[1] - 1, -1, -1):
        bit = np.unpackbits(planes[:, b], axis=1, bitorder="little")
        out = 2 * out + (bit if b < planes.shape[1] - 1 else -bit.astype(np.int64))
    return out


def kind_for(bound: int):
    """The narrowest type in which numbers up to ``bound`` are exact."""
    return np.int32 if bound < 2**31 - 1 else np.int64 if bound < 2**63 - 1 else object


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of each eight components."""
    m, width = anchors.shape
    own = anchors.astype(kind).reshape(m, width // 8, 8).transpose(1, 2, 0)
    out = np.zeros((width // 8, 256, m), dtype=kind)
    for j in range(8):  # subsets with j as their highest member
        out[:, 1 << j: 2 << j] = out[:, : 1 << j] + own[:, j: j + 1]
    return out


def lookups(planes: np.ndarray) -> np.ndarray:
    """(bits, groups, rows) of table positions; planes that only repeat the sign go."""
    bits = planes.shape[1]
    while bits > 1 and (planes[:, bits - 1] == planes[:, bits - 2]).all():
        bits -= 1
    return np.ascontiguousarray(planes[:, :bits].transpose(1, 2, 0)).astype(np.intp)


def scores(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, anchors) of exact inner products by shift and add."""
    bits, groups, rows = at.shape
    total = np.zeros((rows, table.shape[2]), dtype=table.dtype)
    part = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        if b < bits - 1:
            total += total
        for g in range(groups):
            np.take(table[g], at[b, g], axis=0, out=part, mode="clip")
            if b == bits - 1:
                total -= part
            else:
                total += part
    return total


class _Shard:
    """Candidates of a task by label and id, or the anchors of one."""

    def __init__(self, t: pa.Table, bits: int, groups: int):
        ids = t.column("vec_id").to_numpy()
        labels = np.array(t.column("label").to_pylist(), dtype=object).astype(str)
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        raw = np.frombuffer(b"".join(t.column("planes").to_pylist()), dtype=np.uint8)
        self.planes = raw.reshape(len(ids), bits, groups)[order]
        self.order = order

    def label_range(self, label: str) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def _anchor_block(groups: int, kind) -> int:
    return max(1, min(ANCHOR_BLOCK, TABLE_BYTES // (256 * groups * np.dtype(kind).itemsize)))


def _bound(x: np.ndarray, bits: int) -> int:
    """No partial sum against these anchors exceeds this."""
    return int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) * x.shape[1] << bits


def _best(score: np.ndarray, low, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores per row and their columns, ties to the earlier column.
    ``score`` is spent: what is taken becomes ``low``, also where too few are left."""
    row = np.arange(len(score))
    best, column = np.empty((len(score), k), dtype=score.dtype), np.empty((len(score), k), dtype=np.int64)
    for j in range(k):
        column[:, j] = score.argmax(axis=1)
        best[:, j] = score[row, column[:, j]]
        score[row, column[:, j]] = low
    return best, column


class _Top:
    """The ``k`` best (score, id) of every row, of candidates that come by rising id."""

    def __init__(self, rows: int, k: int, kind, low):
        self.score, self.ids, self.low, self.k = np.full((rows, k), low, dtype=kind), np.zeros((rows, k), dtype=np.int64), low, k

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (rows, candidates), ``low`` where a candidate is none."""
        if not score.shape[1]:
            return
        better = score.max(axis=1) > self.score[rows, -1]
        rows, score = rows[better], score[better]
        if not len(rows):
            return
        took, column = _best(score, self.low, self.k)
        names = np.concatenate([self.ids[rows], ids[column]], axis=1)
        self.score[rows], column = _best(np.concatenate([self.score[rows], took], axis=1), self.low, self.k)
        self.ids[rows] = np.take_along_axis(names, column, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.score != self.low)
        return r, self.ids[r, c], self.score[r, c]


def _wide(x) -> pa.Array:
    if isinstance(x, np.ndarray) and x.dtype != object:
        return pa.array(x.astype(np.int64)).cast(_WIDE)
    return pa.array([int(v) for v in x], _WIDE)


def _positives(k: int, bits: int, groups: int, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of an anchor's own label in a shard."""
    out = [pa.table({"anchor_id": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "score": pa.array([], _WIDE)})]
    if len(candidates) and len(anchors):
        c, a = _Shard(candidates, bits, groups), _Shard(anchors, bits, groups)
        x = unpack_planes(a.planes)
        at = lookups(c.planes)
        bound = _bound(x, at.shape[0])
        kind, low = kind_for(bound), -bound - 1
        block = _anchor_block(groups, kind)
        edges = np.flatnonzero(np.concatenate([[True], a.labels[1:] != a.labels[:-1], [True]]))
        for begin, end in zip(edges[:-1], edges[1:]):
            lo, hi = c.label_range(a.labels[begin])
            for first in range(int(begin), int(end) if hi > lo else int(begin), block):
                own = slice(first, min(first + block, int(end)))
                table = subset_sums(x[own], kind)
                top = _Top(own.stop - first, k, kind, low)
                for r in range(lo, hi, ROW_BLOCK):
                    part = slice(r, min(r + ROW_BLOCK, hi))
                    s = np.ascontiguousarray(scores(table, at[:, :, part]).T)
                    s[a.ids[own][:, None] == c.ids[part][None, :]] = low
                    top.add(np.arange(len(s)), s, c.ids[part])
                i, names, s = top.rows()
                out.append(pa.table({"anchor_id": pa.array(a.ids[own][i]), "positive_id": pa.array(names), "score": _wide(s)}))
    return pa.concat_tables(out)


def _negatives(k: int, low_percent: int, high_percent: int, bits: int, groups: int, candidates: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of other labels in a shard, within each positive's band."""
    out = [pa.table({"anchor_id": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "positive_score": pa.array([], _WIDE),
                     "negative_id": pa.array([], pa.int64()), "negative_score": pa.array([], _WIDE)})]
    if len(candidates) and len(anchors):
        # by id alone: ties go to the smaller one
        candidates = candidates.sort_by("vec_id")
        c_ids, c_labels = candidates.column("vec_id").to_numpy(), np.array(candidates.column("label").to_pylist(), dtype=object).astype(str)
        planes = np.frombuffer(b"".join(candidates.column("planes").to_pylist()), dtype=np.uint8).reshape(-1, bits, groups)
        a = _Shard(anchors, bits, groups)
        x = unpack_planes(a.planes)
        at = lookups(planes)
        bound = _bound(x, at.shape[0])
        kind, low = kind_for(bound), -bound - 1
        block = _anchor_block(groups, kind)
        wanted = [anchors.column("wanted")[int(i)].as_py() for i in a.order]
        for first in range(0, len(a.ids), block):
            own = slice(first, min(first + block, len(a.ids)))
            asked = [(i, w["positive_id"], int(w["score"])) for i, ws in enumerate(wanted[own]) for w in ws]
            # scores of the band as integers; kept within what a score can be
            least = np.array([max(low, min(-(-low_percent * s // 100), bound + 1)) for *_, s in asked], dtype=kind)
            most = np.array([max(low, min(high_percent * s // 100, bound + 1)) for *_, s in asked], dtype=kind)
            who = np.array([i for i, *_ in asked], dtype=np.int64)
            table = subset_sums(x[own], kind)
            top = _Top(len(asked), k, kind, low)
            for r in range(0, len(c_ids), ROW_BLOCK):
                part = slice(r, min(r + ROW_BLOCK, len(c_ids)))
                s = np.ascontiguousarray(scores(table, at[:, :, part]).T)
                s[a.labels[own][:, None] == c_labels[part][None, :]] = low
                s[a.ids[own][:, None] == c_ids[part][None, :]] = low
                for lo in range(0, len(asked), ANCHOR_BLOCK):
                    some = np.arange(lo, min(lo + ANCHOR_BLOCK, len(asked)))
                    mine = s[who[some]]
                    mine[(mine < least[some][:, None]) | (mine > most[some][:, None])] = low
                    top.add(some, mine, c_ids[part])
            i, names, s = top.rows()
            out.append(pa.table({"anchor_id": pa.array(a.ids[own][who[i]]), "positive_id": pa.array([asked[j][1] for j in i], pa.int64()),
                                 "positive_score": _wide([asked[j][2] for j in i]), "negative_id": pa.array(names), "negative_score": _wide(s)}))
    return pa.concat_tables(out)


def _packer(bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((len(batch), groups * 8), dtype=np.int64)
            for i, row in enumerate(batch.column(2)):
                own = row.values.to_numpy()
                v[i, : len(own)] = own
            step = max(1, (1 << 22) // max(1, groups * 8 * bits))
            packed = [p.tobytes() for lo in range(0, len(v), step) for p in pack_planes(v[lo: lo + step], bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3)], ["vec_id", "label", "planes", "anchor"])
    return run


def integer_vectors(vector_col: str) -> Column:
    """floor(256 x) of every component, kept within ``LARGEST``; null where the
    vector is null or holds a null or non-finite component."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))).cast("long"))
    return F.when(~bad, whole)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3,
                   low_percent: int = 50, high_percent: int = 95, id_col: str = "vec_id", vector_col: str = "embedding",
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For every anchor and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels whose score is between ``low_percent``
    and ``high_percent`` of the positive's.

    ``is_anchor`` and ``label`` are columns over the rows of ``vectors``.  Scores are
    exact integer inner products of floor(256 x); higher ones come first, ties go to
    the smaller id.  Shorter vectors count as filled with zeros; components beyond
    ``LARGEST`` count as that.  Rows with a null id, label or vector, or a null or
    non-finite component, take no part.  Of rows that share an id, the one with the
    smallest label and then the smallest vector counts; repeated rows count once.
    An anchor without positives, or a positive without negatives in its band (one
    with a negative score has none), gives no rows.  Other columns change nothing.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score), scores as decimal(38,0).
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"),
                           integer_vectors(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .filter("vec_id is not null and label is not null and v is not null")
            .groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("vec_id", "r.*"))
    rows = stage(rows, "vectors")
    n, n_anchors, width, top, bottom = rows.agg(  # five numbers
        F.count("*"), F.count_if("anchor"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    bits = max(int(top or 0).bit_length(), (-int(bottom or 0) - 1).bit_length() if (bottom or 0) < 0 else 0) + 1
    groups = max(1, -(-int(width or 0) // 8))
    block = max(1, min(shard_rows, SHARD_BYTES // (groups * bits * 8)))
    shards, deals = max(1, -(-n // block)), max(1, -(-n_anchors // block))
    packed = rows.select("vec_id", "label", "v", "anchor").mapInArrow(_packer(bits, groups), "vec_id long, label string, planes binary, anchor boolean")
    packed = stage(packed, "planes")
    deal = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(deals)).cast("int")
    candidates = (packed.select("vec_id", "label", "planes", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
                  .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))))

    def search(anchors: DataFrame, find, schema: str) -> DataFrame:
        everywhere = anchors.withColumn("deal", deal).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return (candidates.groupBy("shard", "deal").cogroup(everywhere.groupBy("shard", "deal"))
                .applyInArrow(lambda c, a: find(c, a), schema))

    def ranked(frame: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
        order = f"row_number() over (partition by {', '.join(keys)} order by {score} desc, {name})"
        return frame.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k)

    anchors = packed.filter("anchor").select(*[F.col(c).alias(c) for c in ("vec_id", "label", "planes")])  # columns of their own
    found = search(anchors, lambda c, a: _positives(positives, bits, groups, c, a), "anchor_id long, positive_id long, score decimal(38,0)")
    best = (ranked(found, ["anchor_id"], "score", "positive_id", positives)
            .groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("wanted")))  # at most ``positives`` each
    best = stage(best, "positives")
    found = search(anchors.join(best, "vec_id"), lambda c, a: _negatives(negatives, low_percent, high_percent, bits, groups, c, a),
                   "anchor_id long, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)")
    return (ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
