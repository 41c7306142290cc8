"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Rows are dealt into shards by a hash of their id; a shard's task builds a ball
tree over its vectors and answers blocks of queries with it.  A node with centre
c and radius r holds no score above ``q.c + |q| * r``; nodes are taken in the
order of that bound and a node below the current k-th score is cut.  The k-th
score is shared: a first pass answers every query from its own shard alone, and
the score found there is the floor from which all other shards start.

Vectors are integers (floor(256 x)); scores are exact at any size.  Where a score
may pass 2**53 the vectors are cut into digits of ``DIGIT_BITS`` bits: the products
of two digit planes are exact in doubles and add up in Python integers.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stage

LEAF = 128
#: Vectors of a shard and queries of a block.
SHARD_ROWS = 20_000
QUERY_ROWS = 2_000
SCALE = 256
#: Integers of a vector are cut to this size.
LARGEST = 2**55
#: Bits of a digit: products of two over a million dimensions stay under 2**53.
DIGIT_BITS = 16

_SCORE = pa.decimal128(38, 0)
_FOUND = "query_id long, vec_id long, score decimal(38,0)"


class BallTree:
    """Nodes as arrays: row ranges lo:hi of the reordered vectors, children,
    centre, radius and smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.order = order
        self.ids, self.x = ids, vectors
        self.lo, self.hi, self.kids, self.centre, self.radius, self.least = [], [], [], [], [], []
        self._build(0, len(ids))
        self.ids, self.x = ids[self.order], vectors[self.order]

    def _build(self, lo: int, hi: int) -> int:
        own = self.order[lo:hi]
        x = self.x[own].astype(np.float64)
        centre = x.mean(axis=0)
        at = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())))
        self.least.append(int(self.ids[own].min()))
        self.kids.append(())
        if hi - lo > LEAF and self.radius[at] > 0:
            far = x[np.argmax(((x - centre) ** 2).sum(axis=1))]
            other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
            self.order[lo:hi] = own[np.argsort(x @ (other - far), kind="stable")]
            mid = (lo + hi) // 2
            self.kids[at] = (self._build(lo, mid), self._build(mid, hi))
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best per query, ties to the smaller id, among
        those that reach ``floor``; missing ones have id -1."""
        nq = len(query_ids)
        plain = _fits_double(self.x, queries)
        best = np.full((nq, k), -np.inf, dtype=np.float64 if plain else object)
        best_id = np.full((nq, k), -1, dtype=np.int64)
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))
        centre, radius = np.stack(self.centre), np.array(self.radius)
        slack = 1e-9 * (length[:, None] * (np.sqrt((centre**2).sum(axis=1)) + radius)) + 1e-6
        bound = q @ centre.T + length[:, None] * radius + slack
        heap = [(-float(bound[:, 0].max(initial=-np.inf)), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kth = np.maximum(best[:, -1].astype(np.float64), floor)
            alive = np.flatnonzero(bound[:, node] >= kth)
            if not len(alive):
                continue
            lo, hi = self.lo[node], self.hi[node]
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-float(bound[alive, kid].max()), kid))
                continue
            # a ball of one point ties at best: useless unless an id is smaller
            if self.radius[node] == 0:
                exact = _products(queries[alive], self.x[lo: lo + 1], plain)[:, 0]
                alive = alive[(exact > best[alive, -1]) | (self.least[node] < best_id[alive, -1]) | (best_id[alive, -1] < 0)]
                if not len(alive):
                    continue
            ids = self.ids[lo:hi]
            score = _products(queries[alive], self.x[lo:hi], plain)
            score[ids[None, :] == query_ids[alive][:, None]] = -np.inf
            self._merge(best, best_id, alive, score, ids, k)
        return best, best_id

    @staticmethod
    def _merge(best, best_id, alive, score, ids, k):
        score = np.concatenate([best[alive], score], axis=1)
        ids = np.concatenate([best_id[alive], np.broadcast_to(ids, (len(alive), len(ids)))], axis=1)
        ids = np.where(score == -np.inf, np.iinfo(np.int64).max, ids)
        first = np.argsort(ids, axis=1, kind="stable")
        order = np.take_along_axis(first, np.argsort(-np.take_along_axis(score, first, 1), axis=1, kind="stable"), 1)[:, :k]
        best[alive] = np.take_along_axis(score, order, 1)
        got = np.take_along_axis(ids, order, 1)
        best_id[alive] = np.where(best[alive] == -np.inf, -1, got)


def _matrix(column) -> np.ndarray:
    """Integer vectors of a shard, shorter ones filled with zeros."""
    rows = [np.asarray(v, dtype=np.int64) for v in column.to_pylist()]
    width = max((len(v) for v in rows), default=0)
    out = np.zeros((len(rows), max(width, 1)), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _digits(m: np.ndarray) -> list[np.ndarray]:
    """Planes d with m = sum of d[i] << (i * DIGIT_BITS); the last has the sign."""
    planes = []
    while True:
        high = m >> DIGIT_BITS
        if not len(m) or ((high == 0) | (high == -1)).all():
            return [*planes, m.astype(np.float64)]
        planes.append((m & ((1 << DIGIT_BITS) - 1)).astype(np.float64))
        m = high


def _products(queries: np.ndarray, x: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of all queries with all vectors, as doubles where these are
    exact, else as Python integers."""
    if exact_in_double:
        return queries.astype(np.float64) @ x.astype(np.float64).T
    out = np.zeros((len(queries), len(x)), dtype=object)
    for i, a in enumerate(_digits(queries)):
        for j, b in enumerate(_digits(x)):
            out += (a @ b.T).astype(np.int64).astype(object) * (1 << (DIGIT_BITS * (i + j)))
    return out


def _fits_double(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether no partial sum of a score can pass 2**53."""
    top = [max((abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))) for m in (x, q)]
    return top[0] * top[1] * x.shape[1] < 2**53


def _answer(k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], _SCORE)})
    if not len(left) or not len(right):
        return empty
    x, q = _matrix(left.column("v")), _matrix(right.column("w"))
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    tree = BallTree(left.column("vec_id").to_numpy(), x)
    out = []
    query_ids = right.column("query_id").to_numpy()
    floor = right.column("floor").to_numpy(zero_copy_only=False)
    floor = np.where(np.isnan(floor.astype(np.float64)), -np.inf, floor.astype(np.float64))
    for lo in range(0, len(q), QUERY_ROWS):
        ids = query_ids[lo: lo + QUERY_ROWS]
        score, found = tree.search(ids, q[lo: lo + QUERY_ROWS], k, floor[lo: lo + QUERY_ROWS])
        i, j = np.nonzero(score != -np.inf)
        out.append(pa.table({"query_id": pa.array(ids[i], pa.int64()), "vec_id": pa.array(found[i, j], pa.int64()), "score": pa.array([Decimal(int(s)) for s in score[i, j]], _SCORE)}))
    return pa.concat_tables(out) if out else empty


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with the other
    rows, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.  Components become
    floor(256 x); shorter vectors count as filled with zeros.  Vectors that are
    null or hold a null or non-finite component, and rows without an id, take no
    part.  Integers beyond 2**55 count as that; a score is an exact decimal of 38
    digits.  A row that repeats (equal id and vector) counts once; an id's own rows
    are no candidates of it.  Fewer than ``k`` candidates: all of them.  Returns
    (query_id, rank, vec_id, score).
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
            .filter("vec_id is not null and x is not null")
            .filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
            .select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")).alias("v")).distinct())
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    rows = stage(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), "vectors")
    queries = rows.filter(is_query)
    groups = max(1, -(-queries.count() // (8 * QUERY_ROWS)))
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")

    def dealt(frame: DataFrame) -> DataFrame:
        """The shards' vectors, once for each group of queries."""
        return frame.select("vec_id", "v", "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(asked: DataFrame) -> DataFrame:
        return (dealt(rows).groupBy("shard", "group").cogroup(asked.groupBy("shard", "group"))
                .applyInArrow(lambda a, b: _answer(k, a, b), _FOUND))

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), F.col("shard").alias("own"), group.alias("group"))
    own = stage(search(asked.withColumnRenamed("own", "shard").withColumn("floor", F.lit(None).cast("double"))), "own")
    found = own
    if shards > 1:
        kth = own.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("m")).filter(F.col("c") >= k).select("query_id", F.col("m").cast("double").alias("floor"))
        others = asked.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> own").drop("own")
        found = own.unionByName(search(others))
    ranked = found.distinct().withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
