"""Whitening of embeddings by a bidiagonal singular value decomposition.

The covariance matrix is never formed.  Tasks reduce their centred rows to a
triangle by blockwise Householder QR, triangles are stacked and reduced in rounds
until one is left.  Householder reflections bring it to upper bidiagonal form; the
dqds iteration finds its singular values to high relative accuracy; for each of the
first ones a twisted factorisation of the shifted tridiagonal matrix gives the
direction, which is carried back through the reflections.

Vectors are integers (floor(256 x)), so rows are centred exactly: n x - S.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.negatives import integer_vectors
from tallyframe.session import stage

#: Rows that are added to a task's triangle at a time, in multiples of the width, and
#: triangles that one task stacks.
ROWS_PER_WIDTH = 8
FAN_IN = 16
_EPS = np.finfo(np.float64).eps
_WIDE = pa.decimal128(38, 0)


# ---- the solver: one triangle of the width, in one task ----------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflections of the upper bidiagonal form of a
    square matrix; reflection j is I - 2 v v' and acts on the columns from j + 1."""
    a = np.array(r, dtype=np.float64)
    d = len(a)
    right = []

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return np.zeros_like(x)
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for j in range(d):
        v = reflection(a[j:, j])
        a[j:, j:] -= 2 * np.outer(v, v @ a[j:, j:])
        if j < d - 1:
            w = reflection(a[j, j + 1:])
            a[j:, j + 1:] -= 2 * np.outer(a[j:, j + 1:] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_sweep(q: list[float], e: list[float], lo: int, hi: int, shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform of the rows lo..hi; also the least of its running
    remainders, negative where the shift was too large."""
    new_q, new_e = [], []
    d = q[lo] - shift
    least = d
    for i in range(lo, hi):
        s = d + e[i]
        if s == 0:
            return new_q, new_e, -1.0
        new_q.append(s)
        t = q[i + 1] / s
        new_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def dqds(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    q = [float(x) ** 2 for x in diagonal]
    e = [float(x) ** 2 for x in beside]
    least_q = 1e-280 * max(q + e, default=0.0)  # below that quotients overflow
    q, e = [x if x > least_q else 0.0 for x in q], [x if x > least_q else 0.0 for x in e]
    found = []
    blocks = [(0, len(q) - 1, 0.0)]
    while blocks:
        lo, hi, moved = blocks.pop()
        shift = 0.0
        while lo <= hi:
            # a superdiagonal entry that no singular value can feel splits the block
            cut = next((i for i in range(hi - 1, lo - 1, -1) if e[i] <= _EPS**2 * (moved + min(q[i], q[i + 1])) or e[i] == 0), None)
            if hi == lo:
                found.append(moved + q[lo])
                break
            if cut is not None:
                e[cut] = 0.0
                blocks.append((lo, cut, moved))
                lo = cut + 1
                shift = 0.0
                continue
            if hi - lo == 1:  # two by two, by the sum and the product
                a, b, c = q[lo], q[hi], e[lo]
                big = 0.5 * (a + b + c + np.sqrt((a - b) ** 2 + c * (2 * (a + b) + c)))
                found += [moved + big, moved + (a * (b / big) if big else 0.0)]
                break
            new_q, new_e, least = _dqds_sweep(q, e, lo, hi, shift)
            if least < 0:  # too far: from the same place with less, at last with none
                shift = 0.25 * shift if shift > _EPS * min(q[lo: hi + 1]) else 0.0
                if shift == 0.0:
                    new_q, new_e, least = _dqds_sweep(q, e, lo, hi, 0.0)
                    if least < 0:  # rows of zeros
                        found.extend([moved + max(0.0, x) for x in q[lo: hi + 1]])
                        break
                else:
                    continue
            q[lo: hi + 1], e[lo: hi] = new_q, new_e
            moved += shift
            # the end decouples first: the next shift is a lower bound of its least value
            last, above, link = q[hi], q[hi - 1], e[hi - 1]
            shift = max(0.0, 0.98 * min(least, last - np.sqrt(link * last) if link < last else 0.0, above))
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, beside: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector of B'B for the eigenvalue ``value``: both factorisations of the shifted
    matrix, joined where their remainder is least; also that remainder per length."""
    d = len(diagonal)
    q, e = diagonal**2, beside**2  # B'B = L D L' with D = q, L = beside / diagonal
    tiny = _EPS**2 * max(float(q.max(initial=0.0)), np.finfo(float).tiny) + np.finfo(float).tiny
    # downwards (stationary) and upwards (progressive) transforms of q, e
    s, p = np.empty(d), np.empty(d)
    plus, minus = np.empty(d), np.empty(d)
    s[0] = -value
    for i in range(d - 1):
        plus[i] = s[i] + q[i]
        plus[i] = plus[i] if plus[i] != 0 else tiny
        s[i + 1] = s[i] * (e[i] / plus[i]) - value
    p[d - 1] = q[d - 1] - value
    for i in range(d - 2, -1, -1):
        minus[i + 1] = e[i] + p[i + 1]
        minus[i + 1] = minus[i + 1] if minus[i + 1] != 0 else tiny
        p[i] = p[i + 1] * (q[i] / minus[i + 1]) - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(d)
    z[r] = 1.0
    off = diagonal[:-1] * beside  # off-diagonal of B'B
    for i in range(r - 1, -1, -1):
        z[i] = -(off[i] / plus[i]) * z[i + 1]
    for i in range(r + 1, d):
        z[i] = -(off[i - 1] / minus[i]) * z[i - 1]
    size = float(np.linalg.norm(z))
    return z / size, abs(float(gamma[r])) / size


def _tridiagonal(diagonal: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    main = diagonal**2
    main[1:] += beside**2
    return main, diagonal[:-1] * beside


def right_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, directions as rows, sum of all squares) of the first
    ``k`` components of a square matrix; values that rounding alone can make are no
    components."""
    size = float(np.abs(r).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((0, len(r))), 0.0
    diagonal, beside, right = bidiagonalise(r / size)
    values = dqds(diagonal, beside)
    total = float(values.sum())
    values = values[:k][values[:k] > (len(r) * _EPS) ** 2 * values[0]]
    # blocks between entries that are zero beside their neighbours
    small = np.abs(beside) <= _EPS * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    edges = [0, *(np.flatnonzero(small) + 1).tolist(), len(diagonal)]
    choices = []  # (distance, value number, vector, block) of every block's own values
    for lo, hi in zip(edges, edges[1:]):
        own = dqds(diagonal[lo:hi], beside[lo: hi - 1])[:k]
        choices += [(v, lo, hi) for v in own]
    choices = sorted(choices, reverse=True)[: len(values)]
    vectors: list[np.ndarray] = []
    for j, (value, lo, hi) in enumerate(choices):
        z = np.zeros(len(diagonal))
        z[lo:hi], _ = _twisted(diagonal[lo:hi], beside[lo: hi - 1], value)
        near = [v for (other, a, _), v in zip(choices, vectors) if a == lo and abs(other - value) <= 1e-3 * value]
        if near:  # values close together: the factorisation alone does not part them
            z = _apart(diagonal[lo:hi], beside[lo: hi - 1], value, z[lo:hi], [v[lo:hi] for v in near], lo, len(diagonal))
        vectors.append(z)
    out = np.array(vectors)
    for j in range(len(right) - 1, -1, -1):
        w = right[j]
        out[:, j + 1:] -= 2 * np.outer(out[:, j + 1:] @ w, w)
    return values * size**2, out / np.linalg.norm(out, axis=1)[:, None], total * size**2


def _apart(diagonal, beside, value, z, near, lo, d) -> np.ndarray:
    """Inverse iteration from ``z`` beside vectors of close values."""
    main, off = _tridiagonal(diagonal, beside)
    shifted = main - value
    for step in range(4):
        for v in near + near:
            z = z - (v @ z) * v
        size = np.linalg.norm(z)
        if size < 1e-8:  # the same direction: start from another
            z = np.cos(np.arange(len(z)) * (step + 1.0) + value)
            for v in near + near:
                z = z - (v @ z) * v
            size = np.linalg.norm(z)
        z = _solve(shifted, off, z / size)
        z = z / np.linalg.norm(z)
    for v in near + near:
        z = z - (v @ z) * v
    out = np.zeros(d)
    out[lo: lo + len(z)] = z / np.linalg.norm(z)
    return out


def _solve(main: np.ndarray, off: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A symmetric tridiagonal system by elimination with row exchanges."""
    n = len(main)
    a, c, c2, x = main.astype(float).copy(), np.append(off, 0.0), np.zeros(n), b.copy()
    tiny = _EPS * (np.abs(main).max() + np.abs(off).max(initial=0.0))
    for i in range(n - 1):
        low, nxt = off[i], c[i + 1]
        if abs(low) > abs(a[i]):
            f = a[i] / low
            a[i], c_i = low, a[i + 1]
            a[i + 1], c2[i], c[i + 1] = c[i] - f * c_i, nxt, -f * nxt
            c[i] = c_i
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            a[i] = a[i] if a[i] != 0 else tiny
            f = low / a[i]
            a[i + 1] -= f * c[i]
            x[i + 1] -= f * x[i]
    a[n - 1] = a[n - 1] if abs(a[n - 1]) > tiny else tiny
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (c[i] * x[i + 1] if i + 1 < n else 0.0) - (c2[i] * x[i + 2] if i + 2 < n else 0.0)) / a[i]
    return x


# ---- rows, in tasks ----------------------------------------------------------

def _dense(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, row in enumerate(column):
        own = row.values.to_numpy()
        out[i, : len(own)] = own
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: longs where these hold it, else Python integers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    bound = n * largest + max((abs(s) for s in sums), default=0)
    if bound < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _triangles(width: int, n: int, sums: list[int]):
    step = max(1, ROWS_PER_WIDTH * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for lo in range(0, len(batch), step):
                    yield _centred(_dense(batch.column(0).slice(lo, step), width), n, sums).astype(np.float64) / n

        r = _triangle(blocks(), width)
        if r.any():
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
    return run


def _stacked(width: int):
    def run(t: pa.Table) -> pa.Table:
        r = _triangle((np.frombuffer(x.as_py()).reshape(width, width) for x in t.column("r")), width)
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})
    return run


def _solved(width: int, k: int):
    """Components of the one triangle: (component, squared singular value, sum of all, direction)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("r"):
                values, u, total = right_directions(np.frombuffer(x.as_py()).reshape(width, width), k)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(values) + 1), pa.int32()), pa.array(values), pa.array([total] * len(values)),
                                                      pa.array(u.tolist(), pa.list_(pa.float64()))], ["component", "square", "total", "direction"])
    return run


def _projected(width: int, n: int, sums: list[int], scaled: np.ndarray):
    """(vec_id, deviation, whitened) per row; ``scaled`` are directions over n sqrt(e)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(_dense(batch.column(1), width), n, sums)
            if c.dtype != object and (int(np.abs(c).max(initial=0)) ** 2) * width >= 2**63:
                deviation = pa.array([sum(int(v) ** 2 for v in row) for row in c], _WIDE)
            else:
                deviation = pa.array([int(v) for v in (c * c).sum(axis=1)], _WIDE)
            w = c.astype(np.float64) @ scaled.T
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])
    return run


def _moments(width: int, n: int, sums: list[int], scaled: np.ndarray):
    """A task's sums of whitened values and of their products, as (a, b, sum)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(scaled)
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _centred(_dense(batch.column(0), width), n, sums).astype(np.float64) @ scaled.T
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        a, b = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], ["a", "b", "s"])
    return run


def whitening(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every row on the first principal components.

    Vectors become floor(256 x); shorter ones count as filled with zeros.  Rows whose
    vector is null or holds a null or non-finite component go.  The fit uses each
    distinct vector once: n of them with sums S.  Components are the unit
    eigenvectors of the covariance (divisor n) by falling eigenvalue e; their sign is
    free but the same for all rows.  Directions without variance beyond rounding are
    no components: with fewer of them than asked for all are returned, with none (an
    empty table, one distinct vector) no rows.  Repeated rows, null ids and other
    columns are kept apart from the fit and change nothing.

    Returns, per row and component, (id, component, n, deviation decimal(38,0),
    whitened, explained, identity_error): deviation is the exact sum of (n x - S)^2,
    whitened the projection of x - S/n over sqrt(e), explained e over the trace, and
    identity_error the largest entry of the whitened fit list's covariance less the
    identity.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.select(F.col(id_col).alias("vec_id"), integer_vectors(vector_col).alias("v")).filter("v is not null"), "rows")
    width = int(rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])  # one number
    filled = F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v"))
    fit = stage(rows.select(filled.alias("v")).distinct(), "fit")
    n = fit.count()
    schema = f"{id_col} {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    # one sum per dimension, from a partial sum of every task
    sums = (fit.mapInArrow(_partial_sums(width), "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))).collect() if width else []
    sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    solved = []
    if n and width:
        triangles = stage(fit.mapInArrow(_triangles(width, n, sums), "r binary"), "triangles")
        while (left := triangles.count()) > 1:
            groups = -(-left // FAN_IN)
            dealt = triangles.withColumn("g", F.pmod(F.xxhash64("r", F.lit(left)), F.lit(groups)))
            triangles = stage(dealt.groupBy("g").applyInArrow(_stacked(width), "r binary"), "triangles")
        solved = triangles.mapInArrow(_solved(width, components), "component int, square double, total double, direction array<double>").collect()  # ``components`` rows
    if not solved:
        return spark.createDataFrame([], schema)
    solved.sort(key=lambda r: r["component"])
    # squares are of rows x - S/n: e = square / n
    scaled = np.array([r["direction"] for r in solved]) / (n * np.sqrt(np.array([r["square"] for r in solved]) / n))[:, None]
    k = len(solved)
    moment = {(r["a"], r["b"]): r["s"] / n for r in fit.mapInArrow(_moments(width, n, sums, scaled), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()}
    error = max(abs(moment[a, b] - moment[k, a] * moment[k, b] - (a == b)) for a in range(k) for b in range(k))
    explained = F.array(*[F.lit(r["square"] / r["total"]) for r in solved])
    out = rows.mapInArrow(_projected(width, n, sums, scaled), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    return out.select(F.col("vec_id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _partial_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _dense(batch.column(0), width)
            if int(max(x.max(initial=0), -x.min(initial=0))) * len(x) >= 2**62:
                x = x.astype(object)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0))] if len(x) else total
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, _WIDE)], ["at", "s"])
    return run
