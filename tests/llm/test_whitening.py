import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import whitening as W
from tests.llm.brute import with_clash

ROWS = "vec_id long, embedding array<double>"


def padded(a):
    r = np.linalg.qr(a, mode="r")
    return np.concatenate([r, np.zeros((a.shape[1] - len(r), a.shape[1]))]) if len(r) < a.shape[1] else r


def cases():
    rng = np.random.default_rng(0)
    left, right = np.linalg.qr(rng.normal(size=(200, 40)))[0], np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield rng.normal(size=(300, 64))
    yield rng.normal(size=(20_000, 32))  # close values
    yield np.eye(20) * 3
    yield np.kron(np.eye(4), rng.normal(size=(8, 8)))
    yield left @ np.diag([5.0] * 4 + [1] * 36) @ right
    yield left @ np.diag([5, 5 - 1e-9, 5 - 2e-13, 5 - 3e-13] + [1] * 36) @ right
    yield left @ np.diag(10.0 ** -np.arange(40)) @ right
    yield rng.normal(size=(100, 2)) @ rng.normal(size=(2, 30))
    yield rng.normal(size=(3, 30))
    yield np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    for _ in range(200):
        d = int(rng.integers(1, 12))
        a = np.floor(rng.normal(size=(int(rng.integers(1, 20)), d)) * rng.choice([1, 3, 100]))
        a -= a.mean(0)
        if rng.random() < 0.3:
            a[:, rng.integers(0, d)] = 0
        yield a


def test_solver_against_svd():
    for a in cases():
        values, u, total = W.right_directions(padded(a), 4)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        if not len(values):
            assert want[0] < 1e-20
            continue
        gram = a.T @ a
        assert np.allclose(values, want[: len(values)], rtol=1e-11, atol=1e-14 * want[0])
        assert np.isclose(total, want.sum(), rtol=1e-12)
        assert np.abs(gram @ u.T - u.T * values).max() < 1e-12 * want[0]
        assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-10
        assert (want[len(values): 4] < 1e-20 * want[0]).all()


def test_small_singular_values_are_accurate():
    """Of a bidiagonal matrix dqds finds also the least ones to many digits."""
    import decimal
    diagonal, beside = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = W.dqds(diagonal, beside)
    with decimal.localcontext(decimal.Context(prec=60)):
        product = decimal.Decimal(1)
        for x in got:
            product *= decimal.Decimal(float(x))
        want = decimal.Decimal(1)
        for x in diagonal:
            want *= decimal.Decimal(float(x)) ** 2
    assert abs(product / want - 1) < decimal.Decimal(1e-13)


def brute(rows, k):
    keep = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in keep), default=0)
    x = [[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in keep]
    fit = [list(t) for t in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=float).reshape(n, width) / max(n, 1)
    e, u = np.linalg.eigh(c.T @ c / max(n, 1))
    e, u = e[::-1], u[:, ::-1]
    out = [(i, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)),
            (np.array([n * a - s for a, s in zip(v, sums)], dtype=float) / n) @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))) for (i, _), v in zip(keep, x)]
    return out, e[:k] / e.sum()


def check(spark, rows, k=4):
    got = W.whitening(with_clash(spark.createDataFrame(rows, ROWS)), k).collect()
    want, explained = brute(rows, k)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    for c, rs in by_component.items():
        ours = sorted(((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"]), r["n"], r["whitened"]) for r in rs))
        theirs = sorted(((i is None, i or 0, d, n, w[c - 1]) for i, n, d, w in want))
        assert [o[:4] for o in ours] == [t[:4] for t in theirs]
        a, b = np.array([o[4] for o in ours]), np.array([t[4] for t in theirs])
        a, b = np.sort(a), np.sort(b * (1 if a @ b >= 0 else -1))
        assert np.allclose(a, b, atol=1e-8)
        assert np.isclose(rs[0]["explained"], explained[c - 1], rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)  # several rounds
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.1 + j / 9) for j in range(7)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector very often: once in the fit
    rows += [(2001, None), (2002, [None, 0.1]), (2003, [float("nan")] * 7), (2004, [float("inf")]), (None, [0.3] * 7), (2005, [0.2]), (2006, []), rows[5]]
    check(spark, rows)


def test_large_components(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.gauss(0, 1) * 5e6 * (j + 1) for j in range(5)]) for i in range(80)])


def test_fewer_components(spark):
    line = [(i, [0.25 * i, 0.5 * i, 0.0]) for i in range(20)]
    got = W.whitening(spark.createDataFrame(line, ROWS)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20
    assert np.allclose(sorted(r["whitened"] for r in got), (np.arange(20) - 9.5) / np.std(np.arange(20)))
    for rows in ([], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])], [(1, None)]):
        assert W.whitening(spark.createDataFrame(rows, ROWS)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    from tallyframe.llm.queries import QUERIES
    got = QUERIES["op12_embedding_whitening"](spark, f"/root/testdata/{sf}")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want, _ = brute(rows, 4)
    one = {r["vec_id"]: r for r in got.filter(F.col("component") == 2).collect()}
    assert {i: (n, d) for i, n, d, _ in want} == {i: (r["n"], r["deviation"]) for i, r in one.items()}
    sign = np.sign(sum(one[i]["whitened"] * w[1] for i, _, _, w in want))
    assert all(abs(one[i]["whitened"] - sign * w[1]) < 1e-10 for i, _, _, w in want)
