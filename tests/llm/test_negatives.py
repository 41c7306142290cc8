import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import negatives as N
from tests.llm.brute import with_clash

ROWS = "vec_id long, embedding array<double>, label int"


def integers(v):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(max(-2.0**55, min(2.0**55, 256 * x)))) for x in v]


def brute(rows, every, k, m, low, high):
    by_id = {}
    for i, v, label in rows:
        x = integers(v)
        if i is not None and label is not None and x is not None:
            by_id[i] = min(by_id.get(i, (str(label), x)), (str(label), x))
    out = []
    for a, (label, x) in by_id.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in by_id.items() if i != a}
        same = sorted((-score[i], i) for i in score if by_id[i][0] == label)[:k]
        for s, p in same:
            other = sorted((-score[i], i) for i in score if by_id[i][0] != label and low * -s <= 100 * score[i] <= high * -s)[:m]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(other)]
    return sorted(out)


def run(spark, rows, shard_rows=16_384, every=10, k=5, m=3, low=50, high=95):
    df = with_clash(spark.createDataFrame(rows, ROWS))
    got = N.hard_negatives(df, F.expr(f"vec_id % {every} = 0"), F.col("label"), k, m, low, high, shard_rows=shard_rows).collect()
    return sorted((r[0], r[1], r[2], r[3], int(r[4]), int(r[5])) for r in got)


@pytest.mark.parametrize("shard_rows", [60, 16_384])
def test_equals_brute_force(spark, shard_rows):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(11)], rng.randrange(3)) for i in range(300)]
    rows += [(i, rows[0][1], i % 2) for i in range(300, 400)]  # one vector many times: ties
    rows += [(501, None, 1), (502, [None, 1.0], 1), (503, [float("nan")] * 3, 1), (504, [float("-inf")], 1), (None, [0.1] * 11, 1),
             (505, [0.5, -0.5], 2), (510, [], 1), (520, [0.9] * 11, None), rows[20], (30, rows[1][1], 0)]
    assert run(spark, rows, shard_rows) == brute(rows, 10, 5, 3, 50, 95)


def test_blocks_smaller_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(N, "ROW_BLOCK", 7)
    monkeypatch.setattr(N, "ANCHOR_BLOCK", 3)
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5]) for _ in range(5)], rng.randrange(2)) for i in range(120)]
    df = spark.createDataFrame(rows, ROWS).select("vec_id", F.col("label").cast("string").alias("label"), N.integer_vectors("embedding").alias("v")).collect()
    x = np.array([r["v"] for r in df])
    import pyarrow as pa
    planes = N.pack_planes(x, 9)
    t = pa.table({"vec_id": pa.array([r["vec_id"] for r in df], pa.int64()), "label": [r["label"] for r in df], "planes": pa.array([p.tobytes() for p in planes], pa.binary())})
    anchors = t.slice(0, 40)
    got = N._positives(4, 9, 1, t, anchors).to_pylist()
    for a in range(40):
        s = sorted((-int(x[a] @ x[i]), df[i]["vec_id"]) for i in range(120) if i != a and df[i]["label"] == df[a]["label"])[:4]
        assert sorted((-int(r["score"]), r["positive_id"]) for r in got if r["anchor_id"] == df[a]["vec_id"]) == s


def test_many_labels_and_hot_label(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(8)], 0 if i % 3 else i) for i in range(240)]
    assert run(spark, rows, 50) == brute(rows, 10, 5, 3, 50, 95)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    for size in (1e4, 5e6, 1e15, 1e300):
        rows = [(i, [rng.uniform(-1, 1) * size for _ in range(9)], i % 2) for i in range(60)]
        assert run(spark, rows) == brute(rows, 10, 5, 3, 50, 95)


def test_other_bands_and_counts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], i % 4) for i in range(150)]
    assert run(spark, rows, k=2, m=7, low=-20, high=130) == brute(rows, 10, 2, 7, -20, 130)


def test_empty_few_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(1, [1.0], 1), (2, [0.6], 2)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 2)]) == [(0, 1, 1, 2, 65536, 256 * 153)]


def test_planes_round_trip():
    x = np.random.default_rng(1).integers(-2**40, 2**40, (50, 13))
    assert (N.unpack_planes(N.pack_planes(x, 41))[:, :13] == x).all()
    table = N.subset_sums(np.arange(16, dtype=np.int64)[None, :], np.int64)
    assert table[1, 0b10000001, 0] == 8 + 15
