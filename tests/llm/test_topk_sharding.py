import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.sharding import Shard, even_tree, grown, shard_rows
from tallyframe.llm.topk import exact_top_k
from tests.llm.brute import with_clash

VECTORS = "vec_id long, embedding array<float>"
DOCS = "doc_id long, text string"


def brute_top(rows, k, every):
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in ints.items():
        if q % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ints.items() if i != q)[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows_", [40, 10_000])
def test_top_k_equals_brute_force(spark, shard_rows_):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]  # one vector many times: ties
    rows += [(601, None), (602, [None, 1.0]), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (None, [0.1] * 8), (605, [0.5, -0.5]), (650, []), rows[10]]
    df = with_clash(spark.createDataFrame(rows, VECTORS))
    got = sorted(tuple(r) for r in exact_top_k(df, F.expr("vec_id % 50 = 0"), k=5, shard_rows=shard_rows_).collect())
    assert got == brute_top(rows, 5, 50)


@pytest.mark.parametrize("size", [5e6, 1e12, 1e14])
def test_scores_beyond_a_double_are_exact(spark, size):
    rng = random.Random(7)
    near = [size * rng.uniform(0.5, 1) for _ in range(6)]
    rows = [(i, [x * rng.choice([1, 1 - 2**-40, -1]) for x in near]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = [(q, r + 1, i, -n) for q in range(0, 160, 50)
            for r, (n, i) in enumerate(sorted((-sum(x * y for x, y in zip(ints[q], b, strict=True)), i) for i, b in ints.items() if i != q)[:5])]
    assert sorted(tuple(r) for r in exact_top_k(df, F.expr("vec_id % 50 = 0"), k=5, shard_rows=40).collect()) == sorted(want)


def test_components_are_cut_at_the_largest(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1e300])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(df, F.expr("vec_id = 0")).collect()] == [(0, 1, 2, 2**110), (0, 2, 1, -(2**110))]


def test_top_k_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS)
    assert [tuple(r) for r in exact_top_k(df, F.expr("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert exact_top_k(spark.createDataFrame([], VECTORS), F.expr("vec_id = 0")).count() == 0


def test_shards(spark):
    rows = [(i, "text" * (i % 7)) for i in range(3000)] + [(None, "n"), (None, None), (5, "again"), (6, None), (7, "é" * 50_000)]
    tree = even_tree(8)
    got = shard_rows(with_clash(spark.createDataFrame(rows, DOCS)), tree, grown(tree)).collect()
    assert len(got) == len(rows)
    sizes = Counter((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == sizes
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.35 * min(counts.values())
    assert 0.06 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.17
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def placed(key, tree):
    """The shard of a row in plain Python: at every level the least of the weighted draws."""
    import hashlib
    import math

    live, path, level = [s for s in tree if s.weight > 0], "", 0
    while level < 3:
        parts = {}
        for s in live:
            parts.setdefault((s.region, s.rack, str(s.shard))[level], []).append(s)

        def draw(node):
            bits = int(hashlib.md5(f"{key}|{path}/{node}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 0.5) / 2**52) / sum(s.weight for s in parts[node])

        node = next(iter(parts)) if len(parts) == 1 else min(parts, key=draw)
        live, path, level = parts[node], f"{path}/{node}", level + 1
    return live[0].shard


def test_placement_equals_plain_python(spark):
    df = spark.range(-500, 1500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = [Shard(s.region, s.rack, s.shard, 0.25 + s.shard % 3) for s in even_tree(8)]
    more = grown(tree, 0.5)
    for r in shard_rows(df, tree, more).collect():
        assert (r.shard, r.grown_shard) == (placed(r.doc_id, tree), placed(r.doc_id, more))


def test_weights_move_rows_within_their_subtree(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = even_tree(8)
    heavier = [Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 1 else 1.0) for s in tree]
    got = shard_rows(df, tree, heavier).collect()
    # shard 1 is in rack 0 of region 0: rows leave other shards only towards region 0, and within rack 0 towards shard 1
    assert all(r.grown_shard < 4 for r in got if r.shard != r.grown_shard)
    assert not any(r.shard == 1 and r.grown_shard == 0 for r in got)
    none = shard_rows(df, tree, [Shard(s.region, s.rack, s.shard, 0.0 if s.shard == 3 else 1.0) for s in tree]).collect()
    assert not any(r.grown_shard == 3 for r in none)
    with pytest.raises(ValueError):
        shard_rows(df, [], tree)


def test_no_rows(spark):
    assert shard_rows(spark.createDataFrame([], DOCS), even_tree(2), even_tree(3)).count() == 0
