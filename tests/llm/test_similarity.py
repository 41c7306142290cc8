import random

import numpy as np
import pytest

from tallyframe.llm import similarity
from tallyframe.llm.similarity import ngram_jaccard_join
from tests.llm.brute import components, with_clash

SCHEMA = "doc_id long, text string"


def family(rng, n, changes, length=60):
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = " ".join(f"line{i}" for i in range(20))
    texts = [t for n in (2, 5, 40) for t in family(rng, n, 4)]
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    texts += ["a b", "A B", "a", "", " \t\n", "a b c d", "a b c d e", "a b c d e f", texts[0], texts[0].upper().lower()]
    texts += [" ".join(f"s{i % n}" for i in range(60)) for n in (1, 2, 3)]
    return dict(enumerate(texts))


@pytest.mark.parametrize(("k", "percent", "rows"), [(4, 85, 1024), (5, 80, 8)])
def test_links_equal_brute_force(spark, monkeypatch, k, percent, rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", rows)  # small blocks: products between blocks and bands
    docs = corpus(k)
    df = with_clash(spark.createDataFrame(list(docs.items()), SCHEMA).repartition(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, words=k, percent=percent).collect()}
    assert got == components(docs, k, percent)


def test_nulls_repeats_and_long_texts(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (8, long_text), (3, long_text + " z"), (None, None)]
    got = [tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), words=4, percent=85).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 59_997, 3), (3, 59_998, 3), (None, 0, None)], key=str)


def test_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, a), (2, a), (2, b), (3, b + " c")]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), words=4, percent=85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(spark):
    got = ngram_jaccard_join(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert got.count() == 0


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(rng.uniform(0, 0.16) * len(a))
        b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 8, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            linked += 1
            some = rng.uniform(0, 1)  # this share of all columns is common
            parts = [{x for i in (0, 1) for x in similarity.part_hashes(s, similarity.mix(s) < np.uint64(int(some * 2**64)), similarity.band_of(len(s), 85) + i, 85).tolist()}
                     for s in (a, b)]
            assert parts[0] & parts[1]
    assert linked > 200


def test_common_counters_stand_out():
    counts = np.random.default_rng(0).poisson(50, similarity.SLOTS)
    counts[:10] += 100
    found = similarity.common_slots(counts, int(counts.sum()))
    assert found[:10].all() and found.mean() < 1e-4


def test_words_that_sums_of_powers_take_as_equal(spark):
    from tests.llm.test_substrings import thue_morse
    a, b = thue_morse(1024)
    docs = {1: " ".join([a] * 6), 2: " ".join([b] * 6), 3: " ".join([a] * 6)}
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), words=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_long_path_is_one_component(spark):
    from tallyframe.llm.graph import connected_components
    n = 1500
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = connected_components(links).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}


def test_linked_sets_share_as_many_parts_as_are_asked():
    rng = np.random.default_rng(2)
    linked = 0
    for k in range(600):
        percent = (80, 85)[k % 2]
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(rng.uniform(0, 0.21) * len(a))
        b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        linked += 1
        some = rng.uniform(0, 1)  # this share of all columns is common
        parts = [np.concatenate([similarity.part_hashes(s, similarity.mix(s) < np.uint64(int(some * 2**64)), similarity.band_of(len(s), percent) + i, percent) for i in (0, 1)])
                 for s in (a, b)]
        equal = np.intersect1d(*parts)
        assert len(equal) and len(equal) >= similarity.asked(equal).min()
    assert linked > 200


def test_equal_parts_are_counted_over_flushes_and_buckets():
    from tallyframe.llm import blobs
    rng = np.random.default_rng(3)
    ids = rng.integers(-2**62, 2**62, 60)
    keys = {}  # key: (asked, ids); equal keys of a pair count, hot keys chain
    for k in range(400):
        number = (1, 2, 3, 5)[k % 4]
        size = int(rng.integers(1, 5)) if k % 50 else 30
        keys[(int(rng.integers(0, 2**58)) << 6) | number] = (number, {int(x) for x in rng.choice(ids[:40] if number > 1 else ids, size, replace=False)})
    same, links = {}, set()
    for number, members in keys.values():
        m = sorted(members)
        if number == 1 or len(m) > similarity.GROUP:
            links |= {(m[0], x) for x in m[1:]}
        else:
            for i, x in enumerate(m):
                for y in m[i + 1:]:
                    n, r = same.get((x, y), (0, number))
                    same[x, y] = (n + 1, min(r, number))
    links |= {p for p, (n, r) in same.items() if n >= r}
    want = dict(zip(*(x.tolist() for x in blobs.stars(*(np.array(c) for c in zip(*links)))[::-1])))
    entries = [(h, d) for h, (_, m) in keys.items() for d in m] * 2  # rows that come twice
    random.Random(4).shuffle(entries)
    batches, box = [], blobs.Combiner(5, keep="id", most=lambda h: np.where(similarity.asked(h) > 1, similarity.GROUP + 1, 1))
    for i in range(0, len(entries), 200):
        h, d = zip(*entries[i: i + 200])
        box.add(np.array(h, dtype=np.uint64), np.array(d, dtype=np.int64))
        batches += box.flush()
    pa, table = similarity.pa, similarity.pa.Table.from_batches(batches)

    def groups(table, key):
        return [table.filter(pa.array([x == k for x in table.column(key).to_pylist()])) for k in sorted(set(table.column(key).to_pylist()))]

    lots = pa.concat_tables([similarity._chain(3)(t) for t in groups(table, "bucket")])
    found = [(r["a"], r["b"]) for t in groups(lots, "lot") for r in similarity._settle(t).to_pylist()]
    assert dict(zip(*(x.tolist() for x in blobs.stars(*(np.array(c) for c in zip(*found)))[::-1]))) == want


def test_documents_that_share_passages_make_no_cluster(spark, monkeypatch):
    rng, staged = random.Random(6), {}
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(48)) for _ in range(1000)]
    docs = {i: " ".join(passages[3 * i: 3 * i + 5]) for i in range(300)}  # two of five are the next document's
    stage = similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got == {i: i for i in docs}
    assert staged["members"].count() < 120  # 298 where one equal part chains


def test_counters_are_sent_small():
    rng = np.random.default_rng(5)
    text = similarity.pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**6, 20_000)) for _ in range(20)])
    batch = similarity.pa.RecordBatch.from_arrays([similarity.pa.array(range(20)), text], ["doc_id", "text"])
    rows = [r for b in similarity._profiles(5)([batch]) for r in b.to_pylist() if r["slice"] is not None]
    assert sum(len(x) for r in rows for x in r.values() if isinstance(x, bytes)) < 1_000_000
    counts = np.array([0, 1, 255, 256, 65535, 70000], dtype=np.uint32)
    assert similarity.unpacked_counts(similarity.packed_counts(counts)).tolist() == [0, 1, 255, 256, 65535, 65535]
