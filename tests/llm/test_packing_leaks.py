import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyframe.llm import decontaminate
from tallyframe.llm.decontaminate import benchmark_leaks
from tallyframe.llm.packing import best_fit_packing, pack
from tests.llm.brute import with_clash, words

DOCS = "doc_id long, source string, text string"
ITEMS = "item_id long, text string"


def test_bins(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 40, 99, 100, 101, 250]))) for _ in range(300)]
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), t) for i, t in enumerate(texts)]
    rows += [(1000 + i, "d", texts[7].upper() if i % 2 else texts[7]) for i in range(20)] + [(None, "a", None), (None, "a", None), (5, "e", "x " * 30), (5, "e", "x " * 30)]
    df = with_clash(spark.createDataFrame(rows, DOCS))
    got = best_fit_packing(df, capacity=100, group_rows=120).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_group, r.bin].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) + b[0].room_left == 100
        assert len({r.source for r in b}) == len(b) and len({r.cluster for r in b}) == len(b)
    # every word of every row once
    have = sorted((str(r.doc_id), r.first_word, r.n_words) for r in got)
    want = []
    for d, _, t in rows:
        n = len(words(t))
        full = max(0, -(-n // 100) - 1)
        want += [(str(d), p * 100, 100) for p in range(full)] + [(str(d), full * 100, n - full * 100)]
    assert have == sorted(want)
    assert best_fit_packing(df.limit(0)).count() == 0


def test_tightest_compatible_bin():
    rows = [(1, 60, "a", 1), (2, 50, "b", 2), (3, 45, "c", 3), (4, 40, "a", 4), (5, 5, "d", 3)]
    out, room = pack(rows, 100)
    at = {rows[i][0]: b for b, i, *_ in out}
    # 3 goes to the bin of 2 (room 50); 4 fits that of 1 (room 40) but shares its source; 5 shares a cluster with 3
    assert at == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0} and room == [35, 5, 60]


def brute_leaks(docs, items):
    """Pairs that share a run of the item with few substitutions, by laying it over every place."""
    out = {}
    for d, t in docs.items():
        w = words(t, lower=True)
        for i, x in items.items():
            v = words(x, lower=True)
            best = max((sum(a == b for a, b in zip(v, w[s:], strict=False)) for s in range(len(w))), default=0)
            out[d, i] = best / len(v) if v else 0
    return out


def test_leaks_with_substitutions(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" + "x" * rng.randrange(6) for i in range(3000)] + ["the", "of", "and"] * 200
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randrange(15, 40)) for i in range(25)} | {90: ["short", "item"], 91: []}
    docs, planted = {}, set()
    for d in range(120):
        w = text(rng.randrange(0, 150))
        if d % 3 == 0:
            i = rng.randrange(25)
            piece = list(items[i])
            for at in range(rng.randrange(9), len(piece), 9):  # every ninth word is another one
                piece[at] = "changed" if d % 2 else piece[at]
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + piece + w[cut:]
            planted.add((d, i))
        docs[d] = rng.choice([" ", "\n", "  "]).join(w).title()
    docs[200] = "a Short  item"
    rows = [(d, "s", t) for d, t in docs.items()] + [(None, "s", docs[0]), (300, "s", None), (301, "s", " \n"), (0, "s", docs[0]), (302, "s", "the of and " * 40_000)]
    df, bench = with_clash(spark.createDataFrame(rows, DOCS)), with_clash(spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()] + [(None, "x y z"), (95, None)], ITEMS))
    brute = brute_leaks(docs, {i: " ".join(x) for i, x in items.items()})
    for block in (200_000, 300):
        monkeypatch.setattr(decontaminate, "SEED_BLOCK", block)
        got = {(r.doc_id, r.item_id): r for r in benchmark_leaks(df, bench).collect()}
        assert planted | {(200, 90)} <= set(got)
        assert all(brute[k] >= 0.5 for k in got if k[0] in docs)
        assert all(r.matched_percent >= 80 and r.first_word <= r.last_word for r in got.values())
    assert benchmark_leaks(df.limit(0), bench).count() == 0
    assert benchmark_leaks(df, bench.limit(0)).count() == 0


def test_plan_has_no_python_and_no_text_shuffle(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = benchmark_leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None


def test_thirteen_words_in_a_row_are_a_leak(spark):
    item = [f"b{i}" for i in range(40)]
    docs = [(1, " ".join(["x"] * 20 + item[11:24] + ["y"] * 20)), (2, " ".join(item[3:16])), (3, " ".join(["x"] * 9 + item[11:23] + ["y"] * 9)),
            (4, " ".join(item[0:13])), (5, " ".join(item[27:40]) + " z"), (6, " ".join(["x", *item[5:17], "y"]))]
    got = benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.matched_percent for r in got} == {1: 100, 2: 100, 4: 100, 5: 100}
    words = {d: t.split() for d, t in docs}
    for r in got:
        assert set(item) & set(words[r.doc_id]) <= set(words[r.doc_id][r.first_word: r.last_word + 1])


def test_rows_that_repeat_whole_are_spread(spark):
    from pyspark.sql import functions as F
    rows = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    got = best_fit_packing(rows).groupBy("bin_group").count().collect()
    assert sum(r["count"] for r in got) == 30_000 and len(got) == 8 and max(r["count"] for r in got) < 4_300


def tightest(rows, capacity):
    """Best fit in plain Python: of all open bins that a piece fits and does not clash
    with the one with the least room, the longest unchanged first."""
    pieces = []
    for i, (d, n, _, _) in enumerate(rows):
        cuts = [capacity] * ((n - 1) // capacity) if n else []
        pieces += [(-size, d is None, d or 0, i, p) for p, size in enumerate([*cuts, n - sum(cuts)])]
    bins, out = [], []  # a bin: [room, when last filled, sources, clusters]
    for when, (size, _, _, i, p) in enumerate(sorted(pieces)):
        _, _, source, cluster = rows[i]
        fit = [(b[0], b[1], k) for k, b in enumerate(bins) if b[0] >= -size and source not in b[2] and cluster not in b[3]]
        if fit:
            k = min(fit)[2]
        else:
            k = len(bins)
            bins.append([capacity, 0, set(), set()])
        bins[k][0] += size
        bins[k][1] = when
        bins[k][2].add(source)
        bins[k][3].add(cluster)
        out.append((k, i, p, p * capacity, -size))
    return out, [b[0] for b in bins]


def test_packing_equals_plain_python():
    import random

    from tallyframe.llm.packing import pack
    for seed in range(30):
        rng = random.Random(seed)
        rows = [(rng.choice([None, *range(60)]), rng.choice([0, 3, 3, rng.randrange(40), 20, rng.randrange(90)]), rng.choice([None, *"abcdef"]), rng.randrange(25))
                for _ in range(rng.choice([0, 1, 30, 150]))]
        assert pack(rows, 20) == tightest(rows, 20)
