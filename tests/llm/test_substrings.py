import hashlib
import random

import pyarrow as pa
import pytest

from tallyframe.llm.substrings import parse_block, substring_dedup, united
from tests.llm.brute import cut, with_clash

SCHEMA = "doc_id long, text string"


def digest(row):
    return row.n_words, row.n_removed, hashlib.sha256(row.kept.encode()).hexdigest()


@pytest.mark.parametrize("window", [3, 13])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(window - 2, 3 * window))] for _ in range(8)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20))] + rng.choice(passages)
        rows.append((d, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(100, rows[5][1]), (101, "same " * 40), (102, "same " * 40), (103, None), (104, ""), (105, " \n ")]
    rng.shuffle(rows)
    df = with_clash(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {r.doc_id: digest(r) for r in substring_dedup(df, window=window).collect()}
    assert got == {d: e for (d, _), e in zip(rows, cut(rows, window), strict=True)}


def test_null_and_repeated_ids_and_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    long_text = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, passage), (4, passage), (4, passage), (9, "x " + passage + " y"), (2, long_text), (3, long_text + " " + passage)]
    got = sorted((str(r.doc_id), *digest(r)) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted((str(d), *e) for (d, _), e in zip(rows, cut(rows, 13), strict=True))
    assert got == want
    assert [g[2] for g in got if g[0] == "4"] == [20, 20]  # 3 has the passage
    assert [g[2] for g in got if g[0] == "None"] == [0]


def test_untouched_texts_and_carried_columns(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, passage, "a"), (2, "x\n" + passage, "b"), (3, "line\n two", None), (4, None, "d"), (None, "a\tb", "e")], "doc_id long, text string, lang string")
    got = {(r.row.lang, r.kept) for r in substring_dedup(df, carry=["lang"], as_is=True).collect()}
    assert got == {("a", passage), ("b", "x"), (None, "line\n two"), ("d", None), ("e", "a\tb")}


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_united():
    assert united([(s, s + 13) for s in (60, 0, 1, 2, 20, 33)]) == [(0, 15), (20, 46), (60, 73)]


def greedy(block, ids, doc, d, window):
    """Factors of a document against one block of (id, words), in plain Python: at each
    window of the block the first place of the smallest id, as long as words agree; then
    the first window that is not inside."""
    place = {}
    for r, w in sorted(zip(ids, block)):
        for j in range(len(w) - window + 1):
            place.setdefault(tuple(w[j:j + window]), (r, j, w))
    out, i = [], 0
    while i + window <= len(doc):
        r, j, w = place.get(tuple(doc[i:i + window]), (d, 0, []))
        if r >= d:
            i += 1
            continue
        n = window
        while i + n < len(doc) and j + n < len(w) and doc[i + n] == w[j + n]:
            n += 1
        out.append((i, i + n, r, j))
        i += n - window + 1
    return out


def test_parse_of_a_block_equals_plain_python():
    rng = random.Random(11)
    for window in (2, 5):
        for _ in range(60):
            library = [[f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 40))] for _ in range(5)]
            ids = rng.sample(range(20), 5)
            docs = [[f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 60))] for _ in range(4)]
            asked = pa.table({"doc_id": pa.array([3, 9, 15, 30], pa.int64()), "key": pa.array([7, 8, 9, 10], pa.int64()), "start": pa.array([0, 100, 0, 5], pa.int64()),
                              "words": pa.array([" ".join(w).encode() for w in docs], pa.binary())})
            references = pa.table({"doc_id": pa.array(ids, pa.int64()), "words": pa.array([" ".join(w).encode() for w in library], pa.binary())})
            want = [(d, k, s + lo, s + hi, r, j) for (d, k, s), w in zip([(3, 7, 0), (9, 8, 100), (15, 9, 0), (30, 10, 5)], docs) for lo, hi, r, j in greedy(library, ids, w, d, window)]
            assert parse_block(window, asked, references) == want


def test_factors_are_stretches_of_their_references(spark):
    rng = random.Random(12)
    passages = [[f"p{i}x{j}" for j in range(rng.randrange(13, 60))] for i in range(6)]
    docs = {d: sum(([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5))] + rng.choice(passages)[rng.randrange(6):] for _ in range(rng.randrange(5))), []) for d in range(60)}
    rows = [(d, " \n".join(w)) for d, w in docs.items()] + [(7, "other " + " ".join(passages[0]))]
    found = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    n = 0
    for r in found:
        w = docs[r.doc_id] if r.n_words == len(docs[r.doc_id]) and r.doc_id != 7 else None
        for f in r.factors:
            assert f["to"] - f["from"] >= 13 and f["reference"] < r.doc_id
            if w is not None and f["reference"] != 7:
                n += 1
                v, j, size = docs[f["reference"]], f["reference_from"], f["to"] - f["from"]
                assert w[f["from"]: f["to"]] == v[j: j + size]
        assert [(s["from"], s["to"]) for s in r.spans] == united([(f["from"], f["to"]) for f in r.factors])
    assert n > 50
    assert sorted((r.doc_id, *digest(r)) for r in found) == sorted((d, *e) for (d, _), e in zip(rows, cut(rows, 13), strict=True))


def thue_morse(n):
    """Two words that every sum of powers modulo 2**64 takes as equal."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("window", [13, 100])
def test_words_that_sums_of_powers_take_as_equal(spark, window):
    a, b = thue_morse(1024)
    rows = [(1, " ".join([a] * window)), (2, " ".join([b] * window)), (3, " ".join([a] * window) + " x"), (4, " ".join(f"w{i}" for i in range(150)))]
    rows += [(5, "y " + rows[3][1]), (6, " ".join(rows[3][1].split()[: window - 1]))]
    got = {r.doc_id: digest(r) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), window=window).collect()}
    assert got == {d: e for (d, _), e in zip(rows, cut(rows, window), strict=True)}
    assert got[2][1] == 0 and got[3][1] == window


def test_columns_of_any_name_are_carried(spark):
    df = spark.createDataFrame([(1, "t", "a", [1, 2], {"k": 1.5})], "doc_id long, text string, `my col` string, `a-b` array<int>, `m.n` map<string,double>")
    row = substring_dedup(df, carry=["my col", "a-b", "m.n"]).first().row
    assert row["my col"] == "a" and row["a-b"] == [1, 2] and row["m.n"] == {"k": 1.5}
