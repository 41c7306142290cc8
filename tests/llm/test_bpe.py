import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyframe.llm import bpe
from tests.llm.brute import with_clash

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"
ODD = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "'ve", "'d", "'m", "'t", "1", "22", "!", "é", "中", "文", " ", " ", "́",
       "😀", "\r\n", "\x1c", "\x85", "​", "l", "r", "e", " the", "tion", "ß", "١", "½", "\0"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.share_vocabulary(spark, PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def brute_merge(ranks, piece):
    """The leftmost pair of least rank, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i: i + 2] = [parts[i] + parts[i + 1]]


def encode(merges, texts):
    parts = [t.encode() for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ids, count = bpe._encode_rows(b"".join(parts), rows, bpe._Pieces(merges), bpe.character_classes())
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_the_split_is_the_published_one():
    assert bpe.SPLIT == public_tokenizers.PATTERN


def test_odd_texts_as_tiktoken(merges, oracle):
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(100)]
        assert encode(merges, texts) == oracle.encode_ordinary_batch(texts)


def test_every_code_point_as_tiktoken(merges, oracle):
    texts = [f"a{c}a{c}1{c}{c}!{c} b'{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for lo in range(0, len(texts), 60_000):
        assert encode(merges, texts[lo: lo + 60_000]) == oracle.encode_ordinary_batch(texts[lo: lo + 60_000])


def test_matrix_and_heap_equal_brute_merges(merges, monkeypatch):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"abcdeth \xe4\xb8\xad") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    want = [brute_merge(merges.ranks, p) for p in pieces]
    for widest in (bpe.WIDEST, 3):  # 3: all longer ones by the heap
        monkeypatch.setattr(bpe, "WIDEST", widest)
        ids, count = merges.encode(pieces)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


def test_long_texts_without_a_break(merges, oracle):
    rng = random.Random(7)
    texts = ["a" * 60_000, "!" * 20_000 + "'s", "".join(rng.choice("abcdeth") for _ in range(30_000)), "中文" * 5000, " " * 9000 + "x", "ab " * 400_000]
    assert encode(merges, texts) == oracle.encode_ordinary_batch(texts)


def test_a_task_forgets_and_learns_again(merges, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    known = bpe._Pieces(merges)
    for t in ("one two three four five", "six seven", "one eight"):
        raw = t.encode()
        ids, _ = bpe._encode_rows(raw, np.array([0, len(raw)]), known, bpe.character_classes())
        assert ids.tolist() == oracle.encode_ordinary(t)


def test_rows(spark, vocabulary, oracle):
    rows = [(1, "Hello  world, it's 2024!"), (2, None), (3, ""), (1, "Hello  world, it's 2024!"), (None, "x"), (4, "déjà vu " * 50_000)]
    df = with_clash(spark.createDataFrame(rows, DOCS)).withColumn("ids", F.lit("other")).withColumn("decoded", F.lit(1))
    got = bpe.bpe_decode(bpe.bpe_encode(df, vocabulary), vocabulary).collect()
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=str) == sorted(
        ((i, oracle.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert bpe.bpe_encode(spark.createDataFrame([], DOCS), vocabulary).collect() == []


def test_bytes_that_are_no_utf8(spark, vocabulary, oracle):
    df = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text union all select 2L, 'ok'")
    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(df, vocabulary).collect()}
    assert got == {1: oracle.encode_ordinary("a�b"), 2: oracle.encode_ordinary("ok")}


def test_ids_that_do_not_decode(spark, vocabulary):
    df = spark.createDataFrame([(1, [-1]), (2, [10**6]), (3, None), (4, [None]), (5, [])], "doc_id long, ids array<int>").withColumn("decoded", F.lit("old"))
    got = {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(df, vocabulary).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: b""}


def test_query(spark, oracle):
    from tallyframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def digest(t):
        ids = oracle.encode_ordinary(t)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    assert got == {i: digest(t) for i, t in texts.items()}
