import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import quality
from tallyframe.llm.quality import fit_quality, hierarchical_quality
from tallyframe.llm.toxicity import Lexicon, best_cut, evidence, fold, held_out, labelled_texts, learn_lexicon, matcher, toxicity
from tests.conftest import SF_SMALL
from tests.llm.brute import with_clash

DOCS = "doc_id long, text string"


def corpus(rng, n=600):
    """Clean prose, a third of it with insults, some of them in disguise."""
    rows = []
    for i in range(n):
        w = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(8, 200))]
        toxic = int(i % 3 == 0)
        for _ in range(rng.randrange(2, 5) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["dumbfool", "dvmbf00l".replace("v", "u"), "ԁumbfооl", "Dümbfool", "grotzling" + rng.choice("abcdefgh") + rng.choice("uvwxyz")]))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_learns_and_scores_held_out_rows(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    texts = labelled_texts(docs, labels)
    lexicon = learn_lexicon(texts)
    assert any(t.startswith(" dumb") for t in lexicon.terms) and any(t.startswith(" grot") for t in lexicon.terms)
    got = {r.doc_id: r for r in toxicity(with_clash(docs), lexicon).select("*", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(r.h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    wrong = [i for i, _, t in rows if got[i].h and (got[i].score >= 0.3) != bool(t)]
    assert len(wrong) <= 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert texts.count() < len(rows)


def test_rare_toxic_words_beside_a_frequent_one(spark):
    rng = random.Random(5)

    def name(n):
        return "".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(n))

    rare, rows = [name(7) for _ in range(40)], []
    for i in range(6000):
        w = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(8, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            w.insert(rng.randrange(len(w)), "frequentfool" if rng.random() < 0.6 else rng.choice(rare))
        rows.append((" ".join(w), toxic))
    lexicon = learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    docs = spark.createDataFrame([(i, f"wab wcd wef {w} wgh wij") for i, w in enumerate([*rare, "frequentfool", "wxy"])], DOCS)
    got = {r.doc_id: r.score for r in toxicity(docs, lexicon).collect()}
    assert [i for i in range(41) if got[i] < 0.3] == [] and got[41] < 0.3


def test_folding_and_exceptions():
    assert fold("Ѕtupіd 1D10T, ﬁne") == " stupid idiot fine "
    assert fold("st​upid") == " stupid "
    auto = matcher(Lexicon({" trash ": 2.0, " tras": 1.0, " idi": 3.0}, frozenset({" trash can "})))
    assert evidence(auto, fold("the trash can")) == 0
    assert evidence(auto, fold("trash, idiots")) == 5.0
    assert evidence(auto, fold("")) == 0
    assert best_cut([(0.0, 0), (0.1, 0), (2.0, 1), (3.0, 1)]) == np.sqrt(0.1 * 2.0)


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "idiot"), (3, "idiot"), (4, "good " * 100_000 + "idiot")]
    df = with_clash(spark.createDataFrame(rows, DOCS))
    got = sorted((str(r.doc_id), r.score > 0) for r in toxicity(df, Lexicon({" idiot ": 8.0})).collect())
    assert got == [("1", False), ("2", False), ("3", True), ("3", True), ("4", True), ("None", True)]
    assert {r.score for r in toxicity(df, Lexicon({})).collect()} == {0.0}
    assert toxicity(df.limit(0), Lexicon({" idiot ": 8.0})).count() == 0
    empty = spark.createDataFrame([], "text string, label int")
    assert learn_lexicon(empty) == Lexicon({})
    assert learn_lexicon(spark.createDataFrame([("a", 1), (None, 1)], "text string, label int")) == Lexicon({})


def test_quality_held_out(spark):
    sf = SF_SMALL.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels)
    got = hierarchical_quality(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert got.count() == docs.count()
    seen = got.join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert sum(r.keep == r.quality for r in seen) / len(seen) >= 0.95


def test_quality_edges(spark):
    rows = [(1, "a", "x", None), (2, "a", "y", ""), (None, None, None, "some words here"), (3, "b", "x", "w " * 200_000), (3, "b", "x", "w " * 200_000)]
    df = with_clash(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"))
    model = quality.fit(np.random.default_rng(0).normal(size=(50, len(quality.FEATURES))), np.arange(50) % 2.0)
    for m in (model, None):
        got = hierarchical_quality(df, m, F.col("source"), F.col("lang")).collect()
        assert len(got) == 5 and all(0 <= r.posterior <= 1 and r.keep in (0, 1) for r in got)
        assert hierarchical_quality(df.limit(0), m, F.col("source"), F.col("lang")).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert fit_quality(df, labels) is None


def test_sparse_sites_shrink_towards_their_parents(spark, monkeypatch):
    rows = [(i, "big", "p", "x") for i in range(200)] + [(1000, "tiny", "p", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = hierarchical_quality(df, None, F.col("source"), F.col("lang")).collect()
    assert {round(r.host_rate, 6) for r in got} == {0.5}
