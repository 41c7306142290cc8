"""A training corpus from ``documents``: five stages over the operators of
``tallyframe.llm``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and, but for
the last, returns the columns of documents.  Rows with null text or id pass the
filters; rows of one id stay or go together; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import benchmark_leaks
from tallyframe.llm.packing import best_fit_packing
from tallyframe.llm.similarity import ngram_jaccard_join
from tallyframe.llm.substrings import substring_dedup
from tallyframe.llm.toxicity import labelled_texts, learn_lexicon, toxicity
from tallyframe.session import apply_runtime_defaults, stage

#: Scores from here on are toxic.
TOXIC = 0.3
#: Words of a passage that is cut where it repeats.
PASSAGE = 50

#: No stage but the last counts rows alone; SQL can't express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores as toxic go."""
    apply_runtime_defaults(spark)
    lexicon = learn_lexicon(labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity(docs, lexicon, keep=docs.columns).filter(F.col("score") < TOXIC).drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles connect at 0.8, the smallest id stays."""
    found = ngram_jaccard_join(docs, words=5, percent=80)
    gone = stage(found.filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` words and more go where an earlier document has them."""
    cut = substring_dedup(docs, window=PASSAGE, carry=[c for c in docs.columns if c not in ("text", "n_chars")], as_is=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    leaks = benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(leaks.select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
