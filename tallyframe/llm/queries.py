"""Registered queries of the subpackage: thin contracts over its operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tallyframe.llm.bpe import bpe_decode, bpe_encode, share_vocabulary
from tallyframe.llm.decontaminate import benchmark_leaks
from tallyframe.llm.html_text import main_text
from tallyframe.llm.negatives import hard_negatives
from tallyframe.llm.packing import best_fit_packing
from tallyframe.llm.quality import fit_quality, hierarchical_quality
from tallyframe.llm.sharding import even_tree, grown, shard_rows
from tallyframe.llm.similarity import ngram_jaccard_join
from tallyframe.llm.substrings import substring_dedup
from tallyframe.llm.topk import exact_top_k
from tallyframe.llm.toxicity import held_out, labelled_texts, learn_lexicon, toxicity
from tallyframe.llm.warc import read_warc, write_warc
from tallyframe.llm.whitening import whitening
from tallyframe.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring_dedup(table(spark, sf_dir, "documents"), window=13)
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


@query("op4_weighted_hash_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(8)
    return shard_rows(table(spark, sf_dir, "documents"), tree, grown(tree))


@query("op6_exact_top_k", """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beyond a long would be null."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), k=5).withColumn("score", F.col("score").try_cast("long"))


@query("op1_warc")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    page = r"<urn:page:(-?\d+)>"
    records = read_warc(spark, path)
    stored = F.col("record_type") == "response"
    return records.select(
        F.regexp_extract("record_id", page, 1).try_cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.regexp_extract("refers_to", page, 1).try_cast("long").alias("refers_to"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(labelled_texts(docs, table(spark, sf_dir, "labels")))
    return (toxicity(docs, lexicon)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no URL: the source is the host, language within it the path."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return hierarchical_quality(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
         cast(list_sum([z[1] * z[2] for z in list_zip(a.v, c.v)]) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id
  where a.vec_id % 50 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from (select p.*, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same
        and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
where rank <= 3
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beyond a long would be null."""
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return (hard_negatives(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), label, positives=5, negatives=3, low_percent=50, high_percent=95)
            .withColumns({c: F.col(c).try_cast("long") for c in ("positive_score", "negative_score")}))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = share_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long would be null."""
    return (whitening(table(spark, sf_dir, "embeddings"), components=4)
            .withColumn("deviation", F.col("deviation").try_cast("long")))
