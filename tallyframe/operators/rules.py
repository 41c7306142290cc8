"""Rule matching (J3), rule lookup/upsert (J8, K4) and decision resolution
(P12-P14).

Rules are a dimension.  Their patterns become an Aho-Corasick automaton, and every
description runs through it once: the cost follows the length of the descriptions,
not the number of rules, and no transaction is shuffled.  More patterns than one
automaton holds (``BLOCK_PATTERNS``) are a table that is met block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import enum_name_default, py_strip, py_strip_column, reason_default, suggested_pattern
from ..session import stage
from .numbering import dense_number

# Patterns of one automaton (about 1 KB each), and the most that are broadcast.
BLOCK_PATTERNS = 100_000
NO_PATTERN_SKIP_REASON = "User chose to skip - no pattern identified"
MATCH_SKIP_REASON = "User chose to skip - existing pattern found but not used"
INVALID_REASON = "Invalid transaction data"
#: Columns that matching adds.
MATCH = ("enum_id", "enum_name", "enum_category")


def active_patterns(rules: DataFrame, processor: str) -> DataFrame:
    """(id, pos, pattern, enum_name, category) of the processor's active
    rules, in first-match order (rule id, then pattern position)."""
    return (rules.filter(F.col("is_active") & (F.col("processor_type") == processor))
            .select("id", "enum_name", "category", F.posexplode("patterns").alias("pos", "pattern")))


def match_rules(df: DataFrame, rules: DataFrame, processor: str, desc: str = "description") -> DataFrame:
    """Add ``enum_id``, ``enum_name``, ``enum_category`` of the first
    active rule (by id, then pattern order) whose pattern, lowercased, is a
    substring of the lowercased description; nulls when none matches.  An
    empty pattern matches everything.

    Up to ``BLOCK_PATTERNS`` patterns, counted first, are broadcast and no row is
    shuffled.  Beyond that neither the driver nor any task sees them all:
    ``_match_in_blocks``."""
    pats = active_patterns(rules, processor).select(
        "id", "pos", "enum_name", "category", F.lower(F.coalesce("pattern", F.lit(""))).alias("p"))
    if pats.count() > BLOCK_PATTERNS:
        return _match_in_blocks(df, pats, desc)
    rows = [(r["id"], r["pos"], r["p"], r["enum_name"], r["category"]) for r in pats.orderBy("id", "pos").collect()]
    hit = _first_match(df.sparkSession.sparkContext.broadcast(rows))(F.lower(F.col(desc))) if rows else F.lit(None).cast(_HIT)
    out = df.withColumn("_hit", F.when(F.col(desc).isNotNull(), hit))
    return out.select(*df.columns, F.col("_hit.id").alias("enum_id"), F.col("_hit.enum_name").alias("enum_name"),
                      F.col("_hit.category").alias("enum_category"))


_HIT = "struct<id:bigint,pos:int,enum_name:string,category:string>"


def _match_in_blocks(df: DataFrame, pats: DataFrame, desc: str) -> DataFrame:
    """J3 for any number of patterns.  Patterns are ranked and cut into blocks; a
    distinct description meets each block in one of ``salts`` places, where the
    block's automaton is built once; the least rank over the blocks wins."""
    ranked = stage(dense_number(pats, ["id", "pos"], "rank"), "patterns")
    blocks = -(-ranked.count() // BLOCK_PATTERNS)
    keyed = stage(df.withColumn("_key", F.sha2(F.lower(F.col(desc)), 256)), "described")
    texts = keyed.filter("_key is not null").groupBy("_key").agg(F.any_value(F.lower(F.col(desc))).alias("low"))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salt, every = F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
    texts = texts.withColumn("salt", salt).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rules = ranked.select("rank", "p", F.floor((F.col("rank") - 1) / BLOCK_PATTERNS).cast("int").alias("block"), F.explode(every).alias("salt"))
    hits = (texts.groupBy("block", "salt").cogroup(rules.groupBy("block", "salt"))
            .applyInPandas(_block_hits, "_key string, rank long").groupBy("_key").agg(F.min("rank").alias("rank")))
    named = hits.join(ranked.select("rank", F.col("id").alias("enum_id"), "enum_name", F.col("category").alias("enum_category")), "rank")
    return keyed.join(named, "_key", "left").select(*df.columns, "enum_id", "enum_name", "enum_category")


def _automaton(patterns) -> tuple[ahocorasick.Automaton, int | None]:
    """An automaton over (rank, pattern) that gives ranks, the least of equal
    patterns, and the rank of the empty pattern."""
    least: dict[str, int] = {}
    for rank, p in patterns:
        least[p] = min(rank, least.get(p, rank))
    always = least.pop("", None)
    auto = ahocorasick.Automaton()
    for p, rank in least.items():
        auto.add_word(p, rank)
    if len(auto):
        auto.make_automaton()
    return auto, always


def _least_rank(auto: ahocorasick.Automaton, always: int | None, text: str | None) -> int | None:
    best = min((rank for _, rank in auto.iter(text)), default=None) if text and len(auto) else None
    return always if best is None else best if always is None else min(best, always)


def _block_hits(texts: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    auto, always = _automaton(zip(rules["rank"], rules["p"]))
    found = [(k, r) for k, t in zip(texts["_key"], texts["low"]) if (r := _least_rank(auto, always, t)) is not None]
    return pd.DataFrame(found, columns=["_key", "rank"]).astype({"_key": object, "rank": "int64"})


def _first_match(rows):
    """Arrow function: the first of the ranked patterns that a text contains."""
    @F.pandas_udf(_HIT)
    def first(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranked = rows.value
        auto, always = _automaton((rank, r[2]) for rank, r in enumerate(ranked))
        for batch in texts:
            best = [_least_rank(auto, always, t) for t in batch]
            got = [ranked[b] if b is not None else (None,) * 5 for b in best]
            out = pd.DataFrame(got, columns=["id", "pos", "p", "enum_name", "category"]).drop(columns="p")
            yield out.astype({"id": "Int64", "pos": "Int32"})
    return first


def category_choice(choice: Column, enum_category: Column, categories: Sequence[str]) -> Column:
    """Blank -> enum category; digits -> 1-based pick from the category
    list (out of range -> enum category); other text of >= 2 chars ->
    lowercased new category; anything else -> enum category."""
    c = py_strip_column(F.coalesce(choice, F.lit("")))
    names = F.array(*[F.lit(n) for n in categories]) if categories else F.array().cast("array<string>")
    idx = c.try_cast("int")
    picked = F.when((idx >= 1) & (idx <= len(categories)), F.try_element_at(names, idx))
    return (F.when(c == "", enum_category)
            .when(c.rlike("^[0-9]+$"), F.coalesce(picked, enum_category))
            .when(F.length(c) >= 2, F.lower(c))
            .otherwise(enum_category))


def lookup_rule_ids(df: DataFrame, rules: DataFrame, processor: str) -> DataFrame:
    """Id and category of an existing rule with the same
    (enum_name, processor_type), any activity state; other columns of ``rules``
    that begin with an underscore come along."""
    more = [c for c in rules.columns if c.startswith("_")]
    existing = rules.filter(F.col("processor_type") == processor).select(
        F.col("enum_name").alias("_new_enum_name"), F.col("id").alias("_existing_id"),
        F.col("category").alias("_existing_category"), *more)
    return df.join(existing, "_new_enum_name", "left")


def numbered_after(new_rules: DataFrame, rules: DataFrame, order: Sequence[str]) -> DataFrame:
    """K4 ids for rules first seen in this batch: after the largest existing id, in
    order of first use."""
    max_id = rules.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    return dense_number(new_rules, order, "id", int(max_id))


def resolve_decisions(df: DataFrame, categories: Sequence[str], auto_match: bool = True) -> DataFrame:
    """Turn (rule match, decision) into an action with enum, category,
    transaction category, reason and split spec.

    Expects columns enum_id/enum_name/enum_category (match), and the decision
    columns (action, category_choice, reason, splits_spec, pattern,
    enum_name as ``d_enum_name``, enum_category as ``d_enum_category``).
    A match without a decision is taken with its defaults, or (``auto_match`` false)
    waits for one like any other row."""
    # under a match the category answers 2 and 3 mean skip and new pattern
    choice = F.when(F.col("enum_id").isNotNull(), py_strip_column(F.coalesce(F.col("category_choice"), F.lit(""))))
    df = df.withColumn("action", F.when(F.col("action") != "process", F.col("action")).when(choice == "2", F.lit("skip"))
                       .when(choice == "3", F.lit("new_pattern")).otherwise(F.col("action")))
    # the new pattern's own category answer is not asked twice
    df = df.withColumn("category_choice", F.when(choice.isin("2", "3"), F.lit("")).otherwise(F.col("category_choice")))
    has_decision = F.col("action").isNotNull()
    matched = F.col("enum_id").isNotNull() & (F.col("action").isNull() | (F.col("action") != "new_pattern"))
    reason = F.length(py_strip_column(F.coalesce(F.col("reason"), F.lit(""))))
    # only rows that make a rule are asked for its pattern, and each once
    df = df.withColumn("_typed", F.when(~matched & has_decision & (F.col("action") != "skip"), F.lower(py_strip_column(F.coalesce(F.col("pattern"), F.lit(""))))))
    df = df.withColumn("_new_pattern", F.when(F.col("_typed") == "", suggested_pattern(F.col("description"))).otherwise(F.col("_typed"))).drop("_typed")
    new_name = enum_name_default(F.coalesce(F.col("d_enum_name"), F.lit("")), F.col("_new_pattern"))
    return df.select(
        "*",
        F.when(F.col("action") == "skip", F.lit("skipped"))
        .when(reason.isin(1, 2), F.lit("needs_review"))  # P14: too short an answer is asked for again
        .when(matched & F.lit(auto_match), F.lit("processed"))
        .when(~has_decision, F.lit("needs_review"))
        .otherwise(F.lit("processed")).alias("_decided"),
        F.when(matched, F.lit(MATCH_SKIP_REASON)).otherwise(F.lit(NO_PATTERN_SKIP_REASON)).alias("_skip_reason"),
        matched.alias("_matched"),
        F.when(F.col("_new_pattern").isNotNull(), new_name).alias("_new_enum_name"),
    )


def finish_decisions(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Fill enum id/category for new-pattern rows and compute the final
    transaction category and reason (P13, P14)."""
    enum_cat = F.when(F.col("_matched"), F.col("enum_category")).otherwise(
        F.coalesce(F.col("_existing_category"), F.col("d_enum_category")))
    reason_dflt = F.when(F.col("_matched"), F.concat(F.lit("Transaction: "), F.col("enum_name"))).otherwise(
        F.lit("General transaction"))
    reason = reason_default(F.col("reason"), reason_dflt)
    return df.select(
        "*",
        enum_cat.alias("final_category"),
        category_choice(F.col("category_choice"), enum_cat, categories).alias("transaction_category"),
        F.coalesce(reason, reason_dflt).alias("final_reason"),
    )
