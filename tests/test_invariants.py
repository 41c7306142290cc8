"""Run invariants on the derived statements (smallest driver tables):
re-running a batch against what the first run stored only repeats, counters
add up, and split amounts plus the owner's share give back the base."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_rerun_and_counters(spark, scratch):
    from tallyframe.operators.outcomes import ingest_outcomes, run_counters
    from tallyframe.plans import derived, sinks
    from tallyframe.sources.derived import PROCESSOR, derived_decisions, derived_rules
    from tallyframe.sources.tables import DEFAULT_CATEGORIES

    batch = derived.cleaned(spark, SF_SMALL)
    decisions = derived_decisions(batch.filter("is_valid"))
    rules = derived_rules(spark)
    empty = spark.createDataFrame([], "transaction_hash string")
    first = ingest_outcomes(batch, empty, empty, decisions, rules, PROCESSOR, DEFAULT_CATEGORIES)
    root = os.path.join(scratch, "store")
    sinks.write_run(first, root, "r1")

    c = run_counters(first).agg(*[F.sum(x).alias(x) for x in (
        "total_transactions", "processed_transactions", "skipped_transactions", "duplicate_transactions",
        "auto_skipped_transactions", "needs_review_transactions")]).first()
    assert c["total_transactions"] == (c["processed_transactions"] + c["skipped_transactions"]
                                       + c["duplicate_transactions"] + c["auto_skipped_transactions"]
                                       + c["needs_review_transactions"])
    assert c["processed_transactions"] > 0 and c["duplicate_transactions"] > 0

    stored = spark.read.parquet(os.path.join(root, "transactions"))
    skipped = spark.read.parquet(os.path.join(root, "skipped_transactions"))
    assert stored.count() == c["processed_transactions"]
    again = ingest_outcomes(batch, stored, skipped, decisions, rules, PROCESSOR, DEFAULT_CATEGORIES)
    kinds = {r[0] for r in again.select("outcome").distinct().collect()}
    assert kinds <= {"duplicate", "auto_skipped", "error_skipped", "invalid", "needs_review"}
    assert "processed" not in kinds and "skipped" not in kinds

    splits = spark.read.parquet(os.path.join(root, "transaction_splits"))
    per_tx = splits.groupBy("transaction_hash").agg(F.sum("amount").alias("split_sum"),
                                                    F.sum("percentage").alias("pct"))
    base = F.coalesce(F.nullif("debit_amount", F.lit(0.0)), F.nullif("credit_amount", F.lit(0.0)), F.lit(0.0))
    check = stored.join(per_tx, "transaction_hash").select(
        F.abs(F.col("split_sum") + base * (100 - F.col("pct")) / 100 - base).alias("err"))
    assert check.count() > 0
    assert check.agg(F.max("err")).first()[0] < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_stream_replay_equals_batch(spark, scratch):
    from tallyframe.operators.outcomes import ingest_outcomes
    from tallyframe.operators.statements import clean_statements
    from tallyframe.plans import sinks
    from tallyframe.session import stage
    from tallyframe.sources.derived import (PROCESSOR, PROCESSOR_CURRENCIES, derived_decisions, derived_rules,
                                            statement_cells)
    from tallyframe.sources.tables import DEFAULT_CATEGORIES
    from tallyframe.streaming.ingest_stream import start_ingest_stream

    cells = statement_cells(spark, SF_SMALL)
    inbox = os.path.join(scratch, "inbox")
    cells.write.parquet(inbox)
    cells = spark.read.parquet(inbox)
    batch = clean_statements(cells, PROCESSOR_CURRENCIES)
    decisions = derived_decisions(batch.filter("is_valid"))
    decisions = stage(decisions, "decisions")  # fixed answers for both runs
    rules = derived_rules(spark)
    empty = spark.createDataFrame([], "transaction_hash string")
    sinks.write_run(ingest_outcomes(batch, empty, empty, decisions, rules, PROCESSOR, DEFAULT_CATEGORIES),
                    os.path.join(scratch, "batch"), "r1")
    q = start_ingest_stream(spark, inbox, os.path.join(scratch, "stream"), os.path.join(scratch, "ck"), rules,
                            decisions, PROCESSOR, DEFAULT_CATEGORIES, PROCESSOR_CURRENCIES)
    q.awaitTermination()

    def hashes(root):
        return sorted(r[0] for r in spark.read.parquet(os.path.join(root, "transactions"))
                      .select("transaction_hash").collect())
    b, s = hashes(os.path.join(scratch, "batch")), hashes(os.path.join(scratch, "stream"))
    assert len(b) > 0 and b == s
