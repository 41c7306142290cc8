"""Layouts by month and by hash prefix: same rows, fewer folders read."""

import hashlib
import os
import re
from datetime import datetime

from pyspark.sql import functions as F

from tallyframe.operators.balances import person_transactions
from tallyframe.plans import sinks
from tallyframe.plans.layout import compact_history, known_keys, lay_out_by_month


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_reads_its_months_only(spark, scratch):
    dates = [datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 2, 1), None]
    t = spark.createDataFrame([(f"h{i}", d, f"d{i}", 1.0, None, "debit", "r") for i, d in enumerate(dates)],
                              "transaction_hash string, transaction_date timestamp, description string, debit_amount double, "
                              "credit_amount double, transaction_type string, reference_number string")
    s = spark.createDataFrame([(i, f"h{i}", "ann", 50.0, 0.5, "INR", False) for i in range(5)],
                              "split_id long, transaction_hash string, person_name string, percentage double, amount double, currency string, is_settled boolean")
    months = lay_out_by_month(t, os.path.join(scratch, "t"))
    for start, end in [(None, None), ("2024-01-01", None), (None, "2024-01-01"), ("2024-01-01", "2024-01-31"), ("2025-01-01", "2025-02-01")]:
        got, want = (sorted(map(tuple, person_transactions(x, s, "Ann ", start, end).collect())) for x in (months, t))
        assert got == want
    plan = _plan(person_transactions(months, s, "ann", "2024-01-01", "2024-01-31"))
    assert re.search(r"PartitionFilters: \[[^\]]*txn_month#\d+ >= 202401[^\]]*txn_month#\d+ <= 202401", plan)
    assert person_transactions(months.limit(0), s, "ann", "2024-01-01", "2024-01-31").count() == 0


def _sha(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def _store(spark, root, run, attempt, numbers):
    rows = spark.createDataFrame([(_sha(i),) for i in numbers], "transaction_hash string")
    rows.write.parquet(os.path.join(root, "transactions", f"run_id={run}", f"attempt={attempt}"))
    sinks.publish(spark, root, run, attempt)


def test_compacted_history_equals_the_runs(spark, scratch):
    def known(without=None, numbers=range(400)):
        batch = spark.createDataFrame([(_sha(i),) for i in numbers] + [(None,)], "transaction_hash string")
        keys = known_keys(spark, scratch, "transactions", batch, without).distinct()
        return {r[0] for r in batch.join(keys, "transaction_hash", "left_semi").collect()}

    _store(spark, scratch, "r1", "a", range(0, 100))
    _store(spark, scratch, "r2", "a", range(100, 200))
    before = known()
    assert compact_history(spark, scratch, prefix_rows=2) == 2  # 200 hashes: two digits
    assert known() == before == {_sha(i) for i in range(200)}
    _store(spark, scratch, "r3", "a", range(200, 300))
    assert known() == {_sha(i) for i in range(300)}
    assert known("r1") == {_sha(i) for i in range(100, 300)} and known("r3") == before
    _store(spark, scratch, "r1", "b", range(50, 60))  # replaces what was compacted
    now = {_sha(i) for i in [*range(50, 60), *range(100, 300)]}
    assert known() == now
    compact_history(spark, scratch, prefix_rows=1 << 20)  # one digit; the newest counts
    assert known() == now and known(numbers=[]) == set()
    assert known_keys(spark, scratch, "skipped_transactions", spark.createDataFrame([(_sha(1),)], "transaction_hash string")).count() == 0


def test_small_batch_reads_its_prefixes_only(spark, scratch):
    _store(spark, scratch, "r1", "a", range(200))
    compact_history(spark, scratch, prefix_rows=2)
    batch = spark.createDataFrame([(_sha(7),), (_sha(900),)], "transaction_hash string")
    keys = known_keys(spark, scratch, "transactions", batch)
    want = {_sha(i) for i in range(200) if _sha(i)[:2] in (_sha(7)[:2], _sha(900)[:2])}
    assert {r[0] for r in keys.collect()} == want
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#\d+ IN \(", _plan(keys))


def test_history_without_a_row(spark, scratch):
    batch = spark.createDataFrame([(_sha(1),)], "transaction_hash string")
    assert known_keys(spark, scratch, "transactions", batch).count() == 0
    assert compact_history(spark, scratch) == 0
    assert known_keys(spark, scratch, "transactions", batch).count() == 0
