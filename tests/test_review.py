"""Rows that await a decision, the manifest, files that arrive in parts."""

import os

from pyspark.sql import functions as F

from tallyframe.operators.balances import enrich
from tallyframe.operators.statements import clean_statements
from tallyframe.plans import sinks
from tallyframe.plans.file_pipeline import process_files, settle_reviews
from tallyframe.schemas import CELLS, DECISIONS, TRANSACTION_ENUMS, TRANSACTIONS

HEADER = ["S No.", "Transaction Date", "Transaction Remarks", "Withdrawal Amount (INR )", "Deposit Amount (INR )", "Balance (INR )"]


def answers(reason="rent paid", action="new_pattern"):
    """A decision for every row that is asked about."""
    def decide(rows):
        return rows.select("transaction_hash").distinct().select(
            "transaction_hash", F.lit(action).alias("action"), F.lit("").alias("category_choice"), F.lit(reason).alias("reason"),
            F.lit("").alias("splits_spec"), F.lit("rent").alias("pattern"), F.lit("").alias("enum_name"), F.lit("other").alias("enum_category"),
            F.lit(None).cast("string").alias("currency"))
    return decide


def nothing(rows):
    return rows.sparkSession.createDataFrame([], DECISIONS)


def test_manifest(spark, scratch):
    row = sinks.conform(spark.range(1).select(F.lit("h").alias("transaction_hash")), TRANSACTIONS)

    def attempt(run, name, value):
        row.withColumn("description", F.lit(value)).write.parquet(os.path.join(scratch, "transactions", f"run_id={run}", f"attempt={name}"))

    def seen():
        return sorted(r["description"] for r in sinks.read_table(spark, scratch, "transactions").collect())

    attempt("r1", "a1", "first")
    assert seen() == []  # written, not published
    assert sinks.publish(spark, scratch, "r1", "a1") == 1 and seen() == ["first"]
    attempt("r1", "a2", "second")
    assert seen() == ["first"]
    with open(os.path.join(scratch, "_manifest", "000000000002.json"), "w") as f:
        f.write('{"version": 2, "run_id": "r1", "atte')  # killed while it wrote the version
    assert seen() == ["first"]
    assert sinks.publish(spark, scratch, "r1", "a2") == 3 and seen() == ["second"]
    attempt("r2", "b1", "other")
    sinks.publish(spark, scratch, "r2", "b1")
    assert seen() == ["other", "second"]
    assert sinks.vacuum(spark, scratch) == []  # too young
    gone = sinks.vacuum(spark, scratch, keep_seconds=-10)
    assert [os.path.basename(g) for g in gone] == ["attempt=a1"] and seen() == ["other", "second"]
    assert sinks.read_table(spark, scratch, "review_rows").count() == 0


def test_failed_file_and_late_answers(spark, scratch):
    inbox, root = os.path.join(scratch, "in"), os.path.join(scratch, "store")
    os.makedirs(inbox)
    rules = spark.createDataFrame([(1, "food", ["swiggy"], "food", "icici_bank", True)], TRANSACTION_ENUMS)
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write(",".join(HEADER) + "\n1,01-01-2024,UPI-SWIGGY,250,,1\n2,02-01-2024,RENT,90,,1\n2,02-01-2024,RENT,90,,1\n")
    with open(os.path.join(inbox, "b.csv"), "wb") as f:
        f.write(b"\xff\xfebroken")
    process_files(spark, inbox, root, "icici_bank", rules, nothing, ["food"], "r1")
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write(",".join(HEADER) + "\n9,03-01-2024,SWIGGY B,5,,1\n")
    process_files(spark, inbox, root, "icici_bank", rules, answers("no"), ["food"], "r2")  # too short a reason is no answer
    assert sorted(r["reference_number"] for r in sinks.read_table(spark, root, "transactions").collect()) == ["1", ]
    assert sinks.pending_rows(spark, root).count() == 3  # both copies of 2, and 9
    settle_reviews(spark, root, "icici_bank", rules, answers(), ["food"], "r3")
    tx = sinks.read_table(spark, root, "transactions")
    assert sorted(r["reference_number"] for r in tx.collect()) == ["1", "2", "9"]
    assert sinks.pending_rows(spark, root).count() == 0
    files = sinks.read_latest(spark, root, "processed_files", "processed_file_id")
    assert {(r["file_name"], r["processing_status"]) for r in files.collect()} == {("a.csv", "partially_processed"), ("b.csv", "completed")}
    logs = {r["total_transactions"]: (r["processed_transactions"], r["duplicate_transactions"]) for r in sinks.read_latest(spark, root, "processing_logs", "processed_file_id").collect()}
    assert logs == {3: (2, 1), 1: (1, 0)}
    institutions = sinks.read_table(spark, root, "institutions")
    full = enrich(tx.filter("institution_id is not null"), institutions, files, rules)
    assert full.count() == tx.filter("institution_id is not null").count()  # a file tried twice enriches once
    assert {r["institution_name"] for r in full.collect()} == {"Icici Bank"}


def test_stream_of_parts_and_late_answers(spark, scratch):
    from tallyframe.streaming.ingest_stream import start_ingest_stream
    inbox, root, ends = (os.path.join(scratch, x) for x in ("inbox", "store", "ends"))
    rules = spark.createDataFrame([(1, "food", ["swiggy"], "food", "p", True)], TRANSACTION_ENUMS)
    data = [["t"], HEADER, ["1", "01-01-2024", "UPI-SWIGGY", "250", None, "1"], ["2", "02-01-2024", "RENT", "90", None, "1"],
            ["3", "03-01-2024", "SWIGGY", "7", None, "1"]]
    rows = [("s.csv", i, r) for i, r in enumerate(data)]

    def drop(part):
        spark.createDataFrame(part, CELLS).coalesce(1).write.mode("append").parquet(inbox)

    def go(decide):
        start_ingest_stream(spark, inbox, root, os.path.join(scratch, "ck"), rules, decide, "p", ["food"], ends=ends).awaitTermination()

    spark.createDataFrame([], "path string").write.parquet(ends)
    drop(rows[3:])  # the end of the file comes before its head
    go(nothing)
    assert sinks.read_table(spark, root, "transactions").count() == 0
    drop(rows[:3])
    spark.createDataFrame([("s.csv",)], "path string").write.mode("append").parquet(ends)
    go(nothing)
    batch = {r["transaction_hash"]: r["row_number"] for r in clean_statements(spark.createDataFrame(rows, CELLS)).collect()}
    stored = {r["transaction_hash"] for r in sinks.read_table(spark, root, "transactions").collect()}
    waiting = {r["transaction_hash"]: r["row_number"] for r in sinks.pending_rows(spark, root).collect()}
    assert len(stored) == 2 and waiting == {h: n for h, n in batch.items() if h not in stored} and list(waiting.values()) == [2]
    drop([("t.csv", i, r) for i, r in enumerate(data[:2] + [["8", "05-01-2024", "SWIGGY T", "3", None, "1"]])])
    spark.createDataFrame([("t.csv",)], "path string").write.mode("append").parquet(ends)
    go(answers())
    assert {r["reference_number"] for r in sinks.read_table(spark, root, "transactions").collect()} == {"1", "2", "3", "8"}


def test_run_stages_what_it_writes(spark, scratch):
    """A run's staged outcomes hold the raw row only where a table keeps it, and the
    columns that its tables are made of; skipped rows are judged once."""
    from tallyframe.plans import sinks
    from tallyframe.operators.outcomes import ingest_outcomes
    from tallyframe.schemas import DECISIONS, TRANSACTION_ENUMS

    header = ["S No.", "Transaction Date", "Transaction Remarks", "Withdrawal Amount (INR )", "Deposit Amount (INR )", "Balance (INR )"]
    rows = [("f", 0, header), ("f", 1, ["1", "01-02-2024", "shop one", "5.00", None, "1"]), ("f", 2, ["2", "N/A", "odd", "6.00", None, "1"]),
            ("f", 3, ["3", "01-02-2024", "park", "7.00", None, "1"]), ("f", 4, ["4", "01-02-2024", "later", "8.00", None, "1"])]
    batch = clean_statements(spark.createDataFrame(rows, CELLS))
    by = {r["sheet_row"]: r["transaction_hash"] for r in batch.collect()}
    decisions = spark.createDataFrame([(by[1], "process", "alice:40"), (by[3], "skip", "")], "transaction_hash string, action string, splits_spec string")
    decisions = sinks.conform(decisions, DECISIONS)
    none = spark.createDataFrame([], "transaction_hash string")
    rules = spark.createDataFrame([(1, "shop", ["shop"], "other", "p", True)], TRANSACTION_ENUMS)
    out = ingest_outcomes(batch, none, none, decisions, rules, "p", ["other"])
    staged = {r["sheet_row"]: r for r in sinks.stage_outcomes(out).collect()}
    assert {k: r["outcome"] for k, r in staged.items()} == {1: "processed", 2: "invalid", 3: "skipped", 4: "needs_review"}
    assert {k for k, r in staged.items() if r["cells"] is not None} == {2, 3, 4}
    assert "splits_spec" not in staged[1].asDict() and staged[1]["splits"][0]["person"] == "alice"
    skipped = sinks.skipped_rows(out)
    assert "ArrowEvalPython" not in skipped._jdf.queryExecution().executedPlan().toString()  # the rows are staged, not matched twice
    assert sorted(r["raw_data"] for r in skipped.collect()) == sorted(r["raw_data"] for r in sinks.skipped_rows(sinks.stage_outcomes(out)).collect())
    sinks.write_run(out, scratch, "r1", rules=rules, processor="p")
    assert [r["cells"] for r in sinks.pending_rows(spark, scratch).collect()] == [rows[4][2]]
