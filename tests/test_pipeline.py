"""Statement pipeline on small in-memory sheets: header detection, the
valid-row filter, typed rows and outcome precedence (reference fixtures)."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import statements as S
from tallyframe.operators.outcomes import ingest_outcomes, run_counters
from tallyframe.schemas import CELLS, DECISIONS, TRANSACTION_ENUMS

HEADER = ["S No.", "Transaction Date", "Transaction Remarks", "Withdrawal Amount (INR )",
          "Deposit Amount (INR )", "Balance (INR )"]


def cells_df(spark, files):
    rows = []
    for path, sheet in files.items():
        for i, r in enumerate(sheet):
            rows.append((path, i, r))
    return spark.createDataFrame(rows, CELLS)


def test_header_detection(spark):
    req = ["transaction date", "transaction remarks", "withdrawal amount (inr )", "deposit amount (inr )",
           "balance (inr )", "s no."]
    files = {
        "junk_first": [["Bank statement"], HEADER, ["1", "01-01-2024", "x", "5", None, "1"]],
        "upper": [[h.upper() for h in HEADER]],
        "padded": [["  " + h + "  " for h in HEADER]],
        "three_of_six": [["junk"], ["Transaction Date", "Transaction Remarks", "S No."]],
        "five_of_six": [["junk"], HEADER[:5]],
        "late": [["j"]] * 25 + [HEADER],
    }
    got = {r["path"]: r["header_row"] for r in S.detect_header_rows(cells_df(spark, files), req).collect()}
    assert got["junk_first"] == 1
    assert got["upper"] == 0 and got["padded"] == 0
    assert got["three_of_six"] == 0  # 3 < 0.7*6 -> no header found -> first row
    assert got["five_of_six"] == 1
    assert got["late"] == 0  # beyond the search window


def sheet(*data):
    return [["Statement"], HEADER] + [list(r) for r in data]


def test_valid_rows_and_typed(spark):
    data = sheet(
        ["1", "01-01-2024", "UPI-SWIGGY-BANGALORE-9876543210@paytm", "250.00", None, "15750.00"],
        ["2", "", "blank date", "5", None, "1"],
        ["3", "02-01-2024", "Transaction Remarks", "5", None, "1"],
        ["4", "03-01-2024", "", "5", None, "1"],
        ["5", "04-01-2024", "nan", "5", None, "1"],
        ["6", "05-01-2024", "bad amount", "invalid_amount", None, "1"],
        ["7", "06-01-2024", "comma amount", "1,000.00", None, "1"],
        ["8", "07-01-2024", "neg", "-500.00", None, "1"],
        ["9", "08-01-2024", "sci", "1.5e3", None, "1"],
        ["10", "31-02-2024", "impossible date", "5", None, "1"],
        ["11", "09/01/2024", "salary <b>", None, "50000.00", "9"],
        [None, None, None, None, None, None],
    )
    cells = cells_df(spark, {"f.csv": data})
    out = S.clean_statements(cells, ["INR"]).orderBy("sheet_row").collect()
    refs = [r["reference_number"] if r["is_valid"] else ("x" + str(r["sheet_row"])) for r in out]
    # kept rows: 1, 8 (negative parses as a float), 9, 10 (invalid date), 11
    assert refs == ["1", "8", "9", "x11", "11"]
    first = out[0]
    assert first["transaction_date"] == dt.datetime(2024, 1, 1)
    assert first["debit_amount"] == 250.0 and first["transaction_type"] == "debit"
    assert first["transaction_hash"] == "fcce8e7c5e64959dee65cf7e9f10bb910e1362611b71595a49b613d772031e12"
    assert first["row_number"] == 1 and out[-1]["row_number"] == 5
    neg = out[1]
    assert neg["debit_amount"] is None and neg["transaction_type"] == "credit"
    last = out[-1]
    assert last["description"] == "salary &lt;b&gt;" and last["credit_amount"] == 50000.0


def test_outcome_precedence(spark):
    rows = sheet(
        ["1", "01-01-2024", "grocery store", "100", None, "1"],      # stored before -> duplicate
        ["2", "02-01-2024", "grocery payment", "200", None, "1"],    # rule match, no decision -> processed
        ["3", "03-01-2024", "unknown shop", "300", None, "1"],       # no rule, no decision -> review
        ["4", "04-01-2024", "skip me", "400", None, "1"],            # decided skip
        ["4", "04-01-2024", "skip me", "400", None, "1"],            # later copy -> auto_skipped
        ["2", "02-01-2024", "grocery payment", "200", None, "1"],    # later copy -> duplicate
        ["5", "05-01-2024", "refund", "-1", None, "1"],              # credit w/o amount -> error_skipped
        ["6", "bad", "bad date", "1", None, "1"],                    # invalid
        ["7", "07-01-2024", "old skip", "7", None, "1"],             # skipped before -> auto_skipped
    )
    cells = cells_df(spark, {"f.csv": rows})
    batch = S.clean_statements(cells, ["INR"])
    h = {r["reference_number"]: r["transaction_hash"] for r in batch.filter("is_valid").collect()}
    stored = spark.createDataFrame([(h["1"],)], "transaction_hash string")
    skipped = spark.createDataFrame([(h["7"],)], "transaction_hash string")
    decisions = spark.createDataFrame(
        [(h["4"], "skip", None, None, None, None, None, None, None),
         (h["5"], "process", "", "", "", "refund", "", "other", None)], DECISIONS)
    rules = spark.createDataFrame([(1, "grocery", ["grocery", "store"], "food", "p", True)], TRANSACTION_ENUMS)
    out = ingest_outcomes(batch, stored, skipped, decisions, rules, "p", ["income", "food"])
    got = [r["outcome"] for r in out.orderBy("sheet_row").collect()]
    assert got == ["duplicate", "processed", "needs_review", "skipped", "auto_skipped", "duplicate",
                   "error_skipped", "invalid", "auto_skipped"]
    p = out.filter(F.col("outcome") == "processed").first()
    assert p["enum_id"] == 1 and p["final_category"] == "food" and p["final_reason"] == "Transaction: grocery"
    c = run_counters(out).first()
    assert c["total_transactions"] == 9 and c["processed_transactions"] == 1
    assert c["skipped_transactions"] == 3 and c["duplicate_transactions"] == 2
    assert c["auto_skipped_transactions"] == 2 and c["status"] == "partially_completed"
    assert c["completion_rate"] == round(4 * 100 / 9, 2)
    again = ingest_outcomes(batch, stored, skipped, decisions, rules, "p", ["income", "food"],
                            reprocess_skipped=True)
    got2 = [r["outcome"] for r in again.orderBy("sheet_row").collect()]
    # previously skipped hash is decided again (no rule, no answer -> review);
    # a later copy of a decided skip is skipped again, not auto-skipped
    assert got2 == ["duplicate", "processed", "needs_review", "skipped", "skipped", "duplicate",
                    "error_skipped", "invalid", "needs_review"]
