"""Sinks, categories, file sources and streaming on small inputs."""

import os
import zipfile

from pyspark.sql import functions as F

from tallyframe.operators.categories import add_category, discovered_categories, merge_categories
from tallyframe.operators.balances import explode_splits, first_per_key, unsettled_by_person
from tallyframe.plans import sinks
from tallyframe.schemas import CELLS, DECISIONS, TRANSACTION_ENUMS, TRANSACTION_SPLITS
from tallyframe.sources import statements as ST
from tallyframe.sources.tables import category_template

HEADER = ["S No.", "Transaction Date", "Transaction Remarks", "Withdrawal Amount (INR )",
          "Deposit Amount (INR )", "Balance (INR )"]


def test_split_rows(spark):
    t = spark.createDataFrame(
        [("h1", 100.0, None, "USD", True, [(" John ", 60.0), ("JANE", 40.0)]),
         ("h2", 0.0, 50.0, None, True, [("a", 10.0)])],
        "transaction_hash string, debit_amount double, credit_amount double, currency string, "
        "has_splits boolean, splits array<struct<person:string,percentage:double>>")
    got = sorted((r["person_name"], r["amount"], r["currency"]) for r in explode_splits(t).collect())
    assert got == [("a", 5.0, "INR"), ("jane", 40.0, "USD"), ("john", 60.0, "USD")]


def test_unsettled_and_first_per_key(spark):
    s = spark.createDataFrame(
        [(1, "h", "john", 1.0, 150.5, "INR", False), (2, "h", "john", 1.0, 150.5, "INR", False),
         (3, "h", "jane", 1.0, 75.25, "INR", False), (4, "h", "jane", 1.0, 1.0, "INR", True),
         (5, "h", "bob", 1.0, 1.0, "INR", None)], TRANSACTION_SPLITS)
    got = sorted(tuple(r) for r in unsettled_by_person(s).collect())
    assert got == [("jane", 75.25, 1), ("john", 301.0, 2)]
    df = spark.createDataFrame([("k", "b", 1, "x"), ("k", "a", 5, "y"), ("j", "a", 1, "z")],
                               "k string, path string, sheet_row int, v string")
    assert sorted(tuple(r) for r in first_per_key(df, "k", ["path", "sheet_row"]).collect()) == [
        ("j", "a", 1, "z"), ("k", "a", 5, "y")]


def test_categories(spark):
    rules = spark.createDataFrame([(1, "a", ["x"], "food", "p", True), (2, "b", ["y"], "transport", "p", True),
                                   (3, "c", ["z"], "  SHOPPING  ", "p", True)], TRANSACTION_ENUMS)
    tx = spark.createDataFrame([("entertainment",), ("utilities",), ("",), (None,)], "transaction_category string")
    assert sorted(r[0] for r in discovered_categories(rules, tx).collect()) == [
        "entertainment", "food", "shopping", "transport", "utilities"]
    tmpl = category_template(spark, ["Food", "TRANSPORT"])
    found = spark.createDataFrame([("food",), ("transport",), ("Medical",)], "name string")
    assert [r["name"] for r in merge_categories(tmpl, found).orderBy("pos").collect()] == [
        "Food", "TRANSPORT", "Medical"]
    cur = spark.createDataFrame([(1, "income"), (2, "food"), (3, "custom")], "pos int, name string")
    out = add_category(cur, category_template(spark, ["income", "food"]), " Medical ")
    assert [r["name"] for r in out.orderBy("pos").collect()] == ["income", "food", "custom", "medical"]


def test_rules_settlement_conform(spark):
    rules = spark.createDataFrame([(1, "grocery", ["grocery"], "food", "p", True)], TRANSACTION_ENUMS)
    change = spark.createDataFrame([(9, "grocery", ["store"], "shopping", "p", True),
                                    (10, "fuel", ["petrol"], "transport", "p", True)], TRANSACTION_ENUMS)
    got = {r["enum_name"]: (r["id"], r["patterns"], r["category"]) for r in sinks.upsert_rules(rules, change).collect()}
    assert got == {"grocery": (1, ["store"], "shopping"), "fuel": (10, ["petrol"], "transport")}
    splits = spark.createDataFrame([(1, "h", "a", 50.0, 5.0, "INR", False)], TRANSACTION_SPLITS)
    upd, missing = sinks.settle_splits(splits, spark.createDataFrame([(1, True), (7, True)],
                                                                     "split_id long, is_settled boolean"))
    assert upd.first()["is_settled"] is True and [r[0] for r in missing.collect()] == [7]
    old = spark.createDataFrame([("h", 1.0)], "transaction_hash string, debit_amount double")
    from tallyframe.schemas import TRANSACTIONS
    c = sinks.conform(old, TRANSACTIONS).first()
    assert c["currency"] == "INR" and c["is_settled"] is False and c["debit_amount"] == 1.0


def _write_xlsx(path, rows):
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    xml_rows = []
    for i, r in enumerate(rows, 1):
        cs = "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r))
        xml_rows.append(f'<row r="{i}">{cs}</row>')
    sheet = ('<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             f'<sheetData>{"".join(xml_rows)}</sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_file_sources(spark, scratch):
    inbox = os.path.join(scratch, "in")
    os.makedirs(inbox)
    _write_xlsx(os.path.join(inbox, "a.xlsx"), [["ICICI statement"], HEADER,
                                                [1, "01-01-2024", "UPI-SWIGGY", 250.5, None, 100]])
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write(",".join(HEADER) + "\n2,02-01-2024,Salary,,50000.00,9\n")
    with open(os.path.join(inbox, "c.xlsx"), "wb") as f:
        f.write(b"not a zip")
    with open(os.path.join(inbox, "notes.txt"), "w") as f:
        f.write("x")
    files = ST.discover_files(spark, inbox, "excel")
    assert sorted(r["file_name"] for r in files.collect()) == ["a.xlsx", "c.xlsx"]
    allf = ST.discover_files(spark, inbox)
    assert sorted(r["file_name"] for r in allf.collect()) == ["a.xlsx", "b.csv", "c.xlsx"]
    cells, bad = ST.read_statement_cells(spark, allf)
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["c.xlsx"]
    from tallyframe.operators.statements import clean_statements
    out = {os.path.basename(r["path"]): r for r in clean_statements(cells).filter("is_valid").collect()}
    assert out["a.xlsx"]["debit_amount"] == 250.5 and out["a.xlsx"]["reference_number"] == "1"
    assert out["b.csv"]["credit_amount"] == 50000.0
    safe = spark.createDataFrame([("/etc/passwd",), ("/tmp/x/../y",), ("/tmp/ok.xlsx",), ("/data/s.xlsx",), ("",)],
                                 "p string")
    assert [r[0] for r in safe.select(ST.is_safe_path("p")).collect()] == [False, False, True, True, False]


def test_streaming_ingest_and_snapshot(spark, scratch):
    from tallyframe.streaming.ingest_stream import live_unsettled, read_live, start_ingest_stream
    inbox, root = os.path.join(scratch, "inbox"), os.path.join(scratch, "store")
    rules = spark.createDataFrame([(1, "food", ["swiggy"], "food", "p", True)], TRANSACTION_ENUMS)

    def drop(name, rows):
        data = [(name, i, r) for i, r in enumerate([["t"], HEADER] + rows)]
        spark.createDataFrame(data, CELLS).write.mode("append").parquet(inbox)

    drop("s1.csv", [["1", "01-01-2024", "UPI-SWIGGY", "250", None, "1"]])
    q = start_ingest_stream(spark, inbox, root, os.path.join(scratch, "ck"), rules, None, "p", ["food"])
    q.awaitTermination()
    drop("s2.csv", [["1", "01-01-2024", "UPI-SWIGGY", "250", None, "1"],
                    ["2", "02-01-2024", "UPI-SWIGGY again", "10", None, "1"]])
    q = start_ingest_stream(spark, inbox, root, os.path.join(scratch, "ck"), rules, None, "p", ["food"])
    q.awaitTermination()
    tx = spark.read.parquet(os.path.join(root, "transactions"))
    assert sorted(r["reference_number"] for r in tx.collect()) == ["1", "2"]  # repeat deduped via storage
    logs = spark.read.parquet(os.path.join(root, "processing_logs"))
    assert logs.agg(F.sum("duplicate_transactions")).first()[0] == 1
    sid = sinks.create_snapshot(spark, root, ["transactions"], "2024-01-01_00-00-00")
    assert [r[0] for r in sinks.snapshot_history(spark, root).collect()] == [sid]
    target = sinks.restore_snapshot(spark, root, ["transactions"], sid)
    assert spark.read.parquet(os.path.join(target, "transactions")).count() == 2
    splits_dir = os.path.join(scratch, "splits")
    spark.createDataFrame([(1, "h", "john", 50.0, 10.0, "INR", False)], TRANSACTION_SPLITS).write.parquet(splits_dir)
    out = os.path.join(scratch, "live")
    live_unsettled(spark, splits_dir, out, os.path.join(scratch, "ck-live")).awaitTermination()
    assert read_live(spark, out).collect()[0]["unsettled_amount"] == 10.0


def test_adapters_and_prefixed_tables(spark, scratch):
    import pytest

    from tallyframe.plans.adapters import get_adapter, make_adapter, register_adapter
    from tallyframe.sources.tables import read_store, table_path
    a = get_adapter("icici_bank")
    assert a.currencies == ("INR",) and a.file_type == "excel"
    register_adapter("multi_bank", make_adapter(["usd", "XX", "eur"]))
    assert get_adapter("multi_bank").currencies == ("USD", "EUR")
    with pytest.raises(ValueError):
        get_adapter("nope")
    cells = spark.createDataFrame([("f", 0, HEADER), ("f", 1, ["1", "01-01-2024", "x $5", "5", None, "1"])], CELLS)
    row = cells.transform(get_adapter("multi_bank").transform).first()
    assert row["currency"] == "USD" and row["is_valid"]
    assert table_path(scratch, "transactions", "test_").endswith("test_transactions")
    assert read_store(spark, scratch, "transactions", "test_").count() == 0
    t = spark.createDataFrame([], "transaction_hash string")
    from tallyframe.plans import sinks
    from tallyframe.schemas import TRANSACTIONS
    sinks.conform(t, TRANSACTIONS).write.parquet(table_path(scratch, "transactions", "test_"))
    assert read_store(spark, scratch, "transactions", "test_").columns == TRANSACTIONS.fieldNames()


def _rows(spark, root):
    tables = ("transactions", "transaction_splits", "skipped_transactions", "processing_logs", "transaction_enums")
    return {t: sorted(map(str, sinks.read_table(spark, root, t).drop("processing_time").collect())) for t in tables}


def test_batch_delivered_again_and_interrupted(spark, scratch, monkeypatch):
    import pytest

    from tallyframe.streaming.ingest_stream import start_ingest_stream
    inbox, root = os.path.join(scratch, "inbox"), os.path.join(scratch, "store")
    rules = spark.createDataFrame([(1, "food", ["swiggy"], "food", "p", True)], TRANSACTION_ENUMS)
    data = [["t"], HEADER, ["1", "01-01-2024", "UPI-SWIGGY", "250", None, "1"], ["2", "bad date", "UPI", "250", None, "1"],
            ["3", "03-01-2024", "UPI-RENT", "9", None, "1"], ["3", "03-01-2024", "UPI-RENT", "9", None, "1"]]
    spark.createDataFrame([("s.csv", i, r) for i, r in enumerate(data)], CELLS).coalesce(1).write.parquet(inbox)
    from tallyframe.operators.statements import clean_statements
    hashes = [r["transaction_hash"] for r in clean_statements(spark.read.parquet(inbox)).filter("reference_number = '3'").collect()]
    decisions = spark.createDataFrame([(hashes[0], "new_pattern", "", "rent", "", "rent", "", "other", None)], DECISIONS)

    def deliver(checkpoint):
        start_ingest_stream(spark, inbox, root, os.path.join(scratch, checkpoint), rules, decisions, "p", ["food"]).awaitTermination()

    for step in ("transactions_rows", "skipped_rows", "log_rows"):  # nothing of a broken batch is seen
        with monkeypatch.context() as m, pytest.raises(Exception):
            m.setattr(sinks, step, lambda *a: 1 / 0)
            deliver("ck-" + step)
        assert all(not rows for rows in _rows(spark, root).values())
    deliver("ck1")
    first = _rows(spark, root)
    assert [len(rows) for rows in first.values()] == [2, 0, 1, 1, 1]
    rent = sinks.read_table(spark, root, "transactions").filter("reference_number = '3'").first()
    assert rent["enum_id"] == 2  # the rule that the batch learned
    os.remove(os.path.join(scratch, "ck1", "commits", "0"))  # stopped before the commit: the same batch once more
    for crc in [f for f in os.listdir(os.path.join(scratch, "ck1", "commits")) if f.endswith("crc")]:
        os.remove(os.path.join(scratch, "ck1", "commits", crc))
    deliver("ck1")
    assert _rows(spark, root) == first
    deliver("ck2")  # another stream over the same files: nothing of the first is touched, its rows are duplicates
    again = _rows(spark, root)
    assert {t: again[t] for t in again if t != "processing_logs"} == {t: first[t] for t in first if t != "processing_logs"}
    assert len(again["processing_logs"]) == 2


def test_file_pipeline_goes_on_after_a_bad_file(spark, scratch):
    import zipfile

    from tallyframe.plans.file_pipeline import process_files
    inbox, root = os.path.join(scratch, "inbox"), os.path.join(scratch, "store")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "good.csv"), "w") as f:
        f.write("title\n" + ",".join(x or "" for x in HEADER) + "\n1,01-01-2024,UPI-SWIGGY,250,,1\n")
    with open(os.path.join(inbox, "bad.csv"), "wb") as f:
        f.write(b"\xff\xfe\x00broken")
    with zipfile.ZipFile(os.path.join(inbox, "sheets.xlsx"), "w") as z:  # the second part is the first sheet
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   '<sheets><sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet10.xml"/></Relationships>')
        row = "".join(f'<c t="inlineStr"><is><t>{x or ""}</t></is></c>' for x in HEADER)
        body = "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in ["7", "02-01-2024", "UPI-RENT", "5", "", "1"])
        z.writestr("xl/worksheets/sheet10.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1">{row}</row><row r="2">{body}</row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    rules = spark.createDataFrame([(1, "food", ["swiggy"], "food", "icici_bank", True)], TRANSACTION_ENUMS)
    none = lambda rows: spark.createDataFrame([], DECISIONS)
    for run in ("r1", "r2"):
        process_files(spark, inbox, root, "icici_bank", rules, none, ["food"], run)
    files = {(r["file_name"], r["processing_status"], r["run_id"]) for r in sinks.read_table(spark, root, "processed_files").collect()}
    assert files == {("good.csv", "completed", "r1"), ("sheets.xlsx", "partially_processed", "r1"), ("bad.csv", "failed", "r1"), ("bad.csv", "failed", "r2")}
    assert sinks.read_table(spark, root, "transactions").count() == 1
    assert sinks.read_table(spark, root, "institutions").count() == 1
    assert {os.path.basename(r["path"]) for r in sinks.read_table(spark, root, "bad_files").collect()} == {"bad.csv"}
    assert sinks.read_table(spark, root, "processing_logs").filter("processing_time is null").count() == 0
