"""Table-driven checks of the scalar Column functions against the
reference's documented input/output pairs."""

import hashlib

import pytest
from pyspark.sql import functions as F

import tallyframe.functions as tf


def run1(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_validate_amount(spark):
    cases = {"1,000.00": 1000.0, "₹100.50": 100.5, "$1,000.00": 1000.0, "€500.00": 500.0,
             "0": 0.0, "0.001": 0.001, "1e15": None, "-100.50": None, "invalid": None,
             "": None, None: None, "£5": None, "nan": None, "inf": None, " 42 ": 42.0,
             "1d": None, "0x10": None, "1e12": 1e12, "1.5e3": 1500.0}
    got = run1(spark, list(cases), tf.validate_amount)
    assert got == list(cases.values())


def test_py_float(spark):
    cases = ["1.5e3", "-500.00", "0.00", " 7 ", "+5", ".5", "5.", "1,000.00", "$100", "1d", "abc", ""]
    got = run1(spark, cases, tf.is_py_float)

    def ok(s):
        try:
            float(s)
            return True
        except ValueError:
            return False
    assert got == [ok(s) for s in cases]


@pytest.mark.parametrize("x", [500.0, 0.0, 112946.26, 1e12, 0.1, 1.0 / 3, 123456789.125, 2.5e-05,
                               1e-05, 1e16, 12345678901234567.0, 0.0001, 7e-4])
def test_py_float_str(spark, x):
    got = run1(spark, [x], tf.py_float_str, "double")[0]
    assert got == str(x)


def test_sanitize_text(spark):
    cases = {
        "<>&\"'": "&lt;&gt;&amp;&quot;&#x27;",
        "  padded  ": "padded",
        None: "",
        "javascript:alert(1)": "[BLOCKED:javascript]alert(1)",
        "x onerror=1": "x [BLOCKED:event_handler]1",
        "JavaScript:": "[BLOCKED:javascript]",
        "DATA:text vbscript:x": "[BLOCKED:data]text [BLOCKED:vbscript]x",
        "<script>": "&lt;script&gt;",
        "UPI-SWIGGY-BANGALORE-9876543210@paytm": "UPI-SWIGGY-BANGALORE-9876543210@paytm",
    }
    assert run1(spark, list(cases), tf.sanitize_text) == list(cases.values())
    assert run1(spark, ["abcdef"], lambda c: tf.sanitize_text(c, 3)) == ["abc"]


def test_safe_for_display(spark):
    cases = {None: True, "": True, "plain": True, "<SCRIPT>": False, "JavaScript:": False,
             "ONERROR=": False, "<iframe": False, "<object": False, "<embed x": False}
    assert run1(spark, list(cases), tf.is_safe_for_display) == list(cases.values())


def test_sanitize_filename(spark):
    cases = {"../../../etc/passwd": "etc_passwd",
             "file/name\\with\\path.txt": "file_name_with_path.txt",
             "....//....//....//etc/passwd": "etc_passwd",
             "a\x00b\x1fc.txt": "abc.txt", "normal_file.xlsx": "normal_file.xlsx", None: ""}
    assert run1(spark, list(cases), tf.sanitize_filename) == list(cases.values())


def test_escape_like(spark):
    assert run1(spark, ["user%name_123", None], tf.escape_like) == ["user\\%name\\_123", ""]


def test_detect_currency(spark):
    three = ["USD", "EUR", "INR"]
    cases = {"Payment to Store $50": "USD", "Received 50 euros": "EUR", "Payment Rs. 500": "INR",
             "Convert dollars to euros": None, "Regular transaction": None, "": None, None: None}
    assert run1(spark, list(cases), lambda c: tf.detect_currency(c, three)) == list(cases.values())
    assert run1(spark, ["Payment ₹1500"], lambda c: tf.detect_currency(c, ["USD", "EUR"])) == [None]


def test_currency_priority(spark):
    from tallyframe.operators.statements import _with_currency

    df = spark.createDataFrame([(1, "$100", "", "€50 dinner", "GBP"), (2, "", "", "", "GBP"), (3, "", "", "", None)],
                               "i int, _w_txt string, _d_txt string, _remarks_txt string, decided string")
    got = {r["i"]: r["_currency"] for r in _with_currency(df, ["USD", "EUR", "GBP", "INR"], F.col("decided")).collect()}
    assert got == {1: "USD", 2: "GBP", 3: "USD"}  # detected, decided, first configured


def test_currency_symbol_and_codes(spark):
    assert run1(spark, ["USD", "XYZ", "SGD"], tf.currency_symbol) == ["$", "XYZ", "S$"]
    df = spark.createDataFrame([(["usd", "XX", "eur", "123"],), (["1", "ab"],)], "a array<string>")
    got = [r[0] for r in df.select(tf.normalize_currency_list("a")).collect()]
    assert got == [["USD", "EUR"], ["INR"]]
    assert tf.normalize_currency_config("inr") == ["INR"]
    assert tf.normalize_currency_config(["USD", "XX", "EUR", 123]) == ["USD", "EUR"]
    assert tf.normalize_currency_config("toolong") == ["INR"]


def test_pattern_suggestions(spark):
    got = run1(spark, ["UPI PAYMENT TO GROCERY STORE", "to the at", "Café-Crème déjà-vu 42x"],
               tf.pattern_suggestions)
    assert got == [["upi", "payment", "grocery", "store"], [], ["cafécrème", "déjàvu", "42x"]]
    assert run1(spark, ["to the"], tf.suggested_pattern) == ["transaction"]


def test_dates(spark):
    import datetime as dt
    cases = {"01-01-2024": dt.datetime(2024, 1, 1), "1/2/2023": dt.datetime(2023, 2, 1),
             " 15-01-2024 ": dt.datetime(2024, 1, 15), "31-02-2024": None, "2024-01-01": None,
             "nan": None, "": None, None: None, "1-1-24": None, "01-01-2024 00:00:00": None}
    assert run1(spark, list(cases), tf.parse_statement_date) == list(cases.values())


def test_transaction_hash_golden(spark):
    import datetime as dt
    rows = [(dt.datetime(2023, 1, 1), "UPI Payment", 500.0, None, "123456",
             "5663f3b2bfe2bb835cc34b916e3d9f343af30c7aee5fb211c642b8eacef8d4d7"),
            (dt.datetime(2023, 1, 1), "Salary Credit", None, 50000.0, "789012",
             "8b0c81da948936c9dcd666fbbd1b54c48dff577c9f117feec4305c905bce925f"),
            (dt.datetime(2024, 1, 1), "UPI-SWIGGY-BANGALORE-9876543210@paytm", 250.0, None, "1",
             "fcce8e7c5e64959dee65cf7e9f10bb910e1362611b71595a49b613d772031e12")]
    df = spark.createDataFrame(rows, "d timestamp, s string, w double, c double, r string, h string")
    got = df.select(tf.transaction_hash("d", "s", "w", "c", "r").alias("x"), "h").collect()
    for x, h in got:
        assert x == h
    assert hashlib.sha256(b"2023-01-01_upi payment_500.0_none_123456").hexdigest() == rows[0][5]


def test_splits(spark):
    specs = ["yugam:30", "yugam:150", "yugam:-10", "invalid_format", "", "a:50, b : 25", "a:60,b:50",
             "a:nan", "x:1:2,y:10"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(tf.parse_splits("s")).collect()]
    assert got[0]["status"] == "ok" and got[0]["own_share"] == 70.0
    assert [g["status"] for g in got] == ["ok", "rejected", "rejected", "rejected", "none", "ok",
                                          "rejected", "rejected", "ok"]
    assert [(s["person"], s["percentage"]) for s in got[5]["splits"]] == [("a", 50.0), ("b", 25.0)]
    assert [(s["person"], s["percentage"]) for s in got[8]["splits"]] == [("y", 10.0)]


def test_mask_url_and_misc(spark):
    urls = ["postgresql://user:pw@host/db", "sqlite:///x.db?key=1", "http://a.com/x", "user@host"]
    assert run1(spark, urls, tf.mask_url) == ["postgresql://***@host/db", "sqlite:///x.db?***",
                                              "http://a.com/x", "user@host"]
    assert run1(spark, ["icici_bank"], tf.institution_display_name) == ["Icici Bank"]
    assert run1(spark, ["  SHOPPING  ", "   ", None], tf.normalize_category) == ["shopping", None, None]
    assert run1(spark, [" John "], tf.normalize_person) == ["john"]
    assert run1(spark, ["snap"], lambda c: tf.from_base64(tf.to_base64(c))) == ["snap"]


def test_amount_texts_that_python_reads(spark):
    texts = ["\xa0100.00", "1_000", "1__0", "_1", "1_", "１２３.５", "\u30001e3\u2003", "٣", "1_0.2_5", "0x10", "1d", "ınf", "nan", " -5 "]

    def python(t):
        try:
            v = float(t)
        except ValueError:
            return None
        return v if 0 <= v <= 1e12 else None

    assert run1(spark, texts, tf.validate_amount) == [python(t) for t in texts]

    def reads(t):
        try:
            float(t)
        except ValueError:
            return False
        return True

    assert run1(spark, texts, tf.is_py_float) == [reads(t) for t in texts]
