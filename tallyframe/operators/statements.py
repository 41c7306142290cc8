"""Statement cleaning on cell arrays: header detection (S3/S6), rows after
the header (S4), empty-row drop (S5), the valid-row filter (P1-P4), the
typed projection (P5-P7) and per-file row numbers (W1).

Rows stay as ``(path, sheet_row, cells)`` arrays; nothing is pivoted and no
file is ever gathered into one task: the per-file header is a small
aggregate joined back on ``path``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import PLAIN_NUMBER_RE, is_py_float, validate_amount, with_amounts
from ..functions.currency import currency_tags, single_hit
from ..functions.dates import parse_statement_date
from ..functions.hashing import transaction_text
from ..functions.text import is_header_like, py_strip, py_strip_column, with_sanitized
from ..session import stage
from .numbering import dense_number

# ---- fixed values (must equal the reference's behaviour) -------------------
# Required statement headers (note the space before ")").
REQUIRED_COLUMNS = [
    "transaction date",
    "transaction remarks",
    "withdrawal amount (inr )",
    "deposit amount (inr )",
    "balance (inr )",
    "s no.",
]
HEADER_SEARCH_ROWS = 20
HEADER_MATCH_RATIO = 0.7
DESCRIPTION_MAX_LENGTH = 1000
# Exact keys read by the typed projection.
KEY_DATE = "Transaction Date"
KEY_REMARKS = "Transaction Remarks"
KEY_WITHDRAWAL = "Withdrawal Amount (INR )"
KEY_DEPOSIT = "Deposit Amount (INR )"
KEY_BALANCE = "Balance (INR )"
KEY_SNO = "S No."
# Texts that count as "no value" in the essential-field test.
BLANK_TEXTS = ["", "nan", "None"]
# ---------------------------------------------------------------------------

ROW_BUCKET = 1 << 20



def header_score(cells: Column, required: Sequence[str]) -> Column:
    """Number of required names that are a substring of some non-null cell
    (cells lowercased and stripped)."""
    norm = F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: py_strip(F.lower(c)))
    def contains(name: str):
        return lambda c: c.contains(name.lower())

    score = F.lit(0)
    for r in required:
        score = score + F.exists(norm, contains(r)).cast("int")
    return score


def detect_header_rows(cells: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS,
                       max_search_rows: int = HEADER_SEARCH_ROWS,
                       ratio: float = HEADER_MATCH_RATIO) -> DataFrame:
    """S3 + S6: ``(path, header_row, header)`` per file.

    The first of the first ``max_search_rows`` rows with at least
    ``ratio * len(required)`` matches wins; without one the first row is the
    header.  Only the head of each file is read (``sheet_row`` filter), so
    this is one small partial aggregate per file."""
    need = ratio * len(required)
    head = cells.filter(F.col("sheet_row") < max_search_rows).select(
        "path", "sheet_row", "cells", header_score(F.col("cells"), required).alias("score"))
    picked = head.groupBy("path").agg(
        F.min(F.when(F.col("score") >= need, F.col("sheet_row"))).alias("detected"),
        F.min("sheet_row").alias("first_row"),
        F.min_by(F.col("cells"), F.when(F.col("score") >= need, F.col("sheet_row"))).alias("detected_cells"),
        F.min_by(F.col("cells"), F.col("sheet_row")).alias("first_cells"),
    )
    return picked.select(
        "path",
        F.coalesce("detected", "first_row").alias("header_row"),
        F.when(F.col("detected").isNotNull(), F.col("detected_cells")).otherwise(F.col("first_cells"))
        .alias("header"),
    )


def _last_index(keys: Column, key: Column) -> Column:
    """1-based index of the last occurrence of ``key`` (dict semantics)."""
    pos = F.array_position(F.reverse(keys), key)
    return F.when(pos > 0, (F.size(keys) - pos + 1).cast("int"))


def _fuzzy_index(keys: Column, test, last: bool) -> Column:
    """Index of the value of the first/last distinct key passing ``test``
    (distinct keys keep first-occurrence order, values the last one)."""
    hits = F.filter(F.array_distinct(keys), test)
    key = F.element_at(hits, -1) if last else F.get(hits, 0)
    return F.when(F.size(hits) > 0, _last_index(keys, key))


# Layout column -> (exact key) or fuzzy test; computed once per file.
_EXACT = {"i_date": KEY_DATE, "i_remarks": KEY_REMARKS, "i_withdrawal": KEY_WITHDRAWAL,
          "i_deposit": KEY_DEPOSIT, "i_balance": KEY_BALANCE, "i_sno": KEY_SNO}


def header_layout(headers: DataFrame) -> DataFrame:
    """Per file: header keys (``str(header)``; a missing cell is ``nan``),
    width, and the cell index behind every key the cleaning reads.  All the
    key matching happens here, on one row per file, not on every data row."""
    keys = F.transform("header", lambda h: F.coalesce(h, F.lit("nan")))
    k = F.col("keys")
    norm = lambda x: F.lower(py_strip(x))
    cols = [F.col("path"), F.col("header_row"), k, F.size(k).alias("width")]
    cols += [_last_index(k, F.lit(v)).alias(n) for n, v in _EXACT.items()]
    cols += [
        _fuzzy_index(k, lambda x: norm(x) == "transaction date", last=False).alias("p2_date"),
        _fuzzy_index(k, lambda x: norm(x).contains("withdrawal amount"), last=True).alias("p2_withdrawal"),
        _fuzzy_index(k, lambda x: norm(x).contains("deposit amount"), last=True).alias("p2_deposit"),
    ]
    # files in path order: with the sheet row, one sortable number per row
    return dense_number(headers.select("path", "header_row", keys.alias("keys")).select(*cols), ["path"], "file_no")


def rows_after_header(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """S4 + S5: data rows below each file's header with the file's layout;
    rows whose cells (within the header width) are all missing or blank are
    dropped.  The per-file layout (one row per file) should be staged: its
    real file size then lets the planner broadcast it statically when small
    (no shuffle of the cells); with very many files it is a shuffle join
    whose hot-file partitions AQE splits."""
    joined = cells.join(layout, "path").filter(F.col("sheet_row") > F.col("header_row"))
    row = F.slice("cells", 1, F.greatest(F.col("width"), F.lit(1)))
    return joined.filter(F.array_join(row, "").rlike(r"(?U)\S")).drop("header_row")


def cell_text(index: str) -> Column:
    """``str(row.get(key, ""))``: '' when the key is absent, 'nan' when the
    cell is missing."""
    i = F.col(index)
    return F.when(i.isNull(), F.lit("")).otherwise(
        F.coalesce(F.try_element_at(F.col("cells"), i), F.lit("nan")))


def get_text(key_name: str) -> Column:
    """Text of a row field by its exact header key."""
    name = {v: k for k, v in _EXACT.items()}[key_name]
    return cell_text(name)


def essential_fields(lenient_amounts: bool = False) -> Column:
    """A date value and at least one Python-parsable amount; ``lenient_amounts``
    (D2): or one that F1 can read, with grouping commas or a currency sign."""
    def value(idx: str) -> Column:
        return F.when(F.col(idx).isNotNull(), F.try_element_at(F.col("cells"), F.col(idx)))

    def present(v: Column) -> Column:
        return F.coalesce(v.isNotNull() & ~py_strip_column(v).isin(*BLANK_TEXTS), F.lit(False))

    def amount(v: Column) -> Column:
        return is_py_float(v) | validate_amount(v).isNotNull() if lenient_amounts else is_py_float(v)

    d, w, c = value("p2_date"), value("p2_withdrawal"), value("p2_deposit")
    return present(d) & ((present(w) & amount(w)) | (present(c) & amount(c)))


def valid_rows(rows: DataFrame, lenient_amounts: bool = False) -> DataFrame:
    """P1 = P2 and not P3 and P4, as one filter."""
    remarks = get_text(KEY_REMARKS)
    non_blank = ~F.lower(py_strip_column(remarks)).isin("nan", "none", "")
    return rows.filter(essential_fields(lenient_amounts) & ~is_header_like(remarks) & non_blank)


def with_row_numbers(df: DataFrame, part: str = "path", order: str = "sheet_row",
                     out: str = "row_number", bucket: int = ROW_BUCKET) -> DataFrame:
    """1-based row number per ``part`` by ``order``.

    A single file may hold a large share of all rows, so the number is built
    from per-bucket counts (small), their running offsets, and a row_number
    inside each bucket of at most ``bucket`` positions."""
    b = F.floor(F.col(order) / bucket)
    numbered = stage(_numbers_in_buckets(df, part, order, bucket), "numbered")
    return (numbered.join(stage(_bucket_offsets(numbered, part), "offsets"), [part, "_bucket"])
            .withColumn(out, (F.col("_offset") + F.col("_n")).cast("long"))
            .drop("_bucket", "_n", "_offset"))


def _numbers_in_buckets(df: DataFrame, part: str, order: str, bucket: int = ROW_BUCKET) -> DataFrame:
    """``_bucket`` of every row and its number ``_n`` inside that bucket."""
    inner = Window.partitionBy(part, "_bucket").orderBy(order)
    return df.withColumn("_bucket", F.floor(F.col(order) / bucket)).withColumn("_n", F.row_number().over(inner))


def _bucket_offsets(numbered: DataFrame, part: str) -> DataFrame:
    """(part, _bucket, _offset): the rows of a ``part`` before each of its buckets, a
    row per bucket.  The last number in a bucket is its count, so ``numbered`` should
    be staged: two narrow columns of it are read, and no row is built again."""
    counts = numbered.groupBy(part, "_bucket").agg(F.max("_n").alias("_count"))
    w = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, "_bucket", F.coalesce(F.sum("_count").over(w), F.lit(0)).alias("_offset"))


def _usable_low(c: Column) -> Column:
    """Lowered text that may name a currency: not blank, missing or a plain number."""
    s = py_strip_column(c)
    return F.lower(F.when(~c.rlike(PLAIN_NUMBER_RE) & (F.length(s) > 0) & (s != "nan"), s))


def _with_currency(df: DataFrame, currencies: Sequence[str], decided: Column | None = None) -> DataFrame:
    """P7 in stages: lowered usable texts, then the hit tags of each text
    (each evaluated once), then the first text with exactly one hit, the decided
    currency, or the first configured one.  ``_known`` is false for the last: there
    a row's decision may still name another (``ingest_outcomes``)."""
    currencies = list(currencies)
    if len(currencies) == 1:
        return df.withColumns({"_currency": F.lit(currencies[0]), "_known": F.lit(True)})
    low = df.select("*", _usable_low(F.col("_w_txt")).alias("_w_low"), _usable_low(F.col("_d_txt")).alias("_d_low"),
                    _usable_low(F.col("_remarks_txt")).alias("_r_low"))
    tags = low.select("*", *[currency_tags(F.col(f"_{k}_low"), currencies).alias(f"_{k}_tags") for k in "wdr"])
    found = tags.withColumn("_found", F.coalesce(*[single_hit(F.col(f"_{k}_tags")) for k in "wdr"]))
    answer = F.coalesce("_found", decided) if decided is not None else F.col("_found")
    return found.withColumns({"_currency": F.coalesce(answer, F.lit(currencies[0])), "_known": answer.isNotNull()}).drop(
        "_w_low", "_d_low", "_r_low", "_w_tags", "_d_tags", "_r_tags", "_found")


def typed_transactions(rows: DataFrame, currencies: Sequence[str] = ("INR",),
                       decided_currency: Column | None = None) -> DataFrame:
    """P5-P7 + F7: typed columns, ``is_valid`` flag and the transaction hash.

    Invalid rows (bad date, blank description) keep their raw data for the
    skipped table; typed columns are null for them.  Built in stages so each
    parsed value is computed once and referenced, not re-inlined."""
    base = rows.select(
        "*",
        get_text(KEY_DATE).alias("_date_txt"),
        get_text(KEY_REMARKS).alias("_remarks_txt"),
        get_text(KEY_WITHDRAWAL).alias("_w_txt"),
        get_text(KEY_DEPOSIT).alias("_d_txt"),
        get_text(KEY_BALANCE).alias("_b_txt"),
        get_text(KEY_SNO).alias("_ref"),
    )
    base = base.withColumns({c: py_strip_column(c) for c in ("_date_txt", "_remarks_txt", "_ref")})
    parsed = base.select(
        "*",
        F.when((F.col("_date_txt") != "") & (F.col("_date_txt") != "nan"),
               parse_statement_date(F.col("_date_txt"))).alias("_date"),
    )
    parsed = with_amounts(parsed, {"_debit": "_w_txt", "_credit": "_d_txt", "_balance": "_b_txt"})
    parsed = _with_currency(parsed, currencies, decided_currency)
    flagged = parsed.withColumn(
        "is_valid",
        F.col("_date").isNotNull() & (F.col("_remarks_txt") != "") & (F.col("_remarks_txt") != "nan"))
    flagged = with_sanitized(flagged, "_description", "_remarks_txt", DESCRIPTION_MAX_LENGTH)
    v = F.col("is_valid")
    typed = flagged.select(
        *rows.columns,
        "is_valid",
        F.when(v, F.col("_date")).alias("transaction_date"),
        F.when(v, F.col("_description")).alias("description"),
        F.when(v, F.col("_debit")).alias("debit_amount"),
        F.when(v, F.col("_credit")).alias("credit_amount"),
        F.when(v, F.col("_balance")).alias("balance"),
        F.when(v, F.col("_ref")).alias("reference_number"),
        F.when(v, F.when(F.col("_debit") > 0, F.lit("debit")).otherwise(F.lit("credit")))
        .alias("transaction_type"),
        F.when(v, F.col("_currency")).alias("currency"),
        F.when(v, F.col("_known")).alias("currency_known"),
    )
    typed = typed.withColumn("_text", F.when(v, transaction_text("transaction_date", "description", "debit_amount",
                                                                 "credit_amount", "reference_number")))
    return typed.withColumn("transaction_hash", F.sha2(py_strip_column("_text"), 256)).drop("_text")


def raw_json(keys="keys", cells="cells") -> Column:
    """Raw row as JSON (dict semantics: last duplicate key wins)."""
    k = F.col(keys)
    c = F.transform(F.sequence(F.lit(1), F.greatest(F.size(k), F.lit(1))),
                    lambda i: F.try_element_at(F.col(cells), i))
    entries = F.arrays_zip(k.alias("key"), c.alias("value"))
    n = F.size(k)
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(k, i + 2, F.greatest(n, F.lit(1))), e["key"])
                    | (i + 1 == n))
    return F.to_json(F.map_from_entries(last))


def clean_statements(cells: DataFrame, currencies: Sequence[str] = ("INR",), lenient_amounts: bool = False) -> DataFrame:
    """S3-S6, P1, W1, P5-P7, F7 in one chain: every kept statement row with
    its row number, typed columns, validity and hash.

    The rows are staged once, typed and with their number inside a bucket.  What is the
    same for all rows of a file or a bucket (path, header keys, layout, offset) is in
    small staged frames: no row takes it along through the shuffle or into the staged
    files."""
    layout = stage(header_layout(detect_header_rows(cells)), "layout")
    rows = valid_rows(rows_after_header(cells, layout), lenient_amounts).select("file_no", "sheet_row", "cells")
    numbered = _numbers_in_buckets(rows, "file_no", "sheet_row")
    typed = typed_transactions(numbered.join(layout.select("file_no", *_EXACT), "file_no"), currencies).drop(*_EXACT)
    typed = stage(typed, "cleaned")
    buckets = _bucket_offsets(typed, "file_no").join(layout.select("file_no", "path", "keys"), "file_no")
    own = [c for c in typed.columns if c not in ("file_no", "_bucket", "_n", "sheet_row", "cells")]
    return typed.join(stage(buckets, "buckets"), ["file_no", "_bucket"]).select(
        "path", "sheet_row", "cells", "keys", (F.col("file_no") * F.lit(1 << 40) + F.col("sheet_row")).alias("position"),
        (F.col("_offset") + F.col("_n")).cast("long").alias("row_number"), *own)
