"""Registered queries: Spark callables and their DuckDB oracle SQL.

Each Spark callable takes ``(spark, sf_dir)`` and reads the driver's tables
there; the oracle text runs in DuckDB over the same tables.  Column names
match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balances
from . import derived
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


PERSON = "Supplier#000000001"


# ---- A1: unsettled by person (flagship) ------------------------------------
@register("unsettled_by_person", O.with_base(f"""
SELECT person_name, {O.MONEY.format(x='amount')} AS unsettled_amount, count(*) AS unsettled_count
FROM splits WHERE is_settled = false GROUP BY person_name"""))
def q_unsettled_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balances.unsettled_by_person(derived.splits(spark, sf_dir))


CLEAN_COLS = ["path", "sheet_row", "row_number", "is_valid", "transaction_date", "description", "debit_amount",
              "credit_amount", "balance", "reference_number", "transaction_type", "currency", "transaction_hash"]


# ---- S3-S6, P1-P7, W1, F1, F3, F6, F7, F9: cleaned statement rows ----------
@register("statement_clean", O.with_base(f"SELECT {', '.join(CLEAN_COLS)} FROM hashed"))
def q_statement_clean(spark, sf_dir):
    return derived.cleaned(spark, sf_dir).select(*CLEAN_COLS)


# ---- D2: the same with amounts that hold grouping commas or a currency sign --
@register("statement_clean_lenient", O.with_base(f"SELECT {', '.join(CLEAN_COLS)} FROM hashed", lenient=True))
def q_statement_clean_lenient(spark, sf_dir):
    from ..operators.statements import clean_statements
    from ..session import stage
    from ..sources.derived import PROCESSOR_CURRENCIES, statement_cells
    cells = stage(statement_cells(spark, sf_dir), "cells")
    return clean_statements(cells, PROCESSOR_CURRENCIES, lenient_amounts=True).select(*CLEAN_COLS)


# ---- S3/S6: header row per statement file ----------------------------------
@register("statement_headers", f"""
WITH files AS (
  SELECT 'statements/' || lower(n_name) || '.csv' AS path FROM nation
  UNION ALL SELECT 'statements/replay.csv'),
head AS (
  SELECT path, 0 AS sheet_row, ['Statement of account', NULL, 'x'] AS cells FROM files
  UNION ALL
  SELECT path, 1, [NULL, 'S No.', 'Transaction Date', 'Transaction Remarks', 'Withdrawal Amount (INR )',
                   'Deposit Amount (INR )', 'Balance (INR )'] FROM files
  UNION ALL
  SELECT 'statements/' || lower(n.n_name) || '.csv', o.o_orderkey + 2,
         [NULL, CAST(o.o_orderkey AS VARCHAR)]
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderkey + 2 < 20
  UNION ALL
  SELECT 'statements/replay.csv', o.o_orderkey + 2, [NULL, CAST(o.o_orderkey AS VARCHAR)]
  FROM orders o WHERE o.o_orderkey % 10 = 0 AND o.o_orderkey + 2 < 20),
scored AS (
  SELECT path, sheet_row, cells,
         len(list_filter(['transaction date', 'transaction remarks', 'withdrawal amount (inr )',
                          'deposit amount (inr )', 'balance (inr )', 's no.'],
             lambda r: len(list_filter(cells, lambda c: c IS NOT NULL AND contains(lower(trim(c)), r))) > 0)) AS score
  FROM head)
SELECT path, coalesce(min(sheet_row) FILTER (WHERE score >= 4.2), min(sheet_row)) AS header_row,
       arg_min(list_aggregate(list_transform(cells, lambda c: coalesce(c, 'nan')), 'string_agg', '|'),
               CASE WHEN score >= 4.2 THEN sheet_row ELSE 1000000 + sheet_row END) AS header_text
FROM scored GROUP BY path""")
def q_statement_headers(spark, sf_dir):
    from ..operators.statements import detect_header_rows
    from ..sources.derived import statement_cells
    h = detect_header_rows(statement_cells(spark, sf_dir))
    return h.select("path", "header_row", F.array_join(
        F.transform("header", lambda c: F.coalesce(c, F.lit("nan"))), "|").alias("header_text"))


# ---- U3: stored transactions (first copy per hash) -------------------------
@register("stored_transactions", O.with_base(
    "SELECT transaction_hash, path, sheet_row, transaction_date, debit_amount, credit_amount, currency FROM txn"))
def q_stored_transactions(spark, sf_dir):
    return derived.transactions(spark, sf_dir).select(
        "transaction_hash", "path", "sheet_row", "transaction_date", "debit_amount", "credit_amount", "currency")


# ---- A1 variant per currency (D7) ------------------------------------------
@register("unsettled_by_person_currency", O.with_base(f"""
SELECT person_name, currency, {O.MONEY.format(x='amount')} AS unsettled_amount, count(*) AS unsettled_count
FROM splits WHERE is_settled = false GROUP BY person_name, currency"""))
def q_unsettled_by_person_currency(spark, sf_dir):
    return balances.unsettled_by_person(derived.splits(spark, sf_dir), by_currency=True)


_J_COLS = ("transaction_hash, transaction_date, description, debit_amount, credit_amount, transaction_type, "
           "reference_number, person_name, percentage, amount, currency AS split_currency, is_settled AS split_settled")


def _person_frames(spark, sf_dir):
    t = derived.transactions(spark, sf_dir)
    return t, derived.splits(spark, sf_dir, t)


# ---- J4 + O1: unsettled transactions of one person -------------------------
@register("unsettled_transactions", O.with_base(f"""
SELECT {_J_COLS.replace('transaction_hash,', 's.transaction_hash,').replace('currency AS', 's.currency AS')}
FROM txn t JOIN splits s ON s.transaction_hash = t.transaction_hash
WHERE s.person_name = lower('{PERSON}') AND s.is_settled = false"""))
def q_unsettled_transactions(spark, sf_dir):
    t, s = _person_frames(spark, sf_dir)
    return balances.unsettled_transactions(t, s, PERSON).drop("split_id")


# ---- J5 + P11: person history in a date range ------------------------------
@register("person_history", O.with_base(f"""
SELECT {_J_COLS.replace('transaction_hash,', 's.transaction_hash,').replace('currency AS', 's.currency AS')}
FROM txn t JOIN splits s ON s.transaction_hash = t.transaction_hash
WHERE s.person_name = lower('{PERSON}')
  AND t.transaction_date >= TIMESTAMP '1996-01-01' AND t.transaction_date <= TIMESTAMP '1998-12-31'"""))
def q_person_history(spark, sf_dir):
    t, s = _person_frames(spark, sf_dir)
    return balances.person_transactions(t, s, PERSON, "1996-01-01", "1998-12-31").drop("split_id")


# ---- A2: person total in a date range --------------------------------------
@register("person_total", O.with_base(f"""
SELECT coalesce({O.MONEY.format(x='s.amount')}, 0.0) AS total_amount
FROM txn t JOIN splits s ON s.transaction_hash = t.transaction_hash
WHERE s.person_name = lower('{PERSON}')
  AND t.transaction_date >= TIMESTAMP '1996-01-01' AND t.transaction_date <= TIMESTAMP '1998-12-31'"""))
def q_person_total(spark, sf_dir):
    t, s = _person_frames(spark, sf_dir)
    return balances.person_total(t, s, PERSON, "1996-01-01", "1998-12-31")


# ---- P10: transactions per currency ----------------------------------------
@register("transactions_by_currency", O.with_base("SELECT currency, count(*) AS n FROM txn GROUP BY currency"))
def q_transactions_by_currency(spark, sf_dir):
    return balances.by_currency(derived.transactions(spark, sf_dir))


# ---- O3 + P10: newest 100 debits -------------------------------------------
@register("recent_debits_top100", O.with_base("""
SELECT transaction_hash, transaction_date, debit_amount FROM txn WHERE transaction_type = 'debit'
ORDER BY transaction_date DESC, transaction_hash LIMIT 100"""))
def q_recent_debits(spark, sf_dir):
    return balances.recent_transactions(derived.transactions(spark, sf_dir), 100, "debit").select(
        "transaction_hash", "transaction_date", "debit_amount")


# ---- J3: first matching rule per stored transaction ------------------------
@register("rule_match", O.with_ingest("""
SELECT h.transaction_hash, r.id AS enum_id, r.enum_name, r.category AS enum_category
FROM txn h LEFT JOIN hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row
LEFT JOIN rules r ON r.id = hit.enum_id"""))
def q_rule_match(spark, sf_dir):
    from ..operators.rules import match_rules
    from ..sources.derived import PROCESSOR, derived_rules
    t = derived.transactions(spark, sf_dir)
    return match_rules(t, derived_rules(spark), PROCESSOR).select(
        "transaction_hash", "enum_id", "enum_name", "enum_category")


# ---- E1 + P12-P14 + W2 + J1/J2: outcome per statement row -------------------
@register("ingest_outcomes", O.with_ingest(f"""
SELECT path, sheet_row, row_number, outcome,
       CASE WHEN outcome = 'invalid' THEN 'Invalid transaction data'
            WHEN outcome = 'skipped' AND matched THEN 'User chose to skip - existing pattern found but not used'
            WHEN outcome = 'skipped' THEN 'User chose to skip - no pattern identified' END AS skip_reason,
       CASE WHEN outcome = 'processed' THEN enum_cat END AS category,
       CASE WHEN outcome = 'processed' THEN transaction_category END AS transaction_category,
       CASE WHEN outcome = 'processed' THEN final_reason END AS reason,
       CASE WHEN outcome = 'processed' THEN {O.split_status('splits_spec')} END AS split_status,
       CASE WHEN outcome = 'processed' THEN used_enum_id END AS known_enum_id,
       CASE WHEN outcome = 'processed' THEN new_enum_name END AS new_enum_name
FROM outcomes"""))
def q_ingest_outcomes(spark, sf_dir):
    from . import ingest
    o = ingest.run(spark, sf_dir)
    p = F.col("outcome") == "processed"
    return o.select("path", "sheet_row", "row_number", "outcome", "skip_reason",
                    F.when(p, F.col("final_category")).alias("category"),
                    F.when(p, F.col("transaction_category")).alias("transaction_category"),
                    F.when(p, F.col("final_reason")).alias("reason"),
                    F.when(p, F.col("split_status")).alias("split_status"),
                    F.when(p, F.col("used_enum_id")).alias("known_enum_id"),
                    F.when(p, F.col("new_enum_name")).alias("new_enum_name"))


# ---- A3-A5: run counters, status and completion rate per file --------------
@register("ingest_run_counters", O.with_ingest("""
SELECT path, count(*) AS total_transactions,
       count(*) FILTER (WHERE outcome = 'processed') AS processed_transactions,
       count(*) FILTER (WHERE outcome IN ('skipped', 'invalid', 'error_skipped')) AS skipped_transactions,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_transactions,
       count(*) FILTER (WHERE outcome = 'auto_skipped') AS auto_skipped_transactions,
       count(*) FILTER (WHERE outcome = 'needs_review') AS needs_review_transactions,
       CASE WHEN count(*) FILTER (WHERE outcome IN ('processed', 'skipped', 'invalid', 'error_skipped')) = count(*)
            THEN 'completed' ELSE 'partially_completed' END AS status,
       CASE WHEN count(*) FILTER (WHERE outcome IN ('processed', 'skipped', 'invalid', 'error_skipped')) = count(*)
            THEN 'completed' ELSE 'partially_processed' END AS file_status,
       CASE WHEN count(*) FILTER (WHERE outcome IN ('processed', 'skipped', 'invalid', 'error_skipped')) <> count(*)
            THEN round(count(*) FILTER (WHERE outcome IN ('processed', 'skipped', 'invalid', 'error_skipped'))
                       * 100.0 / count(*), 2) END AS completion_rate
FROM outcomes GROUP BY path"""))
def q_ingest_run_counters(spark, sf_dir):
    from ..operators.outcomes import run_counters
    from . import ingest
    return run_counters(ingest.run(spark, sf_dir))


# ---- K4 (create) + J8: rules first defined by this run ----------------------
@register("new_rules", O.with_ingest("SELECT * FROM created"))
def q_new_rules(spark, sf_dir):
    from ..operators.outcomes import new_rules
    from ..sources.derived import PROCESSOR, derived_rules
    from . import ingest
    r = new_rules(ingest.run(spark, sf_dir), derived_rules(spark), PROCESSOR)
    return r.select("id", "enum_name", F.col("patterns")[0].alias("pattern"), "category")


# ---- F15 + A8: split specs of the decisions table --------------------------
@register("split_specs", O.with_ingest(f"""
SELECT transaction_hash, {O.split_status('splits_spec')} AS split_status,
       CASE WHEN {O.split_status('splits_spec')} = 'ok'
            THEN 100.0 - list_sum({O.split_items(O.strip("coalesce(splits_spec, '')"))}) END AS own_share,
       CASE WHEN {O.split_status('splits_spec')} = 'ok'
            THEN len({O.split_items(O.strip("coalesce(splits_spec, '')"))}) END AS n_splits
FROM dec"""))
def q_split_specs(spark, sf_dir):
    from ..functions.splits import parse_splits
    from ..sources.derived import derived_decisions
    d = derived_decisions(derived.cleaned(spark, sf_dir).filter("is_valid"))
    p = parse_splits(F.col("splits_spec"))
    return d.select("transaction_hash", p["status"].alias("split_status"), p["own_share"].alias("own_share"),
                    F.size(p["splits"]).alias("n_splits")).withColumn(
        "n_splits", F.when(F.col("split_status") == "ok", F.col("n_splits")))


# ---- A6 + J7 + U2: categories found in rules and processed rows, merged ----
@register("category_merge", O.with_ingest(f"""
, found AS (
  SELECT DISTINCT name FROM (
    SELECT nullif(lower({O.strip('category')}), '') AS name FROM rules
    UNION ALL
    SELECT nullif(lower({O.strip('transaction_category')}), '') FROM outcomes WHERE outcome = 'processed')
  WHERE name IS NOT NULL),
tmpl AS (SELECT unnest({O.CATEGORIES_SQL}) AS name, generate_subscripts({O.CATEGORIES_SQL}, 1) AS pos)
SELECT pos, name FROM tmpl
UNION ALL
SELECT 10 + row_number() OVER (ORDER BY name) AS pos, name FROM found
WHERE lower(name) NOT IN (SELECT lower(name) FROM tmpl)""".replace("\n, found AS", ", found AS", 1)))
def q_category_merge(spark, sf_dir):
    from ..operators.categories import discovered_categories, merge_categories
    from ..sources.derived import derived_rules
    from ..sources.tables import category_template
    from . import ingest
    processed = ingest.run(spark, sf_dir).filter(F.col("outcome") == "processed")
    found = discovered_categories(derived_rules(spark), processed)
    return merge_categories(category_template(spark), found)


ALL_CODES = ["USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD", "CHF", "SGD"]


# ---- F9 + F10: currency detected in each document (whole text) -------------
@register("document_currency", f"""
SELECT doc_id, {O.detect_currency('text', ALL_CODES)} AS currency
FROM documents""")
def q_document_currency(spark, sf_dir):
    from ..functions.currency import detect_currency
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", detect_currency(F.col("text"), ALL_CODES).alias("currency"))


# ---- F3 + F19: sanitized page html (whole page), display safety -------------
@register("page_sanitize", f"""
SELECT page_id, sha256({O.sanitize('html', 100000000)}) AS sanitized_sha256,
       length({O.sanitize('html', 100000000)}) AS sanitized_length,
       NOT coalesce(regexp_matches(html, '<script|javascript:|on[\\p{{L}}\\p{{N}}_]+\\s*=|<iframe|<object|<embed', 'i'), false)
         AS safe_for_display
FROM pages""")
def q_page_sanitize(spark, sf_dir):
    from ..functions.text import is_safe_for_display, sanitize_text
    from ..sources.tables import read_table
    p = read_table(spark, sf_dir, "pages")
    s = sanitize_text(F.col("html"))
    return p.select("page_id", F.sha2(s, 256).alias("sanitized_sha256"), F.length(s).alias("sanitized_length"),
                    is_safe_for_display(F.col("html")).alias("safe_for_display"))


# ---- F20: credential-masked page urls ---------------------------------------
@register("page_url_mask", """
SELECT page_id,
       CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) || '?***'
            WHEN contains(url, '@') AND contains(split_part(url, '@', 1), '://')
            THEN split_part(split_part(url, '@', 1), '://', 1) || '://***@' || split_part(url, '@', 2)
            ELSE url END AS masked_url
FROM pages""")
def q_page_url_mask(spark, sf_dir):
    from ..functions.text import mask_url
    from ..sources.tables import read_table
    return read_table(spark, sf_dir, "pages").select("page_id", mask_url(F.col("url")).alias("masked_url"))


# ---- F13: pattern suggestions of every document (whole text, first 5) ------
@register("document_pattern_suggestions", f"""
SELECT doc_id, array_to_string({O.pattern_words('text')}[1:5], ' ') AS suggestions,
       coalesce({O.pattern_words('text')}[1], 'transaction') AS suggested_pattern
FROM documents""")
def q_document_pattern_suggestions(spark, sf_dir):
    from ..functions.text import pattern_suggestions, suggested_pattern
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(pattern_suggestions(F.col("text")), " ").alias("suggestions"),
                    suggested_pattern(F.col("text")).alias("suggested_pattern"))


# ---- F13 corpus-wide: top-50 candidate rule words (top-k is the feature) ---
@register("candidate_pattern_words_top50", f"""
SELECT word, count(*) AS n FROM (
  SELECT unnest({O.pattern_words('text')}) AS word FROM conversations)
GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def q_candidate_words(spark, sf_dir):
    from ..functions.text import pattern_words
    from ..sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations")
    words = c.select(F.explode(pattern_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


# ---- F13 corpus-wide: all candidate rule words with their counts ------------
@register("candidate_pattern_words", f"""
SELECT word, count(*) AS n FROM (
  SELECT unnest({O.pattern_words('text')}) AS word FROM conversations)
GROUP BY word""")
def q_candidate_words_all(spark, sf_dir):
    from ..functions.text import pattern_words
    from ..sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations")
    words = c.select(F.explode(pattern_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---- J3 with very many rules: a rule per long word of the benchmark items ---
@register("rule_match_many", r"""
WITH words AS (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM benchmark)
  WHERE length(word) >= 5),
many AS (SELECT row_number() OVER (ORDER BY sha256(word)) AS id, word FROM words)
SELECT d.doc_id, min(m.id) AS enum_id, arg_min(m.word, m.id) AS enum_name
FROM documents d LEFT JOIN many m ON contains(lower(d.text), m.word) GROUP BY d.doc_id""")
def q_rule_match_many(spark, sf_dir):
    from ..operators.numbering import dense_number
    from ..operators.rules import match_rules
    from ..sources.tables import read_table
    words = (read_table(spark, sf_dir, "benchmark")
             .select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
             .filter(F.length("word") >= 5).distinct())
    numbered = dense_number(words.withColumn("h", F.sha2("word", 256)), ["h"], "id")
    rules = numbered.select("id", F.col("word").alias("enum_name"),
        F.array("word").alias("patterns"), F.lit("other").alias("category"), F.lit("p").alias("processor_type"),
        F.lit(True).alias("is_active"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return match_rules(docs, rules, "p", desc="text").select("doc_id", "enum_id", "enum_name")


# ---- U3 / W2 on documents: copies of one text, first copy kept --------------
@register("document_duplicates", """
SELECT sha256(text) AS text_hash, min(doc_id) AS first_doc_id, count(*) AS copies
FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def q_document_duplicates(spark, sf_dir):
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return (d.groupBy("text_hash").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


# ---- K5: split rows written by the ingest run (F15 + F16) -------------------
@register("ingest_split_rows", O.with_ingest(f"""
SELECT transaction_hash, lower({O.strip('s.person')}) AS person_name, s.percentage,
       coalesce(nullif(debit_amount, 0.0), nullif(credit_amount, 0.0), 0.0) * (s.percentage / 100) AS amount,
       coalesce(currency, 'INR') AS currency
FROM (SELECT *, unnest({O.split_structs('splits_spec')}) AS s FROM outcomes
      WHERE outcome = 'processed' AND {O.split_status('splits_spec')} = 'ok')"""))
def q_ingest_split_rows(spark, sf_dir):
    from . import ingest, sinks
    from ..operators.balances import explode_splits
    tx = _staged_splits(sinks.transactions_rows(ingest.run(spark, sf_dir)))
    return explode_splits(tx).select("transaction_hash", "person_name", "percentage", "amount", "currency")


def _staged_splits(tx: DataFrame) -> DataFrame:
    """What split rows are made of, staged as a run stores it: the filter on parsed specs
    and their explosion would otherwise each parse them again."""
    from ..session import stage
    return stage(tx.select("transaction_hash", "debit_amount", "credit_amount", "currency", "splits", "has_splits"), "transactions")


# ---- A1 over the run's own split rows (K5 -> A1) ----------------------------
@register("ingest_unsettled_by_person", O.with_ingest(f"""
SELECT person_name, {O.MONEY.format(x='amount')} AS unsettled_amount, count(*) AS unsettled_count FROM (
  SELECT lower({O.strip('s.person')}) AS person_name,
         coalesce(nullif(debit_amount, 0.0), nullif(credit_amount, 0.0), 0.0) * (s.percentage / 100) AS amount
  FROM (SELECT *, unnest({O.split_structs('splits_spec')}) AS s FROM outcomes
        WHERE outcome = 'processed' AND {O.split_status('splits_spec')} = 'ok'))
GROUP BY person_name"""))
def q_ingest_unsettled_by_person(spark, sf_dir):
    from . import ingest, sinks
    from ..operators.balances import explode_splits
    tx = _staged_splits(sinks.transactions_rows(ingest.run(spark, sf_dir)))
    return balances.unsettled_by_person(explode_splits(tx))


# ---- P9: report lines of the stored transactions ---------------------------
@register("report_lines", O.with_base(f"""
SELECT transaction_hash, strftime(transaction_date, '%d/%m/%Y') AS date_text,
       CASE WHEN length(description) > 80 THEN substring(description, 1, 77) || '...' ELSE description END
         AS description_text,
       CASE WHEN transaction_type = 'debit'
            THEN {O.SYMBOL_SQL.format(c="coalesce(currency, 'INR')")} || format('{{:,.2f}}', debit_amount) || ' (DEBIT)'
            ELSE {O.SYMBOL_SQL.format(c="coalesce(currency, 'INR')")} || format('{{:,.2f}}', credit_amount) || ' (CREDIT)'
       END AS amount_text,
       CASE WHEN coalesce(balance, 0.0) <> 0
            THEN {O.SYMBOL_SQL.format(c="coalesce(currency, 'INR')")} || format('{{:,.2f}}', balance) END AS balance_text,
       CASE WHEN coalesce(reference_number, '') <> '' THEN reference_number END AS reference_text,
       coalesce(currency, 'INR') AS currency
FROM txn"""))
def q_report_lines(spark, sf_dir):
    from ..operators.display import report_lines
    return report_lines(derived.transactions(spark, sf_dir))


# ---- F4 + F5: filename sanitizer and LIKE escape over page urls -------------
@register("page_filename_sanitize", r"""
SELECT page_id,
  coalesce(regexp_replace(ltrim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
        '\.\./', '', 'g'), '\.\.\\', '', 'g'), '%2e%2e%2f', '', 'gi'), '%2e%2e%5c', '', 'gi'),
      '[\\/]', '_', 'g'), '%2f', '_', 'gi'), '%5c', '_', 'gi'), '\.\.', '', 'g'),
    '_+', '_', 'g'), '_'), '[\x00-\x1f\x7f]', '', 'g'), '') AS safe_name,
  coalesce(replace(replace(url, '%', '\%'), '_', '\_'), '') AS like_pattern
FROM pages""")
def q_page_filename_sanitize(spark, sf_dir):
    from ..functions.text import escape_like, sanitize_filename
    from ..sources.tables import read_table
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", sanitize_filename(F.col("url")).alias("safe_name"),
                    escape_like(F.col("url")).alias("like_pattern"))


# ---- ST3: streaming replay of the split rows equals batch A1 ----------------
@register("stream_unsettled_by_person", ORACLE["unsettled_by_person"])
def q_stream_unsettled_by_person(spark, sf_dir):
    from ..session import stage_path
    from ..streaming.ingest_stream import live_unsettled, read_live
    path = stage_path(derived.splits(spark, sf_dir).select(
        F.lit(0).cast("long").alias("split_id"), "transaction_hash", "person_name", "percentage", "amount",
        "currency", "is_settled"), "splits")
    out = _scratch(spark, "live")
    live_unsettled(spark, path, out, _scratch(spark, "live-checkpoint")).awaitTermination()
    return read_live(spark, out)


# ---- S7: per-file extract summary (header row, rows kept) -------------------
@register("statement_extract_counts", O.with_base("""
SELECT path, 1 AS header_row, count(*) AS valid_transactions,
       count(*) FILTER (WHERE is_valid) AS typed_rows
FROM hashed GROUP BY path"""))
def q_statement_extract_counts(spark, sf_dir):
    from ..operators.statements import detect_header_rows
    from ..sources.derived import statement_cells
    c = derived.cleaned(spark, sf_dir)
    counts = c.groupBy("path").agg(F.count(F.lit(1)).alias("valid_transactions"),
                                   F.count_if("is_valid").alias("typed_rows"))
    headers = detect_header_rows(statement_cells(spark, sf_dir)).select("path", "header_row")
    return counts.join(headers, "path").select("path", F.col("header_row").cast("int").alias("header_row"),
                                               "valid_transactions", "typed_rows")


# ---- A7: table counts of the stored state -----------------------------------
@register("table_counts", O.with_base("""
SELECT (SELECT count(*) FROM txn) AS transactions, (SELECT count(*) FROM splits) AS transaction_splits,
       (SELECT count(*) FROM txn WHERE transaction_type = 'debit') AS debit_transactions"""))
def q_table_counts(spark, sf_dir):
    t = derived.transactions(spark, sf_dir)
    s = derived.splits(spark, sf_dir, t)
    none = F.lit(None).cast("int")
    rows = t.select(F.lit(1).alias("t"), F.when(F.col("transaction_type") == "debit", 1).alias("d"),
                    none.alias("s")).unionByName(s.select(none.alias("t"), none.alias("d"), F.lit(1).alias("s")))
    return rows.agg(F.count("t").alias("transactions"), F.count("s").alias("transaction_splits"),
                    F.count("d").alias("debit_transactions"))


# ---- J6: processed rows enriched with their rule (FK join) -----------------
@register("processed_with_rule", O.with_ingest("""
SELECT o.path, o.sheet_row, o.used_enum_id AS enum_id, r.enum_name AS rule_name
FROM outcomes o LEFT JOIN rules r ON r.id = o.used_enum_id
WHERE o.outcome = 'processed'"""))
def q_processed_with_rule(spark, sf_dir):
    from ..sources.derived import derived_rules
    from . import ingest
    o = ingest.run(spark, sf_dir).filter(F.col("outcome") == "processed").select(
        "path", "sheet_row", F.col("used_enum_id").alias("enum_id"))
    return balances.enrich(o, rules=derived_rules(spark)).select("path", "sheet_row", "enum_id",
                                                                F.col("enum_name").alias("rule_name"))


# ---- S1 + S2/S10 + S8: statements written as CSV files, read back by the
# file reader (one task per file), then cleaned ------------------------------
@register("csv_statement_files", O.with_base("""
SELECT path, row_number, is_valid, transaction_hash FROM hashed"""))
def q_csv_statement_files(spark, sf_dir):
    from ..operators.statements import clean_statements
    from ..sources.derived import PROCESSOR_CURRENCIES, statement_cells, write_statement_csv
    from ..sources.statements import discover_files, read_statement_cells
    folder = _scratch(spark, "statement-files")
    write_statement_csv(statement_cells(spark, sf_dir), folder)
    files = discover_files(spark, folder, "csv")
    cells, _bad = read_statement_cells(spark, files)
    name = F.regexp_extract("path", r"file_id=([^/]+)/", 1)
    cells = cells.withColumn("path", F.concat(F.lit("statements/"), name, F.lit(".csv")))
    out = clean_statements(cells, PROCESSOR_CURRENCIES)
    return out.select("path", "row_number", "is_valid", "transaction_hash")


# ---- F23: JSON columns - the splits of processed rows as stored JSON -------
@register("ingest_splits_json", O.with_ingest(f"""
SELECT path, sheet_row, CAST(to_json({O.split_structs('splits_spec')}) AS VARCHAR) AS splits_json
FROM outcomes WHERE outcome = 'processed' AND {O.split_status('splits_spec')} = 'ok'"""))
def q_ingest_splits_json(spark, sf_dir):
    from . import ingest
    from ..session import stage
    o = ingest.run(spark, sf_dir).filter(F.col("outcome") == "processed").select("path", "sheet_row", "split_status", "splits")
    o = stage(o, "splits").filter(F.col("split_status") == "ok")  # each spec is parsed once
    return o.select("path", "sheet_row", F.to_json("splits").alias("splits_json"))


# ---- K6 + F8: skipped rows written by the run (raw row kept as JSON) -------
@register("ingest_skipped_rows", O.with_ingest("""
SELECT CASE WHEN outcome = 'invalid'
            THEN sha256(concat_ws('_', raw_json, path, CAST(sheet_row AS VARCHAR)))
            ELSE transaction_hash END AS transaction_hash,
       raw_json AS raw_data, row_number, skip_reason
FROM (
  SELECT o.*, CAST(to_json(MAP(['nan', 'S No.', 'Transaction Date', 'Transaction Remarks',
                                'Withdrawal Amount (INR )', 'Deposit Amount (INR )', 'Balance (INR )'],
                               [NULL, k.s_no, k.txn_date, k.remarks, k.withdrawal, k.deposit, k.balance]))
              AS VARCHAR) AS raw_json,
         CASE WHEN o.outcome = 'invalid' THEN 'Invalid transaction data'
              WHEN o.matched THEN 'User chose to skip - existing pattern found but not used'
              ELSE 'User chose to skip - no pattern identified' END AS skip_reason
  FROM outcomes o JOIN kept k ON k.path = o.path AND k.sheet_row = o.sheet_row
  WHERE o.outcome IN ('invalid', 'skipped'))"""))
def q_ingest_skipped_rows(spark, sf_dir):
    from . import ingest, sinks
    return sinks.skipped_rows(ingest.run(spark, sf_dir)).select(
        "transaction_hash", "raw_data", "row_number", "skip_reason")


def _scratch(spark, name: str) -> str:
    from ..session import scratch_path
    return scratch_path(spark, name)


# ---- K4 + K5 + ST2: a run written twice under one id; the stored rows and the
# rules they point to ---------------------------------------------------------
@register("stored_enum_ids", O.with_ingest("""
SELECT o.transaction_hash, coalesce(o.used_enum_id, c.id) AS enum_id, coalesce(r.enum_name, c.enum_name) AS rule_name,
       o.enum_cat AS category, o.transaction_category, o.final_reason AS reason
FROM outcomes o LEFT JOIN rules r ON r.id = o.used_enum_id
LEFT JOIN created c ON o.used_enum_id IS NULL AND c.enum_name = o.new_enum_name
WHERE o.outcome = 'processed'"""))
def q_stored_enum_ids(spark, sf_dir):
    from ..sources.derived import PROCESSOR, derived_rules
    from . import ingest, sinks
    root = _scratch(spark, "store")
    batch, rules = derived.cleaned(spark, sf_dir), derived_rules(spark)
    for _ in range(2):  # the second time with what the first has stored
        stored = sinks.read_table(spark, root, "transactions", without_run="r1")
        skipped = sinks.read_table(spark, root, "skipped_transactions", without_run="r1")
        out = ingest.run(spark, sf_dir, batch=batch, stored=stored, skipped=skipped)
        sinks.write_run(out, root, "r1", rules=rules, processor=PROCESSOR)
    known = rules.unionByName(sinks.read_table(spark, root, "transaction_enums").select(*rules.columns))
    names = known.select(F.col("id").alias("enum_id"), F.col("enum_name").alias("rule_name"))
    return sinks.read_table(spark, root, "transactions").join(names, "enum_id", "left").select(
        "transaction_hash", "enum_id", "rule_name", "category", "transaction_category", "reason")


# ---- E2 + K1-K3, K7: statement files and one unreadable file through the whole
# file pipeline; status and log of every file ---------------------------------
@register("file_pipeline_status", O.with_ingest("""
, plain AS (
  SELECT h.path, h.sheet_row, h.is_valid, h.transaction_hash, o.own,
         row_number() OVER (PARTITION BY h.transaction_hash ORDER BY h.path, h.sheet_row) = 1 AS first_copy,
         CASE WHEN NOT h.is_valid THEN 'invalid'
              WHEN o.transaction_type = 'credit' AND o.credit_amount IS NULL THEN 'error_skipped'
              ELSE o.decided END AS alone
  FROM hashed h JOIN o4 o ON o.path = h.path AND o.sheet_row = h.sheet_row),
judged AS (
  SELECT path, CASE WHEN is_valid AND NOT first_copy AND alone = 'processed' THEN 'duplicate'
                    WHEN is_valid AND NOT first_copy AND alone = 'skipped' THEN 'auto_skipped' ELSE alone END AS outcome
  FROM plain),
per_file AS (
  SELECT path, count(*) AS total_transactions,
         count(*) FILTER (WHERE outcome = 'processed') AS processed_transactions,
         count(*) FILTER (WHERE outcome IN ('skipped', 'invalid', 'error_skipped')) AS skipped_transactions,
         count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_transactions
  FROM judged GROUP BY path)
SELECT regexp_extract(path, '([^/]+)[.]csv$', 1) AS name,
       CASE WHEN processed_transactions + skipped_transactions = total_transactions THEN 'completed'
            ELSE 'partially_processed' END AS processing_status,
       total_transactions, processed_transactions, skipped_transactions, duplicate_transactions, true AS timed
FROM per_file
UNION ALL SELECT 'broken', 'failed', NULL, NULL, NULL, NULL, NULL""".replace("\n, plain", ", plain", 1)))
def q_file_pipeline_status(spark, sf_dir):
    from ..sources.derived import (PROCESSOR, PROCESSOR_CURRENCIES, derived_decisions, derived_rules,
                                   statement_cells, write_statement_csv)
    from ..sources.tables import DEFAULT_CATEGORIES
    from . import sinks
    from .adapters import make_adapter, register_adapter
    from .file_pipeline import process_files
    folder, root = _scratch(spark, "statement-files"), _scratch(spark, "store")
    write_statement_csv(statement_cells(spark, sf_dir), folder)
    spark.range(3).write.option("encoding", "UTF-16").csv(f"{folder}/file_id=broken")
    register_adapter(PROCESSOR, make_adapter(PROCESSOR_CURRENCIES, "csv"))
    for run in ("r1", "r2"):  # the second finds the unreadable file only
        process_files(spark, folder, root, PROCESSOR, derived_rules(spark), derived_decisions, DEFAULT_CATEGORIES, run, "csv")
    name = F.regexp_extract("file_path", r"file_id=([^/]+)/", 1)
    files = sinks.read_table(spark, root, "processed_files").select("processed_file_id", name.alias("name"), "processing_status").distinct()
    log = sinks.read_table(spark, root, "processing_logs")
    return (files.join(log, "processed_file_id", "left")
            .select("name", "processing_status", "total_transactions", "processed_transactions", "skipped_transactions",
                    "duplicate_transactions", (F.col("processing_time") > 0).alias("timed")).distinct())


# ---- F11 + F12 + F18: codes and names cut from the orders ------------------
@register("order_currency_codes", r"""
SELECT o_orderkey,
       regexp_full_match(substring(o_orderpriority, 3, 3), '\p{L}{3}') AS is_code,
       CASE WHEN regexp_full_match(substring(o_orderpriority, 3, 3), '\p{L}{3}')
            THEN upper(substring(o_orderpriority, 3, 3)) || CASE WHEN o_orderkey % 2 = 0 THEN ',EUR' ELSE '' END
            WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'INR' END AS codes,
       upper(substring(lower(replace(o_orderpriority, '-', '_')), 1, 1)) || substring(lower(replace(o_orderpriority, '-', ' ')), 2, 1)
         || upper(substring(o_orderpriority, 3, 1)) || substring(lower(o_orderpriority), 4, 3) AS shown
FROM orders""")
def q_order_currency_codes(spark, sf_dir):
    from ..functions.currency import is_valid_currency_code, normalize_currency_list
    from ..functions.text import institution_display_name
    from ..sources.tables import read_table
    code = F.substring("o_orderpriority", 3, 3)
    # an odd order's second code is too long
    codes = F.array(code, F.when(F.col("o_orderkey") % 2 == 0, F.lit("eur")).otherwise(F.lit("euro")))
    shown = F.substring(institution_display_name(F.lower(F.translate("o_orderpriority", "-", "_"))), 1, 6)
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", is_valid_currency_code(code).alias("is_code"),
        F.array_join(normalize_currency_list(codes), ",").alias("codes"), shown.alias("shown"))


# ---- S9: path guard over the pages' urls, some moved to guarded places -------
@register("page_path_safety", r"""
WITH p AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/etc/' || url WHEN 1 THEN '/tmp/x/' || url WHEN 2 THEN '/data/../' || url
                  WHEN 3 THEN '/usr/tmp/' || url WHEN 4 THEN '~/' || url WHEN 5 THEN '' ELSE '/data/' || url END AS path
  FROM pages)
SELECT page_id, length(path) > 0 AND NOT regexp_matches(lower(path), '\.\.|~|%2e%2e')
       AND (regexp_matches(path, '/tmp/|/var/folders/') OR NOT regexp_matches(path, '^(/etc/|/var/log/|/var/lib/|/usr/|/bin/|/sbin/)')) AS safe
FROM p""")
def q_page_path_safety(spark, sf_dir):
    from ..sources.statements import is_safe_path
    from ..sources.tables import read_table
    k, url = F.col("page_id") % 7, F.col("url")
    path = F.when(k == 5, F.lit(""))
    for i, prefix in enumerate(["/etc/", "/tmp/x/", "/data/../", "/usr/tmp/", "~/", "", "/data/"]):
        path = path.when(k == i, F.concat(F.lit(prefix), url))
    return read_table(spark, sf_dir, "pages").select("page_id", is_safe_path(path).alias("safe"))


# ---- F22: base64 of whole pages, decoded again ------------------------------
@register("page_base64", """
SELECT page_id, sha256(to_base64(encode(html))) AS encoded_sha256, sha256(html) AS decoded_sha256 FROM pages""")
def q_page_base64(spark, sf_dir):
    from ..functions.text import from_base64, to_base64
    from ..sources.tables import read_table
    p = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(to_base64(F.col("html")), r"\s", "").alias("e"))
    return p.select("page_id", F.sha2("e", 256).alias("encoded_sha256"), F.sha2(from_base64(F.col("e")), 256).alias("decoded_sha256"))


# ---- K8 + A1: splits settled by a list, one id of which no split has ---------
@register("settled_splits", O.with_base(f"""
SELECT person_name, count(*) AS n, count(*) FILTER (WHERE is_settled OR l_linenumber % 3 = 0) AS settled, 1 AS unmatched
FROM splits GROUP BY person_name"""))
def q_settled_splits(spark, sf_dir):
    from . import sinks
    sp = derived.splits(spark, sf_dir).select("split_id", "transaction_hash", "person_name", "is_settled")
    from ..functions.hashing import surrogate_id
    hashes = sp.select("transaction_hash").distinct()
    line = F.explode(F.array(F.lit(3), F.lit(6)))  # an order has 7 lines at most
    settle = (hashes.select("transaction_hash", line.alias("line"))
              .select(surrogate_id(F.col("transaction_hash"), F.col("line")).alias("split_id"))
              .join(sp.select("split_id"), "split_id", "left_semi").withColumn("is_settled", F.lit(True)))
    nowhere = spark.range(1).select(F.lit(-1).cast("long").alias("split_id"), F.lit(True).alias("is_settled"))
    updated, unmatched = sinks.settle_splits(sp, settle.unionByName(nowhere))
    n = unmatched.count()  # one number
    return (updated.groupBy("person_name").agg(F.count("*").alias("n"), F.count_if("is_settled").alias("settled"))
            .withColumn("unmatched", F.lit(n).cast("int")))


# ---- K10 + K11 + O6: an old table conformed, snapshotted twice, restored ------
@register("restored_snapshot", O.with_base("""
SELECT transaction_hash, transaction_date, debit_amount, 'INR' AS currency, false AS is_settled, 2 AS snapshots FROM txn"""))
def q_restored_snapshot(spark, sf_dir):
    import os

    from ..schemas import TABLES
    from . import sinks
    root = _scratch(spark, "store")
    old = derived.transactions(spark, sf_dir).drop("currency")  # a table from before currencies were kept
    sinks.conform(old, TABLES["transactions"]).write.parquet(os.path.join(root, "transactions"))
    sinks.create_snapshot(spark, root, ["transactions"])
    spark.read.parquet(os.path.join(root, "transactions")).limit(0).write.mode("overwrite").parquet(os.path.join(root, "transactions"))
    target = sinks.restore_snapshot(spark, root, ["transactions"])  # keeps the emptied table first
    n = sinks.snapshot_history(spark, root).count()
    return spark.read.parquet(os.path.join(target, "transactions")).select(
        "transaction_hash", "transaction_date", "debit_amount", "currency", "is_settled", F.lit(n).cast("int").alias("snapshots"))


# ---- K9: categories named by decisions, added one by one --------------------
@register("added_categories", """
WITH names AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS name FROM customer)
SELECT 1 AS pos, 'food' AS name UNION ALL SELECT 2, 'other'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY name), name FROM names""")
def q_added_categories(spark, sf_dir):
    from ..operators.categories import add_category
    from ..sources.tables import category_template, read_table
    template = category_template(spark, ["food", "other"])
    current = template
    # market segments: a handful by the schema
    for r in read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect():
        for name in (f" {r[0]} ", r[0].lower()):  # the second is there already
            current = add_category(current, template, name)
    return current


# ---- W3: rules seen by the rows after the one that creates them, one row after the other
@register("rules_at_once", O.with_rules_at_once("""
SELECT o.path, o.sheet_row, o.outcome, CASE WHEN o.outcome = 'processed' THEN coalesce(o.used_enum_id, m.id) END AS enum_id,
       CASE WHEN o.outcome = 'processed' THEN o.enum_cat END AS category,
       CASE WHEN o.outcome = 'processed' THEN o.final_reason END AS reason
FROM outcomes o LEFT JOIN made m ON m.enum_name = o.new_enum_name AND m.born = o.i"""))
def q_rules_at_once(spark, sf_dir):
    from ..operators.outcomes import new_rules, with_enum_ids
    from ..session import stage
    from ..sources.derived import PROCESSOR, derived_rules
    from . import ingest
    o = stage(ingest.run(spark, sf_dir, rules_at_once=True).select(
        "path", "sheet_row", "position", "outcome", "used_enum_id", "existing_enum_id", "new_enum_name", "new_pattern",
        "final_category", "final_reason"), "outcomes")
    o = with_enum_ids(o, new_rules(o, derived_rules(spark), PROCESSOR))
    p = F.col("outcome") == "processed"
    return o.select("path", "sheet_row", "outcome", F.when(p, F.col("used_enum_id")).alias("enum_id"),
                    F.when(p, F.col("final_category")).alias("category"), F.when(p, F.col("final_reason")).alias("reason"))


# ---- P12 + E2 + P14: rows without an acceptable answer wait in the review table; a second
# run without new files gets the answers and stores them as one run would have ----------
@register("reviewed_later", O.with_all_answers("""
, plain AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.transaction_hash ORDER BY o.path, o.sheet_row) = 1 AS first_copy,
         CASE WHEN NOT o.is_valid THEN 'invalid' WHEN o.transaction_type = 'credit' AND o.credit_amount IS NULL THEN 'error_skipped' ELSE o.decided END AS alone
  FROM o4 o),
judged AS (
  SELECT *, CASE WHEN is_valid AND NOT first_copy AND alone = 'processed' THEN 'duplicate'
                 WHEN is_valid AND NOT first_copy AND alone = 'skipped' THEN 'auto_skipped' ELSE alone END AS result
  FROM plain),
per_file AS (
  SELECT path, count(*) AS total, count(*) FILTER (WHERE result = 'processed') AS processed,
         count(*) FILTER (WHERE result IN ('skipped', 'invalid', 'error_skipped')) AS skipped,
         count(*) FILTER (WHERE result = 'duplicate') AS duplicates, count(*) FILTER (WHERE result = 'auto_skipped') AS auto_skipped
  FROM judged GROUP BY path)
SELECT j.transaction_hash, j.result AS outcome, j.final_reason AS reason, j.transaction_category, j.currency,
       coalesce(r.enum_name, j.new_enum_name) AS rule_name, regexp_extract(j.path, '([^/]+)[.]csv$', 1) AS name,
       CASE WHEN f.processed + f.skipped = f.total THEN 'completed' ELSE 'partially_processed' END AS processing_status,
       f.total, f.processed, f.skipped, f.duplicates, f.auto_skipped
FROM judged j JOIN per_file f ON f.path = j.path LEFT JOIN rules r ON r.id = j.used_enum_id
WHERE j.result = 'processed'""".replace("\n, plain", ", plain", 1)))
def q_reviewed_later(spark, sf_dir):
    from ..sources.derived import (PROCESSOR, PROCESSOR_CURRENCIES, derived_decisions, derived_rules,
                                   statement_cells, write_statement_csv)
    from ..sources.tables import DEFAULT_CATEGORIES
    from . import sinks
    from .adapters import make_adapter, register_adapter
    from .file_pipeline import process_files
    folder, root = _scratch(spark, "statement-files"), _scratch(spark, "store")
    write_statement_csv(statement_cells(spark, sf_dir), folder)
    register_adapter(PROCESSOR, make_adapter(PROCESSOR_CURRENCIES, "csv"))
    rules = derived_rules(spark)
    process_files(spark, folder, root, PROCESSOR, rules, derived_decisions, DEFAULT_CATEGORIES, "r1", "csv", auto_match=False)
    process_files(spark, folder, root, PROCESSOR, rules, lambda rows: derived_decisions(rows, complete=True), DEFAULT_CATEGORIES, "r2", "csv", auto_match=False)
    known = rules.unionByName(sinks.read_table(spark, root, "transaction_enums").select(*rules.columns))
    files = sinks.read_latest(spark, root, "processed_files", "processed_file_id").select(
        "processed_file_id", F.regexp_extract("file_path", r"file_id=([^/]+)/", 1).alias("name"), "processing_status")
    logs = sinks.read_latest(spark, root, "processing_logs", "processed_file_id").select(
        "processed_file_id", F.col("total_transactions").alias("total"), F.col("processed_transactions").alias("processed"),
        F.col("skipped_transactions").alias("skipped"), F.col("duplicate_transactions").alias("duplicates"), F.col("duplicate_skipped").alias("auto_skipped"))
    names = known.select(F.col("id").alias("enum_id"), F.col("enum_name").alias("rule_name"))
    return (sinks.read_table(spark, root, "transactions").join(files, "processed_file_id", "left").join(logs, "processed_file_id", "left")
            .join(names, "enum_id", "left")
            .select("transaction_hash", F.lit("processed").alias("outcome"), "reason", "transaction_category", "currency", "rule_name", "name",
                    "processing_status", "total", "processed", "skipped", "duplicates", "auto_skipped"))


# ---- K4 (replace): a rule per market segment; three of them change rules that are there,
# which keep their place in the order of matching ------------------------------------------
@register("replaced_rules", O.with_base("""
, segs AS (SELECT DISTINCT c_mktsegment AS seg FROM customer),
changes AS (
  SELECT 100 + row_number() OVER (ORDER BY seg) AS id,
         CASE seg WHEN 'FURNITURE' THEN 'furniture_shop' WHEN 'MACHINERY' THEN 'machines' WHEN 'HOUSEHOLD' THEN 'household_off'
              ELSE lower(seg) || '_segment' END AS enum_name, lower(seg) AS pattern FROM segs),
old(id, enum_name, pattern, category, is_active) AS (VALUES
  (1, 'furniture_shop', 'furniture', 'shopping', true), (2, 'machines', 'machin', 'utilities', true), (2, 'machines', 'nation_1', 'utilities', true),
  (3, 'cars', 'automobile', 'transport', true), (3, 'cars', '-urgent', 'transport', true), (4, 'household_off', 'household', 'other', false),
  (6, 'usd_payments', ' usd', 'transfer', true), (7, 'france_spend', 'never-printed', 'transfer', false)),
pats AS (
  SELECT id, enum_name, pattern, category FROM old WHERE is_active AND enum_name NOT IN (SELECT enum_name FROM changes)
  UNION ALL
  SELECT coalesce((SELECT min(o.id) FROM old o WHERE o.enum_name = c.enum_name), c.id), c.enum_name, c.pattern, 'segment' FROM changes c),
best AS (SELECT t.transaction_hash, min(p.id) AS enum_id FROM txn t LEFT JOIN pats p ON contains(lower(t.description), p.pattern) GROUP BY t.transaction_hash)
SELECT b.transaction_hash, b.enum_id, p.enum_name, p.category AS enum_category
FROM best b LEFT JOIN (SELECT DISTINCT id, enum_name, category FROM pats) p ON p.id = b.enum_id""".replace("\n, segs", ", segs", 1)))
def q_replaced_rules(spark, sf_dir):
    from ..operators.numbering import dense_number
    from ..operators.rules import match_rules
    from ..sources.derived import PROCESSOR, derived_rules
    from ..sources.tables import read_table
    from . import sinks
    seg = F.col("c_mktsegment")
    name = (F.when(seg == "FURNITURE", F.lit("furniture_shop")).when(seg == "MACHINERY", F.lit("machines"))
            .when(seg == "HOUSEHOLD", F.lit("household_off")).otherwise(F.concat(F.lower(seg), F.lit("_segment"))))
    segments = read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    changes = dense_number(segments, ["c_mktsegment"], "id", 100).select(
        "id", name.alias("enum_name"), F.array(F.lower(seg)).alias("patterns"), F.lit("segment").alias("category"),
        F.lit(PROCESSOR).alias("processor_type"), F.lit(True).alias("is_active"))
    rules = sinks.upsert_rules(derived_rules(spark), changes)
    return match_rules(derived.transactions(spark, sf_dir), rules, PROCESSOR).select("transaction_hash", "enum_id", "enum_name", "enum_category")


# ---- P11 + J5: a person's history over transactions in a folder per month ----------------
@register("person_history_by_month", ORACLE["person_history"])
def q_person_history_by_month(spark, sf_dir):
    from .layout import lay_out_by_month
    t, s = _person_frames(spark, sf_dir)
    t = lay_out_by_month(t, _scratch(spark, "by-month"))
    return balances.person_transactions(t, s, PERSON, "1996-01-01", "1998-12-31").drop("split_id")


# ---- J1: every stored transaction against a history that is compacted in part: runs of
# the years before 1996, compacted, and a run of 1996 that came after ----------------------
@register("compacted_history", O.with_base("""
SELECT transaction_hash, transaction_date < TIMESTAMP '1997-01-01' AS known FROM txn"""))
def q_compacted_history(spark, sf_dir):
    import os

    from . import sinks
    from .layout import compact_history, known_keys
    root = _scratch(spark, "store")
    txn = derived.transactions(spark, sf_dir).select("transaction_hash", F.year("transaction_date").alias("y"))
    for run, years in (("old", F.col("y") < 1996), ("new", F.col("y") == 1996)):
        txn.filter(years).select("transaction_hash").write.parquet(os.path.join(root, "transactions", f"run_id={run}", "attempt=a1"))
        sinks.publish(spark, root, run, "a1")
        if run == "old":
            compact_history(spark, root)
    known = known_keys(spark, root, "transactions", txn).distinct().withColumn("_known", F.lit(True))
    return txn.join(known, "transaction_hash", "left").select("transaction_hash", F.coalesce("_known", F.lit(False)).alias("known"))
