"""Fixed table schemas (one StructType per stored table).

Transactions are keyed by ``transaction_hash``; other ids are derived with
``xxhash64`` of the logical key, so no single-node autoincrement is needed.
Rules keep an explicit ``id`` because first-match order depends on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

SPLIT_ITEM = T.StructType([
    T.StructField("person", T.StringType()),
    T.StructField("percentage", T.DoubleType()),
])

INSTITUTIONS = T.StructType([
    T.StructField("institution_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("institution_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PROCESSED_FILES = T.StructType([
    T.StructField("processed_file_id", T.LongType(), False),
    T.StructField("institution_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("processor_type", T.StringType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

TRANSACTION_ENUMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("enum_name", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("processor_type", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("institution_id", T.LongType()),
    T.StructField("processed_file_id", T.LongType()),
    T.StructField("transaction_date", T.TimestampType()),
    T.StructField("description", T.StringType()),
    T.StructField("debit_amount", T.DoubleType()),
    T.StructField("credit_amount", T.DoubleType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("reference_number", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("enum_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("transaction_category", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("splits", T.ArrayType(SPLIT_ITEM)),
    T.StructField("has_splits", T.BooleanType()),
    T.StructField("is_settled", T.BooleanType()),
])

TRANSACTION_SPLITS = T.StructType([
    T.StructField("split_id", T.LongType(), False),
    T.StructField("transaction_hash", T.StringType()),
    T.StructField("person_name", T.StringType()),
    T.StructField("percentage", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("is_settled", T.BooleanType()),
])

SKIPPED_TRANSACTIONS = T.StructType([
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("institution_id", T.LongType()),
    T.StructField("processed_file_id", T.LongType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("row_number", T.LongType()),
    T.StructField("skip_reason", T.StringType()),
])

PROCESSING_LOGS = T.StructType([
    T.StructField("processed_file_id", T.LongType(), False),
    T.StructField("total_transactions", T.LongType()),
    T.StructField("processed_transactions", T.LongType()),
    T.StructField("skipped_transactions", T.LongType()),
    T.StructField("duplicate_transactions", T.LongType()),
    T.StructField("duplicate_skipped", T.LongType()),
    T.StructField("processing_time", T.DoubleType()),
])

# Rows that await a decision: what a later run needs to judge them.
REVIEW_ROWS = T.StructType([
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("sheet_row", T.LongType()),
    T.StructField("row_number", T.LongType()),
    T.StructField("file_position", T.LongType()),
    T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("transaction_date", T.TimestampType()),
    T.StructField("description", T.StringType()),
    T.StructField("debit_amount", T.DoubleType()),
    T.StructField("credit_amount", T.DoubleType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("reference_number", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("currency_known", T.BooleanType()),
])

# Raw statement cells as produced by every source.
CELLS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("sheet_row", T.LongType(), False),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

# Human decisions replacing the interactive prompts.
DECISIONS = T.StructType([
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("action", T.StringType()),          # process | skip | new_pattern
    T.StructField("category_choice", T.StringType()),  # '', digits, or free text
    T.StructField("reason", T.StringType()),
    T.StructField("splits_spec", T.StringType()),      # "name:pct,name:pct"
    T.StructField("pattern", T.StringType()),
    T.StructField("enum_name", T.StringType()),
    T.StructField("enum_category", T.StringType()),
    T.StructField("currency", T.StringType()),
])

TABLES = {
    "institutions": INSTITUTIONS,
    "processed_files": PROCESSED_FILES,
    "transaction_enums": TRANSACTION_ENUMS,
    "transactions": TRANSACTIONS,
    "transaction_splits": TRANSACTION_SPLITS,
    "skipped_transactions": SKIPPED_TRANSACTIONS,
    "processing_logs": PROCESSING_LOGS,
    "review_rows": REVIEW_ROWS,
}

# Column defaults used when conforming older tables.
DEFAULTS = {
    "currency": "INR",
    "is_settled": False,
    "has_splits": False,
    "is_active": True,
    "processing_status": "processing",
}
