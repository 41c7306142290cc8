"""The transaction report line as Columns (display projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.currency import currency_symbol

DESCRIPTION_WIDTH = 80


def report_lines(transactions: DataFrame) -> DataFrame:
    """Date as dd/MM/yyyy; description cut to 77 chars + '...' when longer
    than 80; symbol + thousands-separated 2-dp amount with (DEBIT)/(CREDIT);
    balance only when non-zero; reference only when non-empty; currency
    (missing -> INR)."""
    cur = F.coalesce(F.col("currency"), F.lit("INR"))
    sym = currency_symbol(cur)
    desc = F.col("description")
    is_debit = F.col("transaction_type") == "debit"
    amount = F.when(is_debit, F.concat(sym, F.format_number("debit_amount", 2), F.lit(" (DEBIT)"))).otherwise(
        F.concat(sym, F.format_number("credit_amount", 2), F.lit(" (CREDIT)")))
    return transactions.select(
        "transaction_hash",
        F.date_format("transaction_date", "dd/MM/yyyy").alias("date_text"),
        F.when(F.length(desc) > DESCRIPTION_WIDTH, F.concat(F.substring(desc, 1, DESCRIPTION_WIDTH - 3), F.lit("...")))
        .otherwise(desc).alias("description_text"),
        amount.alias("amount_text"),
        F.when(F.coalesce(F.col("balance"), F.lit(0.0)) != 0,
               F.concat(sym, F.format_number("balance", 2))).alias("balance_text"),
        F.when(F.coalesce(F.col("reference_number"), F.lit("")) != "", F.col("reference_number")).alias("reference_text"),
        cur.alias("currency"),
    )
