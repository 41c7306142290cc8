"""Stored-state tables derived from the driver's tables.

``transactions``: the first copy of every valid statement row (what a run
over all statements would have stored).  ``splits``: one split per line item
of the order behind a transaction, person = supplier name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import split_base_amount
from ..functions.hashing import surrogate_id
from ..functions.text import normalize_person
from ..operators.balances import first_per_key
from ..operators.statements import clean_statements
from ..sources.derived import PROCESSOR_CURRENCIES, statement_cells
from ..sources.tables import read_table

TXN_COLUMNS = ["transaction_hash", "path", "sheet_row", "row_number", "transaction_date", "description",
               "debit_amount", "credit_amount", "balance", "reference_number", "transaction_type",
               "currency"]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept statement row, typed (valid and invalid), staged by the cleaning."""
    return clean_statements(statement_cells(spark, sf_dir), PROCESSOR_CURRENCIES)


def transactions(spark: SparkSession, sf_dir: str, batch: DataFrame | None = None) -> DataFrame:
    """Stored transactions: first copy per hash by (path, sheet_row).
    ``batch`` is an already cleaned (staged) frame to reuse."""
    batch = batch if batch is not None else cleaned(spark, sf_dir)
    valid = batch.filter("is_valid").select(*TXN_COLUMNS, "position")
    return first_per_key(valid, "transaction_hash", ["position"]).drop("position")


def splits(spark: SparkSession, sf_dir: str, txns: DataFrame | None = None) -> DataFrame:
    """Split rows: lineitem ⋈ transaction (by order key) ⋈ supplier.

    percentage = l_quantity*100 / greatest(100, order quantity), amount =
    base * pct/100, settled when the line status is F.  The per-order
    quantity is a partial aggregate joined back on the order key (no
    window: one order may be very large)."""
    txns = txns if txns is not None else transactions(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber",
                                                      "l_quantity", "l_linestatus")
    per_order = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("order_qty"))
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    t = txns.select("transaction_hash", F.col("reference_number").cast("long").alias("l_orderkey"),
                    split_base_amount(F.col("debit_amount"), F.col("credit_amount")).alias("base"),
                    "currency")
    pct = F.col("l_quantity") * 100 / F.greatest(F.lit(100.0), F.col("order_qty"))
    return (li.join(per_order, "l_orderkey").join(t, "l_orderkey")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(surrogate_id(F.col("transaction_hash"), F.col("l_linenumber")).alias("split_id"),
                    "transaction_hash",
                    normalize_person(F.col("s_name")).alias("person_name"),
                    pct.alias("percentage"),
                    (F.col("base") * (pct / 100)).alias("amount"),
                    "currency",
                    (F.col("l_linestatus") == "F").alias("is_settled")))
