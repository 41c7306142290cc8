"""Layouts of the store that small reads can prune.

``lay_out_by_month`` keeps transactions in a folder per month: a range of dates
reads its months only (``person_transactions`` turns the range into a partition
filter).

``compact_history`` keeps the hashes of all runs up to a manifest version as a
narrow table, in a folder per prefix of the hash.  ``known_keys`` reads the
prefixes that occur in a batch, and the runs published since; a run that was
replaced or is left out counts no more, as in ``read_table``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.balances import MONTH, month_number
from . import sinks

#: Tables whose hashes a run is judged against.
HISTORY = ("transactions", "skipped_transactions")
#: Hashes that a prefix should hold, and the longest prefix (65,536 folders).
PREFIX_ROWS, MOST_DIGITS = 4_000_000, 4


def lay_out_by_month(transactions: DataFrame, path: str) -> DataFrame:
    """Write transactions in a folder per month and read them back.  The rebalance
    splits a month that holds much of all rows over several tasks and files; rows
    without a date have a folder of their own."""
    rows = transactions.withColumn(MONTH, month_number(F.col("transaction_date")))
    rows.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH).parquet(path)
    return transactions.sparkSession.read.parquet(path)


def prefix(digits: int) -> Column:
    """The first hex digits of a transaction's hash, which are spread evenly."""
    return F.concat(F.lit("h"), F.substring("transaction_hash", 1, digits))


def _folder(root: str, attempt: str) -> str:
    return os.path.join(root, "_history", f"attempt={attempt}")


def compact_history(spark: SparkSession, root: str, prefix_rows: int = PREFIX_ROWS) -> int:
    """Write the hashes of all published runs by prefix; returns the manifest version
    that they reach to.  Readers see the new table once it is named in a manifest of
    its own, so a writer killed before leaves the older one."""
    upto = sinks.published(spark, root).agg(F.coalesce(F.max("run_version"), F.lit(0))).first()[0]  # one number
    rows = None
    for table in HISTORY:
        own = (sinks.read_table(spark, root, table, versions=True).filter(F.col("run_version") <= upto)
               .select("transaction_hash", "run_id", "run_version", F.lit(table).alias("table")))
        rows = own if rows is None else rows.unionByName(own)
    n, digits = rows.count(), 1
    while digits < MOST_DIGITS and n > prefix_rows * 16**digits:
        digits += 1
    attempt = "a" + uuid.uuid4().hex
    (rows.withColumn("prefix", prefix(digits)).hint("rebalance", F.col("table"), F.col("prefix"))
     .write.partitionBy("table", "prefix").parquet(_folder(root, attempt)))
    sinks.publish(spark, os.path.join(root, "_history"), f"{upto}-{digits}", attempt)
    return upto


def known_keys(spark: SparkSession, root: str, table: str, batch: DataFrame, without_run: str | None = None) -> DataFrame:
    """(transaction_hash): those of the published rows of ``table`` that may be in
    ``batch``, by its ``transaction_hash``.  Of a compacted history only the prefixes
    of the batch are read; hashes outside them can match nothing."""
    newest = sinks.published(spark, os.path.join(root, "_history")).orderBy(F.desc("run_version")).first()  # a row per compaction
    recent = sinks.read_table(spark, root, table, without_run, versions=True)
    if newest is None:
        return recent.select("transaction_hash")
    upto, digits = (int(x) for x in newest["run_id"].split("-"))
    recent = recent.filter(F.col("run_version") > upto).select("transaction_hash")
    folder = _folder(root, newest["attempt"])
    if not any(n.startswith("table=") for n in sinks._names(spark, folder)):  # compacted before any row was stored
        return recent
    asked = [r[0] for r in batch.filter("transaction_hash is not null").select(prefix(digits)).distinct().collect()]  # 16**MOST_DIGITS at most
    runs = sinks.published(spark, root)
    if without_run is not None:
        runs = runs.filter(F.col("run_id") != without_run)
    old = spark.read.parquet(folder).filter((F.col("table") == table) & F.col("prefix").isin(asked))
    old = old.join(runs.select("run_id", "run_version"), ["run_id", "run_version"], "left_semi")
    return recent.unionByName(old.select("transaction_hash"))
