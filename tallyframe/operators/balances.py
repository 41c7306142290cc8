"""Balance operators: first-occurrence dedup (U3), split rows (K5/F16),
and the shared-expense queries (A1, A2, J4, J5, P10, O1, O3, J6).

Splits reference transactions by ``transaction_hash``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import split_base_amount
from ..functions.hashing import surrogate_id
from ..functions.text import normalize_person


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key by ``order``.

    A single numeric ``order`` column that is unique within a key is a hash
    aggregate of that number and a semi-join of the rows; otherwise

    ``min_by`` over a struct of the row is a partial aggregate: a hot key
    (many copies of one transaction) is reduced map-side to one row per task
    before the shuffle, instead of being sorted whole in one task as a
    window would."""
    keys = [key] if isinstance(key, str) else list(key)
    if len(order) == 1 and dict(df.dtypes)[order[0]] in ("bigint", "int"):
        first = df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
        return df.join(first, [*keys, order[0]], "left_semi")
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def explode_splits(transactions: DataFrame) -> DataFrame:
    """K5: one split row per ``splits`` element of each transaction.

    person lower+strip, amount = base * pct/100 with base = debit, else
    credit, else 0; currency copied; unsettled."""
    base = split_base_amount(F.col("debit_amount"), F.col("credit_amount"))
    exploded = transactions.filter(F.col("has_splits")).select(
        "transaction_hash", "currency", base.alias("_base"),
        F.posexplode("splits").alias("_pos", "_s"))
    return exploded.select(
        surrogate_id(F.col("transaction_hash"), F.col("_pos")).alias("split_id"),
        "transaction_hash",
        normalize_person(F.col("_s.person")).alias("person_name"),
        F.col("_s.percentage").alias("percentage"),
        (F.col("_base") * (F.col("_s.percentage") / 100)).alias("amount"),
        F.coalesce(F.col("currency"), F.lit("INR")).alias("currency"),
        F.lit(False).alias("is_settled"),
    )


def money_sum(c: Column) -> Column:
    """Order-independent money sum: add in decimal, round to cents."""
    return F.round(F.sum(c.cast("decimal(38,6)")), 2).cast("double")


def unsettled_by_person(splits: DataFrame, person: str | None = None,
                        by_currency: bool = False) -> DataFrame:
    """A1: unsettled amount and count per person (optionally per currency).

    ``is_settled IS false`` excludes nulls, as the reference's filter does."""
    s = splits.filter(F.col("is_settled") == F.lit(False))
    if person is not None:
        s = s.filter(F.col("person_name") == person.lower().strip())
    keys = ["person_name", "currency"] if by_currency else ["person_name"]
    return s.groupBy(*keys).agg(
        money_sum(F.col("amount")).alias("unsettled_amount"),
        F.count("split_id").alias("unsettled_count"),
    )


def _person_join(transactions: DataFrame, splits: DataFrame, person: str) -> DataFrame:
    s = splits.filter(F.col("person_name") == person.lower().strip())
    t = transactions.select("transaction_hash", "transaction_date", "description", "debit_amount",
                            "credit_amount", "transaction_type", "reference_number")
    s = s.select("split_id", "transaction_hash", "person_name", "percentage", "amount",
                 F.col("currency").alias("split_currency"), F.col("is_settled").alias("split_settled"))
    return t.join(s, "transaction_hash")


def unsettled_transactions(transactions: DataFrame, splits: DataFrame, person: str) -> DataFrame:
    """J4 + O1: a person's unsettled split rows with their transaction,
    newest first (hash breaks ties)."""
    j = _person_join(transactions, splits, person)
    return j.filter(F.col("split_settled") == F.lit(False)).orderBy(
        F.desc("transaction_date"), "transaction_hash", "split_id")


#: Month (yyyyMM) of a transaction, where a layout has it as a partition column.
MONTH = "txn_month"


def month_number(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def person_transactions(transactions: DataFrame, splits: DataFrame, person: str,
                        start_date=None, end_date=None) -> DataFrame:
    """J5 + P11: all of a person's split rows, optional inclusive range.  Where
    transactions are laid out by month, the range is a partition filter, too."""
    if MONTH in transactions.columns:
        if start_date is not None:
            transactions = transactions.filter(F.col(MONTH) >= month_number(F.lit(start_date).cast("timestamp")))
        if end_date is not None:
            transactions = transactions.filter(F.col(MONTH) <= month_number(F.lit(end_date).cast("timestamp")))
    j = _person_join(transactions, splits, person)
    if start_date is not None:
        j = j.filter(F.col("transaction_date") >= F.lit(start_date).cast("timestamp"))
    if end_date is not None:
        j = j.filter(F.col("transaction_date") <= F.lit(end_date).cast("timestamp"))
    return j


def person_total(transactions: DataFrame, splits: DataFrame, person: str,
                 start_date=None, end_date=None) -> DataFrame:
    """A2: one row, the person's total split amount (0.0 when none)."""
    j = person_transactions(transactions, splits, person, start_date, end_date)
    return j.agg(F.coalesce(money_sum(F.col("amount")), F.lit(0.0)).alias("total_amount"))


def by_currency(df: DataFrame, currency: str | None = None) -> DataFrame:
    """P10: filter on currency (pushed to the scan), or counts per currency."""
    if currency is not None:
        return df.filter(F.col("currency") == currency)
    return df.groupBy("currency").agg(F.count(F.lit(1)).alias("n"))


def recent_transactions(transactions: DataFrame, k: int = 100,
                        transaction_type: str | None = None) -> DataFrame:
    """O3: newest ``k`` transactions (top-k is the feature); hash breaks ties.
    Plans as TakeOrderedAndProject: each task keeps k rows."""
    t = transactions
    if transaction_type is not None:
        t = t.filter(F.col("transaction_type") == transaction_type)
    return t.orderBy(F.desc("transaction_date"), F.asc("transaction_hash")).limit(k)


def enrich(transactions: DataFrame, institutions: DataFrame | None = None,
           files: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Left joins to the dimension tables (broadcast-sized by AQE)."""
    t = transactions
    if institutions is not None:
        t = t.join(institutions.select("institution_id", F.col("name").alias("institution_name")),
                   "institution_id", "left")
    if files is not None:
        t = t.join(files.select("processed_file_id", "file_name"), "processed_file_id", "left")
    if rules is not None:
        t = t.join(rules.select(F.col("id").alias("enum_id"), "enum_name"), "enum_id", "left")
    return t
