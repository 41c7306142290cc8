"""Deduplication hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .amounts import py_float_str
from .text import py_strip


def transaction_text(date, description, debit, credit, reference) -> Column:
    """``lower("{yyyy-MM-dd}_{description}_{debit}_{credit}_{reference}")`` with
    amounts as Python ``str(float)`` and a missing amount as ``None``."""
    d = as_col(date)
    parts = [
        F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("unknown_date")),
        F.coalesce(as_col(description), F.lit("")),
        F.coalesce(py_float_str(as_col(debit)), F.lit("None")),
        F.coalesce(py_float_str(as_col(credit)), F.lit("None")),
        F.coalesce(as_col(reference), F.lit("")),
    ]
    return F.lower(F.concat_ws("_", *parts))


def transaction_hash(date, description, debit, credit, reference) -> Column:
    """SHA-256 hex of the stripped ``transaction_text``."""
    return F.sha2(py_strip(transaction_text(date, description, debit, credit, reference)), 256)


def raw_row_hash(raw_json, *keys) -> Column:
    """F8 (re-aimed, D8): hash of the raw row and its location, so the same
    invalid row imported twice gets the same key."""
    return F.sha2(F.concat_ws("_", F.coalesce(as_col(raw_json), F.lit("")),
                              *[F.coalesce(as_col(k).cast("string"), F.lit("")) for k in keys]), 256)


def surrogate_id(*cols) -> Column:
    """Stable 64-bit id of a logical key (replaces autoincrement ids)."""
    return F.xxhash64(*[as_col(c) for c in cols])
