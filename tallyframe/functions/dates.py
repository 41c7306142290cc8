"""Statement date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .text import py_strip_column

# ---- fixed values ----------------------------------------------------------
# Accepted statement date layouts, tried in order (day-month-year).
DATE_SEPARATORS = ["-", "/"]
# ---------------------------------------------------------------------------

# strptime's %d / %m accept one or two digits, %Y exactly four.
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"


def parse_statement_date(c) -> Column:
    """strip; blank/``nan`` -> null; ``d-m-Y`` then ``d/m/Y``; anything
    else (including impossible dates such as 31-02-2024) -> null."""
    s = py_strip_column(as_col(c))
    tries = []
    for sep in DATE_SEPARATORS:
        shape = f"^{_DAY}{sep}{_MONTH}{sep}[0-9]{{4}}$"
        tries.append(F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f"d{sep}M{sep}yyyy"))))
    return F.coalesce(*tries)
