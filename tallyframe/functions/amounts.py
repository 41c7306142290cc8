"""Amount parsing and Python-compatible float text.

``py_float`` reproduces Python ``float(str)`` acceptance with a guard regex
in front of ``try_cast`` (Spark also accepts ``1d``/``1.0f``/hex floats,
Python does not).  ``py_float_str`` reproduces ``str(float)`` so that
transaction hashes are byte-identical to the reference's.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_col
from .text import py_strip

# ---- fixed values ----------------------------------------------------------
# Characters removed before parsing an amount.
AMOUNT_STRIP_CHARS = ",₹$€"
# Largest accepted absolute amount.
AMOUNT_LIMIT = 1e12
# ---------------------------------------------------------------------------

# Decimal digits of all scripts and what each is worth, by rule: Python reads them.
_DIGITS = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")
_WORTH = "".join(str(unicodedata.digit(c)) for c in _DIGITS)
# Digits with single underscores between them; a decimal literal with optional
# exponent, or Python's inf/nan spellings.
_D = r"[0-9](?:_?[0-9])*"
# Digits with an optional fraction: a number as it stands, without a currency.
PLAIN_NUMBER_RE = r"^[0-9]{1,15}(?:\.[0-9]{1,15})?\z"
_PY_FLOAT_RE = rf"^[+-]?((?:{_D}\.?(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])$"


def py_float(c) -> Column:
    """Python ``float(text)`` or null where Python raises ValueError."""
    x = as_col(c)
    t = _plain_number(x)
    return F.when(x.rlike(PLAIN_NUMBER_RE), x.try_cast("double")).when(t.rlike(_PY_FLOAT_RE), _try_double(t))


def _plain_number(s: Column) -> Column:
    """Number text without the white space around it, in ASCII digits."""
    return _ascii_digits(py_strip(s))


def _ascii_digits(t: Column) -> Column:
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, _DIGITS, _WORTH)).otherwise(t)


def _try_double(t: Column) -> Column:
    t = F.replace(t, F.lit("_"), F.lit(""))
    t = F.regexp_replace(t, r"(?i)^([+-]?)inf(inity)?$", "$1Infinity")
    t = F.regexp_replace(t, r"(?i)^[+-]?nan$", "NaN")
    return t.try_cast("double")


def is_py_float(c) -> Column:
    """True when ``float(text)`` succeeds in Python."""
    x = as_col(c)
    return F.coalesce(x.rlike(PLAIN_NUMBER_RE) | _plain_number(x).rlike(_PY_FLOAT_RE), F.lit(False))


def validate_amount(c) -> Column:
    """strip ``, ₹ $ €``, parse, keep 0 <= x <= 1e12 (NaN/inf -> null)."""
    cleaned = _plain_number(F.translate(as_col(c), AMOUNT_STRIP_CHARS, ""))
    return _in_range(F.when(cleaned.rlike(_PY_FLOAT_RE), _try_double(cleaned)))


def _in_range(v: Column) -> Column:
    # ``between`` is false for NaN, so NaN and +-inf drop out here.
    return F.when(v.between(F.lit(0.0), F.lit(AMOUNT_LIMIT)) & ~F.isnan(v), v).cast("double")


def with_amounts(df: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """F1 for several text columns (new column -> text column).  Built in stages: the
    stripped text, the number text and the number are each computed once and
    referenced, where ``validate_amount`` repeats them inside its conditions.  A plain
    number is cast as it stands; a missing one (``nan``) is no amount."""
    known = df.withColumns({f"{new}_p": F.coalesce(F.col(text).rlike(PLAIN_NUMBER_RE), F.lit(False)) for new, text in amounts.items()})
    stripped = known.withColumns({f"{new}_s": F.when(~F.col(f"{new}_p") & ~F.col(text).isin("", "nan"), py_strip(F.translate(F.col(text), AMOUNT_STRIP_CHARS, "")))
                                  for new, text in amounts.items()})
    plain = stripped.withColumns({f"{new}_n": _ascii_digits(F.col(f"{new}_s")) for new in amounts})
    number = plain.withColumns({f"{new}_v": F.when(F.col(f"{new}_p"), F.col(text).try_cast("double"))
                                .when(F.col(f"{new}_n").rlike(_PY_FLOAT_RE), _try_double(F.col(f"{new}_n"))) for new, text in amounts.items()})
    return number.withColumns({new: _in_range(F.col(f"{new}_v")) for new in amounts}).drop(*[f"{new}_{x}" for new in amounts for x in "psnv"])


def py_float_str(c) -> Column:
    """Python ``str(float)`` for a double Column (null stays null).

    Exact for 0 and 1e-4 <= |x| < 1e16: print the decimal through a decimal
    cast, strip trailing zeros, keep one ``.0``.  Tiny values use Python's
    ``1e-05`` exponent style.  The digits come from the JVM's
    ``Double.toString``, which before JDK 19 is not always the shortest form
    for doubles needing 16-17 significant digits (e.g. 2**-24); amounts
    parsed from statement text (<= 15 significant digits) are exact.
    """
    x = as_col(c)
    dec = x.cast("decimal(38,18)").cast("string")
    no_zeros = F.call_function("rtrim", F.lit("0"), dec)
    trimmed = F.concat(no_zeros, F.when(no_zeros.endswith("."), F.lit("0")).otherwise(F.lit("")))
    # Spark prints tiny values as 1.5E-5; Python as 1.5e-05.
    sci = x.cast("string")
    sci = F.regexp_replace(sci, r"\.0E", "E")
    sci = F.regexp_replace(sci, r"E-(\d)$", "e-0$1")
    sci = F.regexp_replace(sci, r"E-(\d\d+)$", "e-$1")
    big = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)$", "e+$1")
    big = F.regexp_replace(big, r"E(\d\d+)$", "e+$1")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, x.cast("string"))
        .when(F.abs(x) < 1e-4, sci)
        .when(F.abs(x) >= 1e16, big)
        .otherwise(trimmed)
    )


def split_base_amount(debit, credit) -> Column:
    """F16: Python ``debit or credit or 0`` (0.0 and null fall through)."""
    d, c = as_col(debit), as_col(credit)
    return F.coalesce(F.nullif(d, F.lit(0.0)), F.nullif(c, F.lit(0.0)), F.lit(0.0))
