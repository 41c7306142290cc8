"""Currency detection, symbols and code validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .text import py_strip

# ---- fixed values (must equal the reference's behaviour) -------------------
# Regexes searched in the lowercased text, per currency code.
CURRENCY_PATTERNS = {
    "USD": [r"\$", r"usd", r"dollar", r"united states", r"us\s+dollar"],
    "EUR": [r"€", r"eur", r"euro", r"european"],
    "GBP": [r"£", r"gbp", r"pound", r"sterling", r"british"],
    "INR": [r"₹", r"inr", r"rupee", r"rs\.", r"indian"],
    "JPY": [r"¥", r"jpy", r"yen", r"japanese"],
    "CNY": [r"¥", r"cny", r"yuan", r"rmb", r"chinese"],
    "AUD": [r"aud", r"australian", r"a\$"],
    "CAD": [r"cad", r"canadian", r"c\$"],
    "CHF": [r"chf", r"swiss", r"franc"],
    "SGD": [r"sgd", r"singapore", r"s\$"],
}
# Display symbol per code; unknown codes display as themselves.
CURRENCY_SYMBOLS = {
    "USD": "$",
    "EUR": "€",
    "GBP": "£",
    "INR": "₹",
    "JPY": "¥",
    "CNY": "¥",
    "AUD": "A$",
    "CAD": "C$",
    "CHF": "CHF",
    "SGD": "S$",
}
DEFAULT_CURRENCY = "INR"
# ---------------------------------------------------------------------------


_META = set("\\.^$|?*+()[]{}")


def _as_literal(pattern: str) -> str | None:
    """The literal text a pattern matches, when it is a plain string once
    escapes are removed (``rs\\.`` -> ``rs.``); otherwise None."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and pattern[i + 1] in _META:
            out.append(pattern[i + 1])
            i += 2
            continue
        if ch in _META:
            return None
        out.append(ch)
        i += 1
    return "".join(out)


def currency_test(low: Column, code: str) -> Column:
    """True when any pattern of ``code`` occurs in the lowercased text.

    Literal patterns are substring tests (no regex scan over whole texts).
    A regex pattern is skipped when a literal pattern of the same currency
    occurs verbatim inside it at its end (``us\\s+dollar`` ends with
    ``dollar``): every match of it then contains that literal."""
    pats = CURRENCY_PATTERNS[code]
    lits = [x for x in (_as_literal(p) for p in pats) if x is not None]
    test = F.lit(False)
    for p in pats:
        lit = _as_literal(p)
        if lit is not None:
            test = test | low.contains(lit)
        elif not any(p.endswith(x) and x for x in lits):
            test = test | low.rlike("(?U)" + p)
    return test


def currency_tags(low: Column, available: Sequence[str]) -> Column:
    """Comma-joined codes of every available currency hit in the (already
    lowercased) text; each test is evaluated once.  Codes are three letters,
    so exactly one hit <=> the result has length 3."""
    codes = [c for c in dict.fromkeys(available) if c in CURRENCY_PATTERNS]
    if not codes:
        return F.lit("")
    return F.concat_ws(",", *[F.when(currency_test(low, c), F.lit(c)) for c in codes])


def single_hit(tags: Column) -> Column:
    return F.when(F.length(tags) == 3, tags)


def detect_currency(text, available: Sequence[str]) -> Column:
    """the single currency among ``available`` whose patterns hit the
    lowercased text; null when none or more than one hit."""
    return single_hit(currency_tags(F.lower(as_col(text)), available))


def currency_symbol(code) -> Column:
    """display symbol, or the code itself when unknown."""
    pairs = []
    for k, v in CURRENCY_SYMBOLS.items():
        pairs += [F.lit(k), F.lit(v)]
    c = as_col(code)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def is_valid_currency_code(code) -> Column:
    """exactly three letters; null is not valid."""
    return F.coalesce(as_col(code).rlike(r"^\p{L}{3}\z"), F.lit(False))


def normalize_currency_list(codes) -> Column:
    """F12 over an array column: valid codes uppercased (duplicates kept),
    ``[INR]`` when none is valid."""
    kept = F.transform(F.filter(as_col(codes), lambda x: is_valid_currency_code(x)), F.upper)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(DEFAULT_CURRENCY)))


def normalize_currency_config(value) -> list[str]:
    """F12 for a configuration value (str or list) on the driver."""
    def valid(x):
        return isinstance(x, str) and len(x) == 3 and x.isalpha()

    if isinstance(value, str):
        return [value.upper()] if valid(value) else [DEFAULT_CURRENCY]
    if isinstance(value, (list, tuple)):
        out = [x.upper() for x in value if valid(x)]
        return out or [DEFAULT_CURRENCY]
    return [DEFAULT_CURRENCY]
