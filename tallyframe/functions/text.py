"""Text Column functions: stripping, sanitizing, masking, normalizing.

All are built-in Column expressions so they stay inside whole-stage codegen.
Java regexes run with ``(?U)`` so that ``\\w`` / ``\\s`` are Unicode aware,
matching Python's ``re`` defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_col

# ---- fixed values (must equal the reference's behaviour) -------------------
# Stopwords dropped by pattern suggestions, in the reference's order.
SUGGESTION_STOPWORDS = ["to", "from", "the", "and", "or", "in", "on", "at", "by", "for"]
# Fallback suggestion when nothing survives.
DEFAULT_SUGGESTION = "transaction"
# Remarks containing any of these mark a header-like data row.
HEADER_INDICATORS = [
    "transaction remarks",
    "transaction date",
    "withdrawal amount",
    "deposit amount",
    "balance",
    "cheque number",
]
# Dangerous-pattern replacements applied after HTML escaping, in order.
BLOCKED_REPLACEMENTS = [
    ("javascript:", "[BLOCKED:javascript]"),
    ("vbscript:", "[BLOCKED:vbscript]"),
    ("data:", "[BLOCKED:data]"),
    ("<script", "[BLOCKED:script]"),
    ("<iframe", "[BLOCKED:iframe]"),
    ("<object", "[BLOCKED:object]"),
    ("<embed", "[BLOCKED:embed]"),
    (r"on\w+\s*=", "[BLOCKED:event_handler]"),
]
# Patterns that make text unsafe to display as-is.
UNSAFE_DISPLAY_PATTERNS = [r"<script", r"javascript:", r"on\w+\s*=", r"<iframe", r"<object", r"<embed"]
# ---------------------------------------------------------------------------

# Characters Python's ``str.isspace()`` accepts; ``str.strip()`` removes them.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends
    (``btrim`` over the exact character set; no regex)."""
    return F.btrim(as_col(c), F.lit(PY_WHITESPACE))


def py_strip_column(c) -> Column:
    """``py_strip`` of a column or a cell: as most texts begin and end with printable
    ASCII, two comparisons come before the search for white space.  ``c`` is named
    several times, so it should not be a long expression."""
    x = as_col(c)
    last = F.substring(x, -1, 1)
    return F.when((x >= "!") & (x < "\x7f") & (last >= "!") & (last < "\x7f"), x).otherwise(py_strip(x))


def html_escape(c) -> Column:
    """``html.escape(s, quote=True)``; ``&`` first so entities are not doubled."""
    x = as_col(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def sanitize_text(c, max_length: int | None = None) -> Column:
    """strip, truncate, HTML-escape, then neutralise script protocols and
    event handlers (case-insensitive).  Null or empty input gives ``""``."""
    x = py_strip(as_col(c))
    if max_length:
        x = F.substring(x, 1, int(max_length))
    return F.coalesce(_block(html_escape(x)), F.lit(""))


def _block(x: Column) -> Column:
    for pattern, replacement in BLOCKED_REPLACEMENTS:
        x = F.regexp_replace(x, "(?iU)" + pattern, replacement.replace("$", "\\$"))
    return x


def with_sanitized(df: DataFrame, out: str, text: str, max_length: int | None = None) -> DataFrame:
    """F3 as a column, in two stages: a text without any of the patterns, as nearly all
    are, takes one test instead of a replacement for each."""
    x = py_strip_column(F.col(text))
    escaped = df.withColumn("_escaped", html_escape(F.substring(x, 1, int(max_length)) if max_length else x))
    e = F.col("_escaped")  # every pattern has one of these signs
    risky = (e.contains(":") | e.contains("=") | e.contains("<")) & e.rlike("(?iU)" + "|".join(pattern for pattern, _ in BLOCKED_REPLACEMENTS))
    return escaped.withColumn(out, F.coalesce(F.when(risky, _block(F.col("_escaped"))).otherwise(F.col("_escaped")), F.lit(""))).drop("_escaped")


def is_safe_for_display(c) -> Column:
    """false when any dangerous pattern occurs (case-insensitive)."""
    x = as_col(c)
    return ~F.coalesce(x.rlike("(?iU)" + "|".join(UNSAFE_DISPLAY_PATTERNS)), F.lit(False))


def sanitize_filename(c) -> Column:
    """drop traversal sequences, turn separators into ``_``, collapse."""
    x = as_col(c)
    for pattern in (r"\.\./", r"\.\.\\", r"(?i)%2e%2e%2f", r"(?i)%2e%2e%5c"):
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(x, r"[\\/]", "_")
    x = F.regexp_replace(x, r"(?i)%2f", "_")
    x = F.regexp_replace(x, r"(?i)%5c", "_")
    x = F.regexp_replace(x, r"\.\.", "")
    x = F.regexp_replace(x, r"_+", "_")
    x = F.regexp_replace(x, r"^_+", "")
    x = F.regexp_replace(x, r"[\x00-\x1f\x7f]", "")
    return F.coalesce(x, F.lit(""))


def escape_like(c) -> Column:
    """escape SQL LIKE wildcards ``%`` and ``_`` with a backslash."""
    x = F.replace(F.replace(as_col(c), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return F.coalesce(x, F.lit(""))


def mask_url(c) -> Column:
    """hide query strings (``?***``) or ``user:pw@`` credentials."""
    url = as_col(c)
    no_query = F.concat(F.substring_index(url, "?", 1), F.lit("?***"))
    before_at = F.substring_index(url, "@", 1)
    after_first_at = F.split(url, "@", -1).getItem(1)
    masked_creds = F.concat(F.substring_index(before_at, "://", 1), F.lit("://***@"), after_first_at)
    return (
        F.when(url.contains("?"), no_query)
        .when(url.contains("@") & before_at.contains("://"), masked_creds)
        .otherwise(url)
    )


def normalize_person(c) -> Column:
    """``lower(strip(name))``."""
    return F.lower(py_strip(as_col(c)))


def normalize_category(c) -> Column:
    """lower + strip, blank becomes null."""
    return F.nullif(F.lower(py_strip(as_col(c))), F.lit(""))


def institution_display_name(c) -> Column:
    """``icici_bank`` -> ``Icici Bank``."""
    return F.initcap(F.replace(as_col(c), F.lit("_"), F.lit(" ")))


def enum_name_default(name, pattern) -> Column:
    """keep a typed name of >= 3 chars, else ``<pattern>_transaction``."""
    n = py_strip(as_col(name))
    return F.when(F.length(n) >= 3, n).otherwise(F.concat(as_col(pattern), F.lit("_transaction")))


def reason_default(reason, default) -> Column:
    """A reason of >= 3 chars is kept; blank takes ``default``;
    1-2 chars is rejected (null)."""
    r = py_strip_column(F.coalesce(as_col(reason), F.lit("")))
    return F.when(F.length(r) >= 3, r).when(F.length(r) == 0, as_col(default))


def pattern_words(c) -> Column:
    """All suggestion candidates of a text, in text order (F13 without the
    top-5 cut): lower, split on whitespace, drop stopwords and words shorter
    than 3, strip non-alphanumerics, keep cleaned words of >= 3."""
    words = F.split(py_strip(F.lower(as_col(c))), r"(?U)\s+")
    stop = F.array(*[F.lit(w) for w in SUGGESTION_STOPWORDS])
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    cleaned = F.transform(kept, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(cleaned, lambda w: F.length(w) >= 3)


def pattern_suggestions(c, k: int = 5) -> Column:
    """first ``k`` pattern suggestions of a description."""
    return F.slice(pattern_words(c), 1, k)


def suggested_pattern(c) -> Column:
    """Best suggestion, or ``transaction`` when there is none."""
    return F.coalesce(F.get(pattern_words(c), 0), F.lit(DEFAULT_SUGGESTION))


def is_header_like(remarks) -> Column:
    """Lowered remarks contain any header indicator."""
    low = F.lower(as_col(remarks))
    hit = F.lit(False)
    for word in HEADER_INDICATORS:
        hit = hit | low.contains(word)
    return hit


def to_base64(c) -> Column:
    """snapshot payload encoding (plain base64, not encryption)."""
    return F.base64(F.encode(as_col(c), "UTF-8"))


def from_base64(c) -> Column:
    return F.decode(F.unbase64(as_col(c)), "UTF-8")
