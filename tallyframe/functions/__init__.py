"""Scalar Column functions (F1-F23 of the survey)."""

from .amounts import (is_py_float, py_float, py_float_str, split_base_amount,  # noqa: F401
                      validate_amount)
from .currency import (CURRENCY_PATTERNS, CURRENCY_SYMBOLS, currency_symbol,  # noqa: F401
                       detect_currency, is_valid_currency_code, normalize_currency_config,
                       normalize_currency_list)
from .dates import parse_statement_date  # noqa: F401
from .hashing import raw_row_hash, surrogate_id, transaction_hash  # noqa: F401
from .splits import parse_split_items, parse_splits, split_total  # noqa: F401
from .text import (enum_name_default, escape_like, from_base64, html_escape,  # noqa: F401
                   institution_display_name, is_header_like, is_safe_for_display, mask_url,
                   normalize_category, normalize_person, pattern_suggestions, pattern_words,
                   py_strip, reason_default, sanitize_filename, sanitize_text,
                   suggested_pattern, to_base64)
