"""Processor adapters by configured name.

An adapter is a pair of plain functions: ``extract`` (files -> cells,
bad files) and ``transform`` (cells -> typed statement rows); callers chain
them with ``DataFrame.transform``.  New processors register here instead of
through class-naming conventions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from ..functions.currency import normalize_currency_config
from ..operators.statements import clean_statements
from ..sources.statements import read_statement_cells


@dataclass(frozen=True)
class Adapter:
    extract: Callable
    transform: Callable[[DataFrame], DataFrame]
    file_type: str
    currencies: tuple[str, ...]


def make_adapter(currencies, file_type: str = "excel", lenient_amounts: bool = False) -> Adapter:
    cur = tuple(normalize_currency_config(currencies))
    return Adapter(extract=read_statement_cells, transform=partial(clean_statements, currencies=cur, lenient_amounts=lenient_amounts),
                   file_type=file_type, currencies=cur)


# processor name -> adapter (the configured processors)
ADAPTERS: dict[str, Adapter] = {
    "icici_bank": make_adapter("INR"),
}


def get_adapter(name: str) -> Adapter:
    try:
        return ADAPTERS[name]
    except KeyError:
        raise ValueError(f"no adapter registered for processor {name!r}") from None


def register_adapter(name: str, adapter: Adapter) -> None:
    ADAPTERS[name] = adapter
