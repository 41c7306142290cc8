"""Split specs ``name:pct,name:pct``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_col
from .amounts import py_float
from .text import py_strip, py_strip_column


def parse_split_items(spec) -> Column:
    """The well-formed pieces of a split spec, in order.

    A piece is kept when it has exactly one ``:``, a Python-parsable
    percentage and 0 < pct <= 100 (NaN is rejected, D10)."""
    pieces = F.split(as_col(spec), ",", -1)
    parts = F.transform(pieces, lambda p: F.split(py_strip_column(p), ":", -1))
    items = F.transform(
        parts,
        lambda a: F.struct(
            py_strip_column(F.get(a, 0)).alias("person"),
            F.when(F.size(a) == 2, py_float(F.get(a, 1))).alias("percentage"),
        ),
    )
    return F.filter(
        items,
        lambda s: s["percentage"].isNotNull() & ~F.isnan(s["percentage"])
        & (s["percentage"] > 0.0) & (s["percentage"] <= 100.0),
    )


def split_total(items) -> Column:
    """Sum of the percentages of a parsed split array."""
    return F.aggregate(as_col(items), F.lit(0.0), lambda acc, s: acc + s["percentage"])


def _split_status(s: Column, items: Column, total: Column) -> Column:
    return (
        F.when(F.length(s) == 0, F.lit("none"))
        .when((F.size(items) == 0) | (total > 100.0), F.lit("rejected"))
        .otherwise(F.lit("ok"))
    )


def with_splits(df: DataFrame, spec: str) -> DataFrame:
    """F15 as the columns ``split_status`` and ``splits``; the pieces are parsed once
    a row, where ``parse_splits`` repeats them in every field."""
    out = df.withColumn("_spec", py_strip_column(F.coalesce(F.col(spec), F.lit(""))))
    out = out.withColumn("_items", F.when(F.length("_spec") > 0, parse_split_items("_spec")))
    out = out.withColumn("split_status", _split_status(F.col("_spec"), F.col("_items"), split_total("_items")))
    return out.withColumn("splits", F.when(F.col("split_status") == "ok", F.col("_items"))).drop("_spec", "_items")


def parse_splits(spec) -> Column:
    """struct(status, splits, own_share).

    status: ``none`` (blank spec), ``rejected`` (total > 100 or nothing
    usable), ``ok``.  own_share = 100 - total for accepted specs."""
    s = py_strip(F.coalesce(as_col(spec), F.lit("")))
    items = parse_split_items(s)
    total = split_total(items)
    status = _split_status(s, items, total)
    return F.struct(
        status.alias("status"),
        F.when(status == "ok", items).alias("splits"),
        F.when(status == "ok", F.lit(100.0) - total).alias("own_share"),
    )
