"""Category discovery and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_category
from .numbering import dense_number


def discovered_categories(rules: DataFrame, transactions: DataFrame) -> DataFrame:
    """A6 + U1: distinct normalized categories of the rules and of the
    transactions' transaction_category (blank dropped)."""
    a = rules.select(normalize_category(F.col("category")).alias("name"))
    b = transactions.select(normalize_category(F.col("transaction_category")).alias("name"))
    return a.unionByName(b).filter(F.col("name").isNotNull()).distinct()


def merge_categories(template: DataFrame, found: DataFrame) -> DataFrame:
    """J7 + U2: template ``(pos, name)`` first in its order (its own
    duplicates kept), then found names absent from it (case-insensitive),
    sorted by name for determinism.  Output ``(pos, name)``."""
    known = template.select(F.lower("name").alias("_low")).distinct()
    new = (found.select("name").distinct()
           .join(known, F.lower(F.col("name")) == F.col("_low"), "left_anti"))
    n_template = template.agg(F.count(F.lit(1))).first()[0]  # one number: the template size
    ranked = dense_number(new.select("name"), ["name"], "pos", n_template)
    return template.select("pos", "name").unionByName(ranked.select(F.col("pos").cast("int").alias("pos"), "name"))


def add_category(current: DataFrame, template: DataFrame, name: str) -> DataFrame:
    """K9: lowercased+stripped ``name`` appended unless present; order is
    template, then existing custom ones, then the new one."""
    name = name.lower().strip()
    present = current.filter(F.lower("name") == name).limit(1).count() > 0
    if present:
        return current
    tnames = template.select(F.lower("name").alias("_low"))
    custom = current.join(tnames, F.lower(F.col("name")) == F.col("_low"), "left_anti").select("pos", "name")
    n_template = template.count()
    custom = dense_number(custom.withColumnRenamed("pos", "_pos"), ["_pos", "name"], "pos", n_template)
    n_custom = custom.count()
    spark = current.sparkSession
    extra = spark.createDataFrame([(n_template + n_custom + 1, name)], "pos int, name string")
    return template.select("pos", "name").unionByName(custom.select(F.col("pos").cast("int"), "name")).unionByName(extra)
