"""Table scans (S11) and the category template."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

# ---- fixed values ----------------------------------------------------------
# Default category template, in order.
DEFAULT_CATEGORIES = ["income", "food", "transport", "shopping", "entertainment", "utilities",
                      "healthcare", "transfer", "investment", "other"]
# ---------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_path(root: str, name: str, prefix: str = "") -> str:
    """Location of a stored engine table; ``prefix`` isolates test tables."""
    return os.path.join(root, f"{prefix}{name}")


def read_store(spark: SparkSession, root: str, name: str, prefix: str = "") -> DataFrame:
    """Read a stored engine table; an absent table reads as empty with its
    fixed schema."""
    path = table_path(root, name, prefix)
    schema = TABLES[name]
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # noqa: BLE001 - absent path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def category_template(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Ordered category dimension ``(pos, name)``; ``pos`` is 1-based."""
    names = list(names) if names is not None else list(DEFAULT_CATEGORIES)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "pos int, name string")
