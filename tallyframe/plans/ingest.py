"""A whole ingest run over the derived statements.

History (what earlier runs stored / skipped) is derived from the same
statements by date, so the run exercises duplicates and auto-skips:
stored = valid rows dated before 1996; skipped = valid rows of the first
half of 1996 with an even order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as OUT
from ..sources.derived import PROCESSOR, PROCESSOR_CURRENCIES, derived_decisions, derived_rules
from ..sources.tables import DEFAULT_CATEGORIES
from . import derived

STORED_BEFORE = "1996-01-01"
SKIPPED_UNTIL = "1996-07-01"


def history(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = batch.filter("is_valid")
    stored = valid.filter(F.col("transaction_date") < F.lit(STORED_BEFORE).cast("timestamp")).select(
        "transaction_hash")
    skipped = valid.filter((F.col("transaction_date") >= F.lit(STORED_BEFORE).cast("timestamp"))
                           & (F.col("transaction_date") < F.lit(SKIPPED_UNTIL).cast("timestamp"))
                           & (F.col("reference_number").cast("long") % 2 == 0)).select("transaction_hash")
    return stored, skipped


def run(spark: SparkSession, sf_dir: str, reprocess_skipped: bool = False,
        batch: DataFrame | None = None, stored: DataFrame | None = None, skipped: DataFrame | None = None,
        rules_at_once: bool = False) -> DataFrame:
    """Outcome of every kept statement row of the derived run (``batch``:
    an already cleaned, staged frame to reuse; ``stored`` and ``skipped``: rows of
    earlier runs besides the derived history)."""
    batch = batch if batch is not None else derived.cleaned(spark, sf_dir)
    past = history(batch)
    stored, skipped = (p if more is None else p.unionByName(more.select("transaction_hash"))
                       for p, more in zip(past, (stored, skipped)))
    decisions = derived_decisions(batch.filter("is_valid"))
    return OUT.ingest_outcomes(batch, stored, skipped, decisions, derived_rules(spark), PROCESSOR,
                               DEFAULT_CATEGORIES, reprocess_skipped, PROCESSOR_CURRENCIES, rules_at_once)
