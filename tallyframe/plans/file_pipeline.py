"""The file pipeline - new statement files in a folder to stored tables.

institution (K1) -> new files (S1, K2) -> cells, with unreadable files set
aside (S2, S10) -> cleaning -> outcomes (E1) -> all tables of the run (K4-K7),
with the files' status (K3) and the categories that decisions named (K9).
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import surrogate_id
from ..operators.categories import discovered_categories, merge_categories
from ..operators.outcomes import ingest_outcomes, run_counters
from ..schemas import TABLES
from ..session import stage
from ..sources.statements import discover_files
from ..sources.tables import category_template
from . import sinks
from .adapters import get_adapter
from .layout import HISTORY, known_keys


def process_files(spark: SparkSession, folder: str, root: str, processor: str, rules: DataFrame, decide,
                  categories: Sequence[str], run_id: str, file_type: str | None = None, rules_at_once: bool = False, auto_match: bool = True) -> None:
    """Ingest every file of ``folder`` that no earlier run has finished, and the rows
    of earlier runs that still await a decision.

    ``decide(valid rows)`` gives the decisions table.  A row without a rule (with
    ``auto_match`` false: any row) and without an acceptable decision is kept under review; a later run that gets its decision
    stores it as its own run would have, and brings its file's status and log up to
    date.  A file that cannot be read gets the status ``failed`` and a row in
    ``bad_files``; the others go on.  Failed files are tried again by the next run.
    Repeating a run id replaces its rows."""
    start = time.time()
    adapter = get_adapter(processor)

    def history(table: str) -> DataFrame:
        return sinks.read_table(spark, root, table, without_run=run_id)

    institution = stage(sinks.institution_row(spark, processor), "institution")
    institution_id = institution.first()["institution_id"]
    new_institution = sinks.get_or_create(history("institutions"), institution, ["institution_id"])

    recorded = sinks.read_latest(spark, root, "processed_files", "processed_file_id", run_id)
    done = recorded.filter(F.col("processing_status") != "failed")
    files = stage(discover_files(spark, folder, file_type, processed=done), "files")
    learned = sinks.read_table(spark, root, "transaction_enums", run_id, versions=True)
    known = stage(with_learned(rules, learned), "known")  # of known size: rows that it is joined with need no shuffle
    if files.isEmpty():
        cells = spark.createDataFrame([], "path string, sheet_row long, cells array<string>")
        bad = spark.createDataFrame([], "path string, error string")
    else:
        cells, bad = adapter.extract(spark, files)
    cleaned = adapter.transform(cells)  # staged there
    batch = with_pending(cleaned, root, run_id)
    outcomes = sinks.stage_outcomes(ingest_outcomes(batch, *[known_keys(spark, root, table, batch, run_id) for table in HISTORY],
                                                    decide(batch.filter("is_valid")), known, processor, categories,
                                                    currencies=adapter.currencies, rules_at_once=rules_at_once, auto_match=auto_match))

    own = outcomes.filter(~F.col("reentered")) if "reentered" in outcomes.columns else outcomes
    status = (run_counters(own).select(F.col("path").alias("file_path"), "file_status")
              .unionByName(bad.select(F.col("path").alias("file_path"), F.lit("failed").alias("file_status"))))
    now = F.current_timestamp()
    created = recorded.select("processed_file_id", F.col("created_at").alias("_created"))
    records = files.join(status, "file_path", "left").withColumn("processed_file_id", surrogate_id(F.col("file_path")))
    records = records.join(created, "processed_file_id", "left").select(  # a failed file that is tried again keeps its record
        "processed_file_id", F.lit(institution_id).alias("institution_id"),
        "file_path", "file_name", "file_size", F.lit(processor).alias("processor_type"),
        F.coalesce("file_status", F.lit("completed")).alias("processing_status"),
        F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))
    found = merge_categories(category_template(spark, list(categories)),
                             discovered_categories(known, outcomes.filter(F.col("outcome") == "processed")))
    sinks.write_run(outcomes, root, run_id, institution_id, rules=known, processor=processor, started=start, staged=outcomes, others={
        "institutions": sinks.conform(new_institution, TABLES["institutions"]),
        "processed_files": sinks.conform(records, TABLES["processed_files"]),
        "bad_files": bad,
        "categories": found})


def with_learned(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """The given rules and those that runs learned, with the version of their run."""
    own = rules.withColumn("learned_version", F.lit(None).cast("long"))
    return own.unionByName(learned.select(*rules.columns, F.col("run_version").alias("learned_version")))


def with_pending(cleaned: DataFrame, root: str, run_id: str) -> DataFrame:
    """A run's cleaned rows and the rows of earlier runs under review, if any."""
    pending = stage(sinks.pending_rows(cleaned.sparkSession, root, run_id), "pending")
    return cleaned if pending.isEmpty() else stage(sinks.reenter(cleaned, pending), "batch")


def settle_reviews(spark: SparkSession, root: str, processor: str, rules: DataFrame, decide, categories: Sequence[str],
                   run_id: str, currencies: Sequence[str] = (), auto_match: bool = True) -> None:
    """A run over the rows under review alone, for decisions that came without new files."""
    def history(table: str) -> DataFrame:
        return sinks.read_table(spark, root, table, without_run=run_id)

    start = time.time()
    known = stage(with_learned(rules, sinks.read_table(spark, root, "transaction_enums", run_id, versions=True)), "known")
    pending = stage(sinks.pending_rows(spark, root, run_id), "pending")
    nothing = pending.withColumn("position", F.col("file_position")).drop("batch_version", "file_position").limit(0)
    batch = stage(sinks.reenter(nothing, pending), "batch")
    outcomes = sinks.stage_outcomes(ingest_outcomes(batch, history("transactions"), history("skipped_transactions"), decide(batch), known,
                                                    processor, categories, currencies=currencies, auto_match=auto_match))
    sinks.write_run(outcomes, root, run_id, rules=known, processor=processor, started=start, staged=outcomes)
