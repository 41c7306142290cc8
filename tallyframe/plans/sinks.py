"""Sinks and state changes (K1-K11) over Parquet table folders.

Plain Parquet has no MERGE, so every upsert is "new rows + old rows not
replaced (left_anti), written as a new version".  A run writes all its tables
from one staged outcome frame under ``<table>/run_id=<id>/attempt=<uuid>`` and
then publishes the attempt: a new file ``_manifest/<version>.json``, created only
if that version is absent, names run and attempt.  Nothing published is ever
touched again.  Readers take the newest named attempt of each run, so the tables
of a run appear together, a writer killed at any point leaves what readers saw
before, and a repeated run replaces its first attempt as a whole, with empty tables
too.  ``vacuum`` removes what no manifest names.  A run's own rows must be left out
of the history it is judged against (``read_table(..., without_run=...)``).

Rows that await a decision go to ``review_rows``; ``pending_rows`` are those that
no later run has stored or skipped, and a run takes them in again (``reenter``).
Files and logs are dimensions with a row per run that says something new about
them; ``read_latest`` gives the newest row of each.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import raw_row_hash, surrogate_id
from ..functions.text import institution_display_name
from ..operators.balances import explode_splits, first_per_key
from ..operators.outcomes import new_rules, run_counters, with_enum_ids
from ..operators.statements import raw_json
from ..schemas import DEFAULTS, TABLES
from ..session import stage


#: Tables that a run writes.
RUN_TABLES = ("transactions", "transaction_splits", "skipped_transactions", "processing_logs", "transaction_enums",
              "institutions", "processed_files", "bad_files", "categories", "review_rows")

#: Columns of outcomes that a run's tables are made of, besides those of ``review_rows``.
_WRITTEN = {"outcome", "position", "reentered", "used_enum_id", "existing_enum_id", "new_enum_name", "new_pattern", "final_category",
            "transaction_category", "final_reason", "skip_reason", "split_status", "splits", *TABLES["review_rows"].fieldNames()}
#: Outcomes whose raw row a table keeps.
_RAW_KEPT = ("invalid", "skipped", "needs_review")

#: Rows of a new file come after those of every published run.
NEWEST = (1 << 63) - 1
_MANIFEST = "version long, run_id string, attempt string, complete boolean"


def _attempt_path(root: str, table: str, run_id: str, attempt: str) -> str:
    return os.path.join(root, table, f"run_id={run_id}", f"attempt={attempt}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add missing columns (with defaults) and cast the rest, in the
    schema's column order.  Non-destructive: no table is dropped."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def transactions_rows(outcomes: DataFrame, institution_id: int | None = None) -> DataFrame:
    """K5 (transactions): processed rows shaped as the transactions table."""
    p = outcomes.filter(F.col("outcome") == "processed")
    splits = F.transform("splits", lambda s: F.struct(s["person"].alias("person"),
                                                      s["percentage"].alias("percentage")))
    rows = p.select(
        "transaction_hash",
        F.lit(institution_id).cast("long").alias("institution_id"),
        surrogate_id(F.col("path")).alias("processed_file_id"),
        "transaction_date", "description", "debit_amount", "credit_amount", "balance", "reference_number",
        "transaction_type", F.coalesce("currency", F.lit("INR")).alias("currency"),
        F.col("used_enum_id").cast("long").alias("enum_id"),
        F.col("final_category").alias("category"), "transaction_category",
        F.col("final_reason").alias("reason"),
        F.when(F.col("split_status") == "ok", splits).alias("splits"),
        (F.col("split_status") == "ok").alias("has_splits"),
        F.lit(False).alias("is_settled"))
    return conform(rows, TABLES["transactions"])


def skipped_rows(outcomes: DataFrame, institution_id: int | None = None) -> DataFrame:
    """K6: invalid and decided-skip rows with their raw data; invalid rows
    are keyed by (path, sheet_row, raw) so re-imports are idempotent (D8);
    the first copy of a hash wins (D6).  The rows are staged before, as the copies are
    found by a second look at them."""
    s = outcomes.filter(F.col("outcome").isin("invalid", "skipped"))
    key = F.when(F.col("outcome") == "invalid", raw_row_hash(raw_json(), F.col("path"), F.col("sheet_row"))
                 ).otherwise(F.col("transaction_hash"))
    rows = s.select(key.alias("transaction_hash"), F.lit(institution_id).cast("long").alias("institution_id"),
                    surrogate_id(F.col("path")).alias("processed_file_id"), raw_json().alias("raw_data"),
                    F.col("row_number").cast("long").alias("row_number"), "skip_reason", "position")
    rows = first_per_key(stage(rows, "skipped"), "transaction_hash", ["position"])
    return conform(rows, TABLES["skipped_transactions"])


def log_rows(outcomes: DataFrame, seconds: float | None = None) -> DataFrame:
    """K7: one processing-log row per file from the run counters."""
    c = run_counters(outcomes)
    rows = c.select(surrogate_id(F.col("path")).alias("processed_file_id"), "total_transactions",
                    "processed_transactions", "skipped_transactions", "duplicate_transactions",
                    F.col("auto_skipped_transactions").alias("duplicate_skipped"),
                    F.lit(seconds).cast("double").alias("processing_time"))
    return conform(rows, TABLES["processing_logs"])


# ---- rows that await a decision ---------------------------------------------

def review_rows(outcomes: DataFrame) -> DataFrame:
    """Undecided rows of this run's own files, with what a later run needs of them."""
    rows = outcomes.filter(F.col("outcome") == "needs_review")
    if "reentered" in rows.columns:  # those are in the table already
        rows = rows.filter(~F.col("reentered")).withColumn("file_position", F.col("position.at"))
    else:
        rows = rows.withColumn("file_position", F.col("position").cast("long"))
    return conform(rows, TABLES["review_rows"])


def pending_rows(spark: SparkSession, root: str, without_run: str | None = None) -> DataFrame:
    """Rows under review that no run has stored or skipped since, shaped as cleaned
    statement rows, with the version of their own run as ``batch_version``."""
    rows = read_table(spark, root, "review_rows", without_run, versions=True)
    for table in ("transactions", "skipped_transactions"):
        done = read_table(spark, root, table, without_run).select("transaction_hash")
        rows = rows.join(done, "transaction_hash", "left_anti")
    return rows.withColumnRenamed("run_version", "batch_version").withColumn("is_valid", F.lit(True)).drop("run_id")


def reenter(cleaned: DataFrame, pending: DataFrame) -> DataFrame:
    """New cleaned rows and pending ones as one batch: pending rows come first, in the
    order of their runs, and are judged by the rules that their own run had
    (``batch_version``)."""
    new = cleaned.withColumns({"batch_version": F.lit(NEWEST), "reentered": F.lit(False),
                               "position": F.struct(F.lit(NEWEST).alias("run"), F.col("position").cast("long").alias("at"))})
    old = pending.withColumns({"reentered": F.lit(True),
                               "position": F.struct(F.col("batch_version").alias("run"), F.col("file_position").alias("at"))}).drop("file_position")
    return new.unionByName(old, allowMissingColumns=True)


def revised_logs(outcomes: DataFrame, logs: DataFrame) -> DataFrame:
    """K7 for files of earlier runs whose pending rows were decided: their newest log
    with these rows counted anew."""
    decided = outcomes.filter(F.col("reentered") & (F.col("outcome") != "needs_review"))
    more = log_rows(decided).drop("total_transactions", "processing_time")
    counts = [c for c in more.columns if c != "processed_file_id"]
    more = more.select("processed_file_id", *[F.col(c).alias(f"_{c}") for c in counts])
    both = logs.join(more, "processed_file_id")
    return conform(both.select("processed_file_id", "total_transactions", "processing_time",
                               *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in counts]), TABLES["processing_logs"])


def log_status(logs: DataFrame) -> DataFrame:
    """A4 from a log: (processed_file_id, processing_status)."""
    done = F.col("processed_transactions") + F.col("skipped_transactions") == F.col("total_transactions")
    return logs.select("processed_file_id", F.when(done, F.lit("completed")).otherwise(F.lit("partially_processed")).alias("processing_status"))


def stage_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the columns that a run's tables are made of, staged; the raw row
    only where a table keeps it."""
    raw = F.col("outcome").isin(*_RAW_KEPT)
    return stage(outcomes.select(*[F.when(raw, F.col(c)).alias(c) if c in ("keys", "cells") else c for c in outcomes.columns if c in _WRITTEN]), "outcomes")


def write_run(outcomes: DataFrame, root: str, run_id: str, institution_id: int | None = None,
              rules: DataFrame | None = None, processor: str | None = None, started: float | None = None,
              others: dict[str, DataFrame] | None = None, staged: DataFrame | None = None) -> dict:
    """K4-K7: stage the outcome once (``staged``: the caller did, by ``stage_outcomes``), then write transactions, their split rows,
    skipped rows, rows under review, the log and - given the ``rules`` that the run
    matched against - the rules it learned, and publish them together with
    ``others``, by table.

    Where pending rows were taken in again, the logs and the status of their files
    are brought up to date (K3).

    ``started``: when the run began (``time.time()``); the log then has the seconds."""
    spark = outcomes.sparkSession
    attempt = "a" + uuid.uuid4().hex
    staged = staged if staged is not None else stage_outcomes(outcomes)
    others = dict(others or {})

    def put(df: DataFrame, table: str) -> str:
        path = _attempt_path(root, table, run_id, attempt)
        df.write.mode("overwrite").parquet(path)
        return path

    if rules is not None:
        learned = spark.read.parquet(put(conform(new_rules(staged, rules, processor), TABLES["transaction_enums"]), "transaction_enums"))
        staged = with_enum_ids(staged, learned)
    tx = spark.read.parquet(put(transactions_rows(staged, institution_id), "transactions"))
    put(explode_splits(tx), "transaction_splits")
    # Rows that are on record stay as they are
    on_record = read_table(spark, root, "skipped_transactions", run_id).select("transaction_hash")
    put(skipped_rows(staged, institution_id).join(on_record, "transaction_hash", "left_anti").select(*TABLES["skipped_transactions"].fieldNames()), "skipped_transactions")
    put(review_rows(staged), "review_rows")
    logs = log_rows(staged.filter(~F.col("reentered")) if "reentered" in staged.columns else staged, time.time() - started if started else None)
    if "reentered" in staged.columns:
        revised = stage(revised_logs(staged, read_latest(spark, root, "processing_logs", "processed_file_id", run_id)), "revised")
        files = read_latest(spark, root, "processed_files", "processed_file_id", run_id)
        files = update_status(files.join(revised, "processed_file_id", "left_semi"), log_status(revised))
        mine = conform(files, TABLES["processed_files"])
        others["processed_files"] = others["processed_files"].unionByName(mine) if "processed_files" in others else mine
        logs = logs.unionByName(revised)
    for table, rows in others.items():
        put(rows, table)
    put(logs, "processing_logs")
    publish(spark, root, run_id, attempt)
    return {t: os.path.join(root, t) for t in RUN_TABLES}


# ---- the manifest -------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by Hadoop's API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def publish(spark: SparkSession, root: str, run_id: str, attempt: str) -> int:
    """Name an attempt in the next free version of the manifest; returns the version.
    The file is created only if it is absent: of two writers one takes the next."""
    folder = os.path.join(root, "_manifest")
    while True:
        version = 1 + max((int(n.split(".")[0]) for n in _names(spark, folder) if n.endswith(".json")), default=0)
        fs, at = _folder(spark, os.path.join(folder, f"{version:012d}.json"))
        try:
            out = fs.create(at, False)
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in exc.java_exception.getClass().getName() or "already exists" in str(exc.java_exception.getMessage()):
                continue
            raise
        # one line, read only when whole: a writer killed before close publishes nothing
        out.write(json.dumps({"version": version, "run_id": run_id, "attempt": attempt, "complete": True}).encode())
        out.close()
        return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, attempt, run_version): the newest attempt of every run."""
    if not _names(spark, os.path.join(root, "_manifest")):
        return spark.createDataFrame([], "run_id string, attempt string, run_version long")
    lines = spark.read.schema(_MANIFEST).option("mode", "DROPMALFORMED").json(os.path.join(root, "_manifest"))
    return (lines.filter("complete").groupBy("run_id")
            .agg(F.max_by("attempt", "version").alias("attempt"), F.max("version").alias("run_version")))


def vacuum(spark: SparkSession, root: str, keep_seconds: float = 7 * 86400) -> list[str]:
    """Remove attempts that the manifest does not name (broken or replaced ones) and
    that were last written more than ``keep_seconds`` ago; returns their paths."""
    named = {(r["run_id"], r["attempt"]) for r in published(spark, root).collect()}  # a row per run
    gone = []
    for table in RUN_TABLES:
        for run in _names(spark, os.path.join(root, table)):
            for attempt in _names(spark, os.path.join(root, table, run)):
                key = (run.partition("=")[2], attempt.partition("=")[2])
                path = os.path.join(root, table, run, attempt)
                fs, at = _folder(spark, path)
                if attempt.startswith("attempt=") and key not in named and fs.getFileStatus(at).getModificationTime() < 1000 * (time.time() - keep_seconds):
                    fs.delete(at, True)
                    gone.append(path)
    return gone


def read_table(spark: SparkSession, root: str, table: str, without_run: str | None = None, versions: bool = False) -> DataFrame:
    """The rows of a table; of a table that runs write, those of the published
    attempts, but for the run ``without_run``, with ``versions`` also the
    ``run_version`` that published them.  A run table that no run has written is
    empty; any other table that is not there is an error."""
    path = os.path.join(root, table)
    rows = None
    if table not in RUN_TABLES or _names(spark, path):
        try:
            rows = spark.read.parquet(path)
        except AnalysisException as exc:
            # folders without a data file: an attempt broken off at its start
            if table not in RUN_TABLES or exc.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    if rows is None:
        rows = spark.createDataFrame([], TABLES.get(table) or _OTHER_TABLES[table]).withColumn("run_id", F.lit(None).cast("string"))
        return rows.withColumn("run_version", F.lit(None).cast("long")) if versions else rows
    if "attempt" not in rows.columns:
        return rows
    runs = published(spark, root)
    if without_run is not None:
        runs = runs.filter(F.col("run_id") != without_run)
    if versions:
        return rows.join(runs, ["run_id", "attempt"]).drop("attempt")
    return rows.join(runs, ["run_id", "attempt"], "left_semi").drop("attempt")


#: Run tables whose schema is not among the stored ones.
_OTHER_TABLES = {"bad_files": "path string, error string", "categories": "pos int, name string"}


def read_latest(spark: SparkSession, root: str, table: str, key: str, without_run: str | None = None) -> DataFrame:
    """The newest published row of every ``key``, by a hash aggregate."""
    rows = read_table(spark, root, table, without_run, versions=True)
    others = [c for c in rows.columns if c not in (key, "run_version")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), "run_version").alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def institution_row(spark: SparkSession, processor: str, institution_type: str = "bank") -> DataFrame:
    """K1: the institution of a processor, keyed by (name, type)."""
    df = spark.range(1).select(F.lit(processor).alias("processor"))
    name = institution_display_name(F.col("processor"))
    return df.select(surrogate_id(name, F.lit(institution_type)).alias("institution_id"), name.alias("name"),
                     F.lit(institution_type).alias("institution_type"),
                     F.current_timestamp().alias("created_at"))


def get_or_create(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K1/K2: rows of ``new`` whose key is not yet present (append these)."""
    return new.join(existing.select(*key), key, "left_anti")


def update_status(files: DataFrame, updates: DataFrame) -> DataFrame:
    """K3: new processing_status for the listed file ids; ids not present
    are ignored (no-op)."""
    u = updates.select("processed_file_id", F.col("processing_status").alias("_new"))
    return (files.join(u, "processed_file_id", "left")
            .withColumn("processing_status", F.coalesce("_new", "processing_status"))
            .withColumn("updated_at", F.when(F.col("_new").isNotNull(), F.current_timestamp())
                        .otherwise(F.col("updated_at")))
            .drop("_new"))


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """K4: rules keyed by (enum_name, processor_type); a change replaces
    patterns and category and keeps the existing id."""
    key = ["enum_name", "processor_type"]
    old_ids = rules.select(*key, F.col("id").alias("_old_id"))
    changed = (changes.join(old_ids, key, "left")
               .withColumn("id", F.coalesce("_old_id", "id")).drop("_old_id"))
    kept = rules.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changed.select(*rules.columns))


def settle_splits(splits: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8: apply ``(split_id, is_settled)`` settlements.  Returns the updated
    splits and the settlement ids that matched no split (the 'False'
    answers of the reference)."""
    s = settlements.select("split_id", F.col("is_settled").alias("_new"))
    updated = (splits.join(s, "split_id", "left")
               .withColumn("is_settled", F.coalesce("_new", "is_settled")).drop("_new"))
    unmatched = s.join(splits.select("split_id"), "split_id", "left_anti").select("split_id")
    return updated, unmatched


# ---- K10: snapshots ---------------------------------------------------------

def snapshot_id(now: datetime | None = None) -> str:
    """Snapshot name in ``yyyy-MM-dd_HH-mm-ss`` (UTC), with microseconds and a
    random part, so that two in one second differ."""
    return (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d_%H-%M-%S.%f_") + uuid.uuid4().hex[:6]


def create_snapshot(spark: SparkSession, root: str, tables: list[str], sid: str | None = None,
                    reason: str = "manual") -> str:
    """Copy the current tables to ``<root>/_snapshots/snapshot_id=<sid>/<table>``
    and append an audit row.  Writes are distributed (no driver copy)."""
    sid = sid or snapshot_id()
    for t in tables:
        read_table(spark, root, t).write.mode("overwrite").parquet(
            os.path.join(root, "_snapshots", f"snapshot_id={sid}", t))
    audit = spark.createDataFrame([(sid, "create", reason)], "snapshot_id string, action string, reason string")
    audit.withColumn("at", F.current_timestamp()).write.mode("append").parquet(os.path.join(root, "_snapshot_log"))
    return sid


def snapshot_history(spark: SparkSession, root: str) -> DataFrame:
    """Snapshot ids, newest first."""
    log = spark.read.parquet(os.path.join(root, "_snapshot_log"))
    return log.filter(F.col("action") == "create").select("snapshot_id").distinct().orderBy(F.desc("snapshot_id"))


def restore_snapshot(spark: SparkSession, root: str, tables: list[str], sid: str | None = None,
                     target: str | None = None) -> str:
    """Restore the latest (or the named) snapshot into ``target`` (a new
    version folder; the current state is snapshotted first)."""
    if sid is None:
        log = snapshot_history(spark, root)
        sid = log.filter(~F.col("snapshot_id").endswith("_before_restore")).first()[0]
    create_snapshot(spark, root, tables, sid=snapshot_id() + "_before_restore", reason=f"before restore of {sid}")
    target = target or os.path.join(root, f"_restored_{sid}")
    for t in tables:
        spark.read.parquet(os.path.join(root, "_snapshots", f"snapshot_id={sid}", t)).write.mode(
            "overwrite").parquet(os.path.join(target, t))
    audit = spark.createDataFrame([(sid, "restore", target)], "snapshot_id string, action string, reason string")
    audit.withColumn("at", F.current_timestamp()).write.mode("append").parquet(os.path.join(root, "_snapshot_log"))
    return target
