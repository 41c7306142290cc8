"""Continuous ingest (ST1, ST2) and live balances (ST3).

ST1: new statement cell files (parquet ``path, sheet_row, cells``) arrive
in a folder; each micro-batch runs the same cleaning and outcome operators
as batch mode inside ``foreachBatch`` and appends the run's tables.

ST2: dedup state lives in the stored tables, not in streaming state: every
micro-batch anti-joins against all stored hashes, so the state does not
grow in executor memory and a restarted query picks it up from storage.
Re-delivered batches are idempotent: a batch leaves its own earlier rows out of
its history and publishes all its tables together.  A run id holds the query's own
id, so several streams - or one with a new checkpoint - share a store.

A file may arrive in several parts and batches.  With ``ends`` (a folder of parquet
rows ``path``: this file is complete) its cells are kept in ``_parts`` under the
store until its end mark comes; then it is read as a whole, header and row numbers
included.  Without it every part file must hold a whole statement.

Rows that await a decision go to the review table; every batch takes up those
whose decision has come (``decisions`` may be a function of the rows, which is
asked anew by every batch).

ST3: unsettled amount per person as a streaming aggregate over split rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.outcomes import ingest_outcomes
from ..operators.statements import clean_statements
from ..plans import sinks
from ..plans.file_pipeline import with_learned, with_pending
from ..plans.layout import HISTORY, known_keys
from ..schemas import CELLS, DECISIONS, TRANSACTION_SPLITS
from ..session import stage


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_ingest_stream(spark: SparkSession, inbox: str, root: str, checkpoint: str, rules: DataFrame,
                        decisions: DataFrame | Callable[[DataFrame], DataFrame] | None, processor: str, categories: Sequence[str],
                        currencies: Sequence[str] = ("INR",), available_now: bool = True, ends: str | None = None,
                        max_files: int | None = None) -> StreamingQuery:
    """ST1 + ST2: run E1 on every micro-batch of new cell files (at most ``max_files``)."""
    decide = decisions if callable(decisions) else lambda rows: decisions if decisions is not None else spark.createDataFrame([], DECISIONS)
    stream = spark.readStream.schema(CELLS)
    cells = (stream.option("maxFilesPerTrigger", max_files) if max_files else stream).parquet(inbox)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        run_id = f"stream-{query_id(s, checkpoint)}-{batch_id:08d}"

        if ends is not None:
            batch = _whole_files(s, batch, root, run_id, ends)
        learned = sinks.read_table(s, root, "transaction_enums", run_id, versions=True)
        known = with_learned(rules, learned)
        cleaned = with_pending(clean_statements(batch, currencies), root, run_id)
        out = ingest_outcomes(cleaned, *[known_keys(s, root, table, cleaned, run_id) for table in HISTORY], decide(cleaned.filter("is_valid")), known,
                              processor, categories, currencies=currencies)
        sinks.write_run(out, root, run_id, rules=known, processor=processor)

    writer = cells.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


_PARTS = "path string, sheet_row long, cells array<string>, run_id string"


def _whole_files(spark: SparkSession, batch: DataFrame, root: str, run_id: str, ends: str) -> DataFrame:
    """Keep the batch's cells; the cells of the files that have their end mark now and
    that no other run has taken.  A repeated batch replaces what it kept and takes
    the same files again."""
    parts, taken = f"{root}/_parts", f"{root}/_whole"
    batch.select("path", "sheet_row", "cells").write.mode("overwrite").parquet(f"{parts}/run_id={run_id}")
    before = stage(_known(spark, taken, "path string, run_id string").filter(F.col("run_id") != run_id).select("path"), "before")
    ready = stage(spark.read.schema("path string").parquet(ends).distinct().join(before, "path", "left_anti")
                  .join(spark.read.schema(_PARTS).parquet(parts).select("path").distinct(), "path", "left_semi"), "ready")
    ready.write.mode("overwrite").parquet(f"{taken}/run_id={run_id}")
    return spark.read.schema(_PARTS).parquet(parts).join(ready, "path", "left_semi").drop("run_id").distinct()


def _known(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder) if sinks.exists(spark, folder) else spark.createDataFrame([], schema)


def live_unsettled(spark: SparkSession, splits_dir: str, out: str, checkpoint: str) -> StreamingQuery:
    """ST3: unsettled amount and count per person, kept up to date as split rows
    arrive; every micro-batch writes the whole result as a new version of a table."""
    splits = spark.readStream.schema(TRANSACTION_SPLITS).parquet(splits_dir)
    agg = (splits.filter(F.col("is_settled") == F.lit(False)).groupBy("person_name")
           .agg(F.round(F.sum(F.col("amount").cast("decimal(38,6)")), 2).cast("double").alias("unsettled_amount"),
                F.count(F.lit(1)).alias("unsettled_count")))

    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (agg.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_live(spark: SparkSession, out: str) -> DataFrame:
    """The newest version that ``live_unsettled`` has written."""
    rows = spark.read.parquet(out)
    newest = rows.agg(F.max("version")).first()[0]  # one number, from the partition names
    return rows.filter(F.col("version") == newest).drop("version")
