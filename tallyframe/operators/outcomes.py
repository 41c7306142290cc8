"""Per-row outcome of an ingest run, run counters and status (A3-A5).

Outcome precedence per row (reference order): invalid -> recorded skip;
hash already stored -> duplicate; hash previously skipped (and not
reprocessing) -> auto_skipped; credit row without a credit amount
(unrenderable) -> error_skipped, not recorded; decision skip -> skipped;
no rule and no decision -> needs_review; else processed.

Within one batch a later copy of a hash sees the first copy as stored:
first processed -> duplicate, first skipped -> auto_skipped.  Every input
of the outcome except validity is determined by the hash, so this needs
only the first position per hash - a partial aggregate - not a window over
a possibly huge group of copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.splits import with_splits
from ..session import stage
from . import rules as R

OUTCOMES = ["processed", "skipped", "invalid", "duplicate", "auto_skipped", "error_skipped", "needs_review"]


#: Position of the row that created a rule of this batch; null for older rules.
_BATCH = "_created"


def ingest_outcomes(batch: DataFrame, stored_hashes: DataFrame, skipped_hashes: DataFrame,
                    decisions: DataFrame, rules: DataFrame, processor: str,
                    categories: Sequence[str], reprocess_skipped: bool = False,
                    currencies: Sequence[str] = (), rules_at_once: bool = False, auto_match: bool = True) -> DataFrame:
    """One row per kept statement row with ``outcome`` and the fields the
    sinks write.  ``batch`` is the output of ``clean_statements``.

    P7: where no text told the currency and the decision names one of
    ``currencies`` (any code if none are given), the row takes that.

    Rules with a ``learned_version`` are seen only by rows of a later
    ``batch_version``: a row is judged by the rules of its own batch, whenever its
    answer comes.  ``rules_at_once`` (W3): a rule that a row of this batch creates
    is matched by the rows after it in the same batch, as if rows came one by one.
    ``auto_match``: a row that a rule matches needs no decision."""
    if "position" not in batch.columns:  # a frame that was not cleaned from files
        batch = batch.withColumn("position", F.struct("path", "sheet_row"))
    matched = seen_rules(R.match_rules(batch, rules, processor), rules)
    valid = matched.filter("is_valid")
    per_hash = valid.groupBy("transaction_hash").agg(F.min("position").alias("_first"))
    flags = (per_hash
             .join(stored_hashes.select("transaction_hash").distinct().withColumn("_in_tx", F.lit(True)),
                   "transaction_hash", "left")
             .join(skipped_hashes.select("transaction_hash").distinct().withColumn("_in_skipped", F.lit(True)),
                   "transaction_hash", "left")
             .join(decisions.withColumnRenamed("enum_name", "d_enum_name")
                   .withColumnRenamed("enum_category", "d_enum_category")
                   .withColumnRenamed("currency", "d_currency"), "transaction_hash", "left"))
    # invalid rows have no hash: they pass by the join instead of meeting in one task
    rows = valid.join(flags, "transaction_hash").unionByName(matched.filter(~F.col("is_valid")), allowMissingColumns=True)
    if "currency_known" in rows.columns:
        named = F.upper(R.py_strip(F.col("d_currency")))
        allowed = named.isin(*currencies) if currencies else F.length(named) == 3
        rows = rows.withColumn("currency", F.when(~F.col("currency_known") & allowed, named).otherwise(F.col("currency")))
    known = rules.select("id", "enum_name", "category", "processor_type").withColumn(_BATCH, F.lit(None).cast(rows.schema["position"].dataType))
    if rules_at_once:
        rows = stage(rows, "flagged")
        created = _rules_of_batch(rows, rules, known, processor, categories, reprocess_skipped, auto_match)
        rows = _see_created(rows, created, processor)
        known = stage(known.unionByName(created.select(*known.columns)), "known")  # its size is known: small ones are broadcast
    rows = _judged(rows, known, processor, categories, reprocess_skipped, auto_match)
    own, is_first = F.col("_own"), F.col("position") == F.col("_first")
    if rules_at_once:
        # a copy may be decided by a rule that came after an undecided first one; rows
        # are judged once, staged, and the settled copies read three columns of them
        rows = stage(rows, "judged")
        settled = (rows.filter(own.isin("processed", "skipped")).groupBy("transaction_hash").agg(F.min("position").alias("_settled")))
        rows = rows.join(settled, "transaction_hash", "left")
        is_first = F.coalesce(F.col("position") == F.col("_settled"), F.lit(False))
    outcome = (F.when(F.col("is_valid") & ~is_first & (own == "processed"), F.lit("duplicate"))
               .when(F.col("is_valid") & ~is_first & (own == "skipped") & F.lit(not reprocess_skipped),
                     F.lit("auto_skipped"))
               .otherwise(own))
    # ``outcome`` is its own projection so the reason below references it
    # instead of re-inlining the whole precedence chain.
    decided = rows.select("*", outcome.alias("outcome"), F.coalesce(is_first, F.lit(False)).alias("first_copy"))
    o = F.col("outcome")
    out = with_splits(decided.select(
        "*",
        F.when(o == "invalid", F.lit(R.INVALID_REASON)).when(o == "skipped", F.col("_skip_reason"))
        .alias("skip_reason"),
    ), "splits_spec")
    splits = ["split_status", "splits"]
    return out.select(
        *[c for c in out.columns if not c.startswith("_") and c not in splits],
        F.col("_new_enum_name").alias("new_enum_name"),
        F.col("_new_pattern").alias("new_pattern"),
        F.col("_existing_id").alias("existing_enum_id"),
        # the rule that the row uses: the match, unless a new pattern was asked for
        F.when(F.col("_matched"), F.col("enum_id")).otherwise(F.col("_existing_id")).alias("used_enum_id"),
        *splits,
    )


def seen_rules(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches by rules that a row's own batch did not have yet are no matches.  Rules
    are numbered as they come, so where the first match is too new all others are."""
    if "learned_version" not in rules.columns or "batch_version" not in matched.columns:
        return matched
    versions = rules.filter("learned_version is not null").select(F.col("id").alias("enum_id"), "learned_version")
    hidden = F.coalesce(F.col("learned_version") >= F.col("batch_version"), F.lit(False))
    both = matched.join(versions, "enum_id", "left")
    return both.select(*[F.when(~hidden, F.col(c)).alias(c) if c in R.MATCH else c for c in matched.columns])


def _judged(rows: DataFrame, known: DataFrame, processor: str, categories: Sequence[str], reprocess_skipped: bool,
            auto_match: bool = True) -> DataFrame:
    """Rows with their decision applied and ``_own``, what each would be alone."""
    rows = R.resolve_decisions(rows, categories, auto_match)
    rows = R.lookup_rule_ids(rows, known, processor)
    # a rule of this batch is there for the rows after the one that created it
    late = F.coalesce(F.col(_BATCH) >= F.col("position"), F.lit(False))
    rows = rows.withColumns({c: F.when(~late, F.col(c)) for c in ("_existing_id", "_existing_category")}).drop(_BATCH)
    rows = R.finish_decisions(rows, categories)
    in_tx = F.coalesce(F.col("_in_tx"), F.lit(False))
    in_sk = F.coalesce(F.col("_in_skipped"), F.lit(False)) & F.lit(not reprocess_skipped)
    unrenderable = (F.col("transaction_type") == "credit") & F.col("credit_amount").isNull()
    return rows.withColumn("_own", F.when(~F.col("is_valid"), F.lit("invalid"))
                           .when(in_tx, F.lit("duplicate"))
                           .when(in_sk, F.lit("auto_skipped"))
                           .when(unrenderable, F.lit("error_skipped"))
                           .otherwise(F.col("_decided")))


def _see_created(rows: DataFrame, created: DataFrame, processor: str) -> DataFrame:
    """Rows that no older rule matches take the first rule of this batch that does,
    if it was created before them.  Ids follow the order of creation, so the first
    match is also the earliest: where that one is too late there is no other."""
    older = {c: f"_older_{c}" for c in R.MATCH}
    hit = R.match_rules(rows.withColumnsRenamed(older), created, processor)
    hit = hit.join(created.select(F.col("id").alias("enum_id"), F.col(_BATCH)), "enum_id", "left")
    seen = F.coalesce(F.col(_BATCH) < F.col("position"), F.lit(False))
    if "reentered" in rows.columns:  # rows of earlier batches are judged by what those batches had
        seen = seen & ~F.col("reentered")
    matched = F.col(older["enum_id"]).isNotNull()
    return hit.select(*[F.when(matched, F.col(older[c])).when(seen, F.col(c)).alias(c) if c in older else c for c in rows.columns])


def _rules_of_batch(rows: DataFrame, rules: DataFrame, known: DataFrame, processor: str, categories: Sequence[str],
                    reprocess_skipped: bool, auto_match: bool) -> DataFrame:
    """The rules that the rows of the batch create one after the other, with the
    position of the row that created each.

    A fixpoint over the rules, not over the rows.  Each round takes the rules found
    so far as given, finds which rows would still create one, and keeps the earliest
    row of every name.  The earliest rule is right in the first round and each round
    makes the next one right at least, so the rounds end; they do when nothing
    changes, usually after two or three."""
    candidates = stage(rows.filter(F.col("is_valid") & (F.col("position") == F.col("_first")) & F.col("action").isNotNull()
                                   & F.col("_in_tx").isNull() & (F.lit(reprocess_skipped) | F.col("_in_skipped").isNull())).drop("cells", "keys"), "candidates")
    created = candidates.sparkSession.createDataFrame([], _created_schema(rules, candidates))
    while True:
        judged = _judged(_see_created(candidates, created, processor), known.unionByName(created.select(*known.columns)), processor, categories, reprocess_skipped, auto_match)
        makes = (judged.filter((F.col("_own") == "processed") & F.col("_new_enum_name").isNotNull() & F.col("_existing_id").isNull())
                 .groupBy(F.col("_new_enum_name").alias("enum_name"))
                 .agg(F.min_by(F.struct(F.col("_new_pattern").alias("pattern"), F.col("final_category").alias("category")), "position").alias("r"), F.min("position").alias(_BATCH))
                 .select("enum_name", F.array("r.pattern").alias("patterns"), F.col("r.category").alias("category"), _BATCH))
        found = stage(R.numbered_after(makes, rules, [_BATCH]).withColumns({"processor_type": F.lit(processor), "is_active": F.lit(True)}), "created")
        key = ["enum_name", "patterns", "category", _BATCH]
        same = found.select(*key).exceptAll(created.select(*key)).isEmpty() and created.select(*key).exceptAll(found.select(*key)).isEmpty()
        created = found
        if same:
            return created


def _created_schema(rules: DataFrame, rows: DataFrame) -> T.StructType:
    own = [rules.schema[c] for c in ("id", "enum_name", "patterns", "category", "processor_type", "is_active")]
    return T.StructType([*own, T.StructField(_BATCH, rows.schema["position"].dataType)])


def new_rules(outcomes: DataFrame, rules: DataFrame, processor: str) -> DataFrame:
    """K4 (create part): rules first defined by this batch's decisions, one
    per new enum name, with ids after the existing ones."""
    fresh = (outcomes.filter((F.col("outcome") == "processed") & F.col("new_enum_name").isNotNull()
                             & F.col("existing_enum_id").isNull())
             .groupBy(F.col("new_enum_name").alias("enum_name"))
             .agg(F.min_by(F.struct("new_pattern", "final_category"), "position").alias("_r"), F.min("position").alias("first_seen"))
             .select("enum_name", F.array(F.col("_r.new_pattern")).alias("patterns"),
                     F.col("_r.final_category").alias("category"), "first_seen"))
    with_ids = R.numbered_after(fresh, rules, ["first_seen", "enum_name"])
    return with_ids.select("id", "enum_name", "patterns", "category", F.lit(processor).alias("processor_type"),
                           F.lit(True).alias("is_active"))


def with_enum_ids(outcomes: DataFrame, created: DataFrame) -> DataFrame:
    """Final ``used_enum_id`` per row: the matched rule, or for a new pattern the
    existing rule of the same name or the rule that this batch created."""
    ids = created.select(F.col("enum_name").alias("new_enum_name"), F.col("id").alias("_created_id"))
    return (outcomes.join(ids, "new_enum_name", "left")
            .withColumn("used_enum_id", F.coalesce("used_enum_id", "_created_id"))
            .drop("_created_id"))


def run_counters(outcomes: DataFrame, key: str = "path") -> DataFrame:
    """A3-A5 per file: totals by outcome, run status, completion rate.

    total counts every kept row; skipped counts recorded skips, invalid rows
    and unrenderable rows (the reference counts all three as skipped)."""
    o = F.col("outcome")
    agg = outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(o == "processed").alias("processed_transactions"),
        F.count_if(o.isin("skipped", "invalid", "error_skipped")).alias("skipped_transactions"),
        F.count_if(o == "duplicate").alias("duplicate_transactions"),
        F.count_if(o == "auto_skipped").alias("auto_skipped_transactions"),
        F.count_if(o == "needs_review").alias("needs_review_transactions"),
    )
    done = F.col("processed_transactions") + F.col("skipped_transactions")
    status = F.when(done == F.col("total_transactions"), F.lit("completed")).otherwise(F.lit("partially_completed"))
    return agg.select(
        "*",
        status.alias("status"),
        F.when(status == "completed", F.lit("completed")).otherwise(F.lit("partially_processed")).alias("file_status"),
        F.when((status != "completed") & (F.col("total_transactions") > 0),
               F.round(done * 100.0 / F.col("total_transactions"), 2)).alias("completion_rate"),
    )
