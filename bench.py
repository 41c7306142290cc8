"""Benchmark: one full ingest run over the derived statements, then the
shared-expense queries over the stored tables.

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="tf-bench-")

    from pyspark.sql import functions as F

    from tallyframe.functions.currency import detect_currency
    from tallyframe.functions.text import pattern_suggestions, sanitize_text
    from tallyframe.operators import balances
    from tallyframe.operators.rules import match_rules
    from tallyframe.plans import derived, ingest, sinks
    from tallyframe.plans.registry import QUERIES
    from tallyframe.session import get_session
    from tallyframe.sources.derived import PROCESSOR, derived_rules
    from tallyframe.sources.tables import read_table

    spark = get_session(f"local[{cpus}]", app_name="tallyframe-bench", shuffle_partitions=max(8, cpus),
                        extra={"spark.driver.memory": "16g",
                               "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
                               "spark.local.dir": os.path.join(scratch, "local")})
    person = "Supplier#000000001"
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # 1. E1 ingest: clean -> outcomes -> transactions/splits/skipped/log tables
    root = os.path.join(scratch, "store")
    kept = {}

    def ingest_run():
        kept["batch"] = derived.cleaned(spark, sf_dir)
        out = ingest.run(spark, sf_dir, batch=kept["batch"])
        sinks.write_run(out, root, "run-1", rules=derived_rules(spark), processor=PROCESSOR)
        kept["rows"] = spark.read.parquet(os.path.join(root, "processing_logs")).agg(
            F.sum("total_transactions")).first()[0]

    timed("ingest_e1", ingest_run)

    # 2. stored state for the loader queries: all statements + line-item splits
    tables = os.path.join(scratch, "tables")

    def load():
        t = derived.transactions(spark, sf_dir, kept["batch"])
        t.write.parquet(os.path.join(tables, "transactions"))
        t = spark.read.parquet(os.path.join(tables, "transactions"))
        derived.splits(spark, sf_dir, t).write.parquet(os.path.join(tables, "transaction_splits"))

    timed("load_tables", load)
    tx = spark.read.parquet(os.path.join(tables, "transactions"))
    sp = spark.read.parquet(os.path.join(tables, "transaction_splits"))

    # 3. queries
    timed("unsettled_by_person", lambda: balances.unsettled_by_person(sp).collect())
    timed("unsettled_by_person_currency", lambda: balances.unsettled_by_person(sp, by_currency=True).collect())
    timed("unsettled_transactions", lambda: balances.unsettled_transactions(tx, sp, person).collect())
    timed("person_history", lambda: balances.person_transactions(tx, sp, person, "1996-01-01", "1998-12-31").collect())
    timed("person_total", lambda: balances.person_total(tx, sp, person, "1996-01-01", "1998-12-31").collect())
    timed("transactions_by_currency", lambda: balances.by_currency(tx).collect())
    timed("recent_debits_top100", lambda: balances.recent_transactions(tx, 100, "debit").collect())
    timed("rule_match", lambda: noop(match_rules(tx, derived_rules(spark), PROCESSOR)))
    docs = read_table(spark, sf_dir, "documents")
    timed("rule_match_many_documents", lambda: noop(QUERIES["rule_match_many"](spark, sf_dir)))  # a rule per long benchmark word
    timed("document_currency", lambda: noop(docs.select(
        "doc_id", detect_currency(F.col("text"), ["USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD",
                                                  "CHF", "SGD"]))))
    timed("document_pattern_suggestions", lambda: noop(docs.select("doc_id", pattern_suggestions(F.col("text")))))
    pages = read_table(spark, sf_dir, "pages")
    timed("page_sanitize", lambda: noop(pages.select("page_id", F.sha2(sanitize_text(F.col("html")), 256))))

    total = round(sum(times.values()), 3)
    rows = kept.get("rows") or 0
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "ingest_rows": rows,
        "ingest_rows_per_sec": round(rows / times["ingest_e1"], 1) if times["ingest_e1"] else None,
        "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
