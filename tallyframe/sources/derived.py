"""Bank-statement inputs derived from the driver's TPC-H-like tables.

No bank data is supplied, so statement workbooks are derived from
``orders ⋈ customer ⋈ nation``: one statement file per nation plus a replay
file that repeats every tenth order (within-batch duplicates).  Every row
is produced by Spark from the tables, so the work grows with them.

The same derivation is written in DuckDB SQL in ``tallyframe.plans.oracle``;
keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRANSACTION_ENUMS
from .tables import read_table

# ---- fixed values of the derivation ----------------------------------------
HEADER_CELLS = [None, "S No.", "Transaction Date", "Transaction Remarks",
                "Withdrawal Amount (INR )", "Deposit Amount (INR )", "Balance (INR )"]
TRAILER_ROW = 2_000_000_000
REPLAY_PATH = "statements/replay.csv"
PROCESSOR = "icici_bank"
PROCESSOR_CURRENCIES = ["INR", "USD", "EUR", "GBP"]
# Rules: (id, enum_name, patterns, category, processor_type, is_active).
# Overlapping on purpose so that id order decides the winner.
DERIVED_RULES = [
    (1, "furniture_shop", ["furniture"], "shopping", "icici_bank", True),
    (2, "machines", ["machin", "nation_1"], "utilities", "icici_bank", True),
    (3, "cars", ["automobile", "-urgent"], "transport", "icici_bank", True),
    (4, "household_off", ["household"], "other", "icici_bank", False),
    (5, "other_bank_rule", ["building"], "shopping", "hdfc_bank", True),
    (6, "usd_payments", [" usd"], "transfer", "icici_bank", True),
    # Never matches; decisions name it for new patterns, which then reuse it.
    (7, "france_spend", ["never-printed"], "transfer", "icici_bank", False),
]
# ---------------------------------------------------------------------------


def dec2_text(c: Column) -> Column:
    """Amount text with exactly two decimals (no grouping)."""
    return c.cast("decimal(14,2)").cast("string")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide raw rows: path, sheet_row and the six statement fields as text."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                            "c_mktsegment")
    # nation has 25 rows by definition of the schema: a fixed-size broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("o_orderkey")
    date_txt = (
        F.when(k % 97 == 0, F.lit("N/A"))
        .when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    )
    suffix = F.when(k % 13 == 0, F.lit(" USD")).when(k % 17 == 0, F.lit(" <b>EUR & co</b>")).otherwise(F.lit(""))
    remarks = (
        F.when(k % 89 == 0, F.lit("Opening Balance b/f"))
        .when(k % 83 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("UPI-"), F.col("c_mktsegment"), F.lit("-"), F.col("n_name"), F.lit("-"),
                            F.col("o_orderpriority"), suffix))
    )
    status = F.col("o_orderstatus")
    # Every 53rd settled order is a reversal printed with a minus sign: it
    # parses as a float (kept) but is not a valid amount, so the row is a
    # credit without a credit amount (unrenderable).
    # Others are printed with a no-break space, an underscore or full-width digits,
    # which Python's float() reads.
    price = dec2_text(F.col("o_totalprice"))
    withdrawal = (F.when((status == "F") & (k % 53 == 0), F.concat(F.lit("-"), price))
                  .when((status == "F") & (k % 59 == 0), F.concat(F.lit("\u00a0"), price))
                  .when((status == "F") & (k % 61 == 0), F.regexp_replace(price, r"(\d)(\d{3}\.)", "$1_$2"))
                  .when((status == "F") & (k % 67 == 0), F.translate(price, "0123456789", "０１２３４５６７８９"))
                  .when(status == "F", dec2_text(F.col("o_totalprice")))
                  .when(status == "P", F.format_number("o_totalprice", 2)))
    deposit = F.when(status == "O", dec2_text(F.col("o_totalprice")))
    rows = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("statements/"), F.lower("n_name"), F.lit(".csv")).alias("path"),
            (k + 2).alias("sheet_row"),
            k.cast("string").alias("s_no"),
            date_txt.alias("txn_date"),
            remarks.alias("remarks"),
            withdrawal.alias("withdrawal"),
            deposit.alias("deposit"),
            dec2_text(F.col("c_acctbal")).alias("balance"),
        )
    )
    # every tenth order comes in the replay file as well
    paths = F.when(F.col("s_no").cast("long") % 10 == 0, F.array("path", F.lit(REPLAY_PATH))).otherwise(F.array("path"))
    return rows.select(F.explode(paths).alias("path"), *[c for c in rows.columns if c != "path"])


def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement files as ``(path, sheet_row, cells)``: a title row, the
    header row, the data rows and a trailer per file."""
    data = statement_rows(spark, sf_dir).select(
        "path", "sheet_row",
        F.array(F.lit(None).cast("string"), "s_no", "txn_date", "remarks", "withdrawal", "deposit",
                "balance").alias("cells"))
    files = (read_table(spark, sf_dir, "nation")
             .select(F.concat(F.lit("statements/"), F.lower("n_name"), F.lit(".csv")).alias("path"),
                     F.col("n_name").alias("title"))
             .unionByName(spark.range(1).select(F.lit(REPLAY_PATH).alias("path"),
                                                F.lit("REPLAY").alias("title"))))
    header = F.array(*[F.lit(h).cast("string") for h in HEADER_CELLS])
    frame = files.select(
        "path",
        F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("sheet_row"),
                     F.array(F.lit("Statement of account"), F.lit(None).cast("string"), F.col("title"))
                     .alias("cells")),
            F.struct(F.lit(1).cast("long").alias("sheet_row"), header.alias("cells")),
            F.struct(F.lit(TRAILER_ROW).cast("long").alias("sheet_row"),
                     F.array(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"),
                             F.lit("Legends Used in Account Statement")).alias("cells")),
        )).alias("r"),
    ).select("path", "r.sheet_row", "r.cells")
    return frame.unionByName(data)


def derived_rules(spark: SparkSession) -> DataFrame:
    """The rule dimension used with the derived statements."""
    return spark.createDataFrame(DERIVED_RULES, TRANSACTION_ENUMS)


def derived_decisions(typed: DataFrame, complete: bool = False) -> DataFrame:
    """Decisions table (the human answers) derived from the typed rows.

    One row per transaction hash; the answer depends only on the order key
    text, so every copy of a hash gets the same answer.  Some orders have no answer
    yet and some a reason that is too short; ``complete`` has proper answers for all."""
    ref = F.col("reference_number").cast("long")
    desc = F.col("description")
    per_hash = typed.groupBy("transaction_hash").agg(F.min("reference_number").alias("reference_number"),
                                                     F.min("description").alias("description"))
    action = (F.when(ref % 11 == 0, F.lit("skip"))
              .when(ref % 19 == 0, F.lit("new_pattern"))
              .otherwise(F.lit("process")))
    choice = (F.when(desc.contains("2-HIGH"), F.lit("2"))
              .when(desc.contains("3-MEDIUM"), F.lit("Travel"))
              .when(desc.contains("4-NOT"), F.lit("3"))
              .when(desc.contains("5-LOW"), F.lit("99"))
              .otherwise(F.lit("")))
    reason = F.when(ref % 5 == 0, F.lit("")).when(ref % 7 == 0, F.lit("okay" if complete else "ok")).otherwise(
        F.concat(F.lit("order "), F.col("reference_number")))
    pattern = F.lower(F.element_at(F.split(desc, "-"), 3))
    splits = (F.when(ref % 4 == 0, F.concat(pattern, F.lit(":50")))
              .when(ref % 4 == 1, F.concat(F.lit("alice:30, "), F.upper(pattern), F.lit(" :20")))
              .when(ref % 4 == 2, F.lit("alice:80,bob:40"))
              .otherwise(F.lit("")))
    # Every 23rd order has no answer yet: it goes to review.
    return per_hash.filter(F.lit(complete) | (ref % 23 != 0)).select(
        "transaction_hash",
        action.alias("action"),
        choice.alias("category_choice"),
        reason.alias("reason"),
        splits.alias("splits_spec"),
        pattern.alias("pattern"),
        F.when(ref % 2 == 0, F.concat(pattern, F.lit("_spend"))).otherwise(F.lit("")).alias("enum_name"),
        F.lit("shopping").alias("enum_category"),
        # asked where no text told the currency; the second is none of the processor's
        F.when(ref % 29 == 0, F.lit("gbp")).when(ref % 31 == 0, F.lit("JPY")).alias("currency"),
    )


def write_statement_csv(cells: DataFrame, folder: str) -> None:
    """Write statement cells as CSV files, one file per statement, rows in
    sheet order (used to exercise the file readers on derived data).  Each
    statement lands in ``<folder>/file_id=<name>/part-*.csv``."""
    width = 7
    padded = cells.select(
        F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("file_id"), "sheet_row",
        *[F.try_element_at(F.col("cells"), F.lit(i + 1)).alias(f"c{i}") for i in range(width)])
    (padded.repartition("file_id").sortWithinPartitions("file_id", "sheet_row").drop("sheet_row")
     .write.partitionBy("file_id").option("header", "false").csv(folder))
