"""Consecutive numbers in a global order without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def dense_number(df: DataFrame, order: Sequence[str], out: str, after: int = 0) -> DataFrame:
    """``df`` with ``out``: ``after`` + 1, ``after`` + 2, ... by the columns ``order``,
    which name a row.

    Rows are dealt into ranges of the order and staged with their range; a range's
    numbers begin after the rows of those before it (one count per range goes
    through the driver, as many as there are shuffle partitions), and a window
    inside each range does the rest.  No task sees more than its range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    before, offsets = after, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    first = spark.createDataFrame(offsets, "_range int, _before long")
    inside = Window.partitionBy("_range").orderBy(*order)
    return (ranged.withColumn("_n", F.row_number().over(inside)).join(first, "_range")
            .withColumn(out, F.col("_before") + F.col("_n")).drop("_range", "_before", "_n"))
