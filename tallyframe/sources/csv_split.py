"""CSV statements of any size over many tasks.

Spark's text reader cuts files into byte ranges; a line belongs to the range in which
it begins.  Whether a line break ends a record depends on all quotes before it, so:

1. Every range is read once under both assumptions, that it begins outside and inside
   a quoted field, and keeps per line the state and the number of records so far under
   each.  The lines are staged.
2. A range turns the state it begins in into the state it ends in.  Such functions of
   two states are constant, keep the state or swap it; a running count of swaps since
   the last constant one gives the state and the record number at every range's start
   (a row per range, by window within a file).
3. Lines that are a record go straight to the parser; lines of one record that are
   apart, maybe in different ranges, are put together by a grouping of these alone.

Records and row numbers are those of Python's ``csv.reader`` over the whole file; a
field that is still open at the end of the file ends there, without a last line break.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

#: Bytes of a record of several lines; a longer one is a quote that is never closed.
MAX_RECORD = 16 << 20

_LINES = ("file_uri string, block long, line_no long, line binary, out_open boolean, out_closed boolean, out_record long, "
          "in_open boolean, in_closed boolean, in_record long")
_LINES_ARROW = pa.schema([("file_uri", pa.string()), ("block", pa.int64()), ("line_no", pa.int64()), ("line", pa.binary()), ("out_open", pa.bool_()),
                          ("out_closed", pa.bool_()), ("out_record", pa.int64()), ("in_open", pa.bool_()), ("in_closed", pa.bool_()), ("in_record", pa.int64())])
_QUOTED = re.compile(rb'(?:[^"]|"")*+')


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``.  A quote opens one at the start
    of a field only; after its closing quote the rest of a field is plain text."""
    if b'"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            at = _QUOTED.match(line, at).end()
            if at >= n:
                return True
            inside = False  # at its closing quote
        elif line[at: at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(b",", at) + 1
        if not at:
            return False


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their state and record number under both assumptions.  The lines of
    a range come together and in order."""
    own = None
    for batch in batches:
        rows: list[tuple] = []
        for path, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (path, block) != own:
                own, number, out, into, out_n, in_n = (path, block), 0, False, True, 0, 0
                if block == 0 and line.startswith(b"\xef\xbb\xbf"):
                    line = line[3:]
            out_next = inside_after(line, out)
            in_next = inside_after(line, into) if into != out else out_next
            out_n, in_n = out_n + (not out), in_n + (not into)
            rows.append((path, block, number, line, out, not out_next, out_n, into, not in_next, in_n))
            number, out, into = number + 1, out_next, in_next
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES_ARROW)], schema=_LINES_ARROW)


def _block_starts(lines: DataFrame) -> DataFrame:
    """(file_path, block, inside, before): the state at every range's start and the
    records of the file that begin before it."""
    ends = lines.groupBy("file_path", "block").agg(
        F.max_by(F.struct("out_closed", "in_closed", "out_record", "in_record"), "line_no").alias("e")).select(
        "file_path", "block", (~F.col("e.out_closed")).alias("out_end"), (~F.col("e.in_closed")).alias("in_end"),
        F.col("e.out_record").alias("out_n"), F.col("e.in_record").alias("in_n"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("out_end") & ~F.col("in_end")).cast("int")
    fixed = F.when(F.col("out_end") == F.col("in_end"), F.struct(F.col("out_end").cast("int").alias("state"), F.col("swaps").alias("swaps")))
    ends = ends.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    ends = ends.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    state = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("fixed.swaps"), F.lit(0))
    ends = ends.withColumn("inside", state % 2 == 1)
    mine = F.when(F.col("inside"), F.col("in_n")).otherwise(F.col("out_n"))
    return ends.select("file_path", "block", "inside", F.coalesce(F.sum(mine).over(earlier), F.lit(0)).alias("before"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of records; what cannot be read has row -1 and the error as its cell."""
    for batch in batches:
        rows, cells = [], []
        for record, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            try:
                end = "" if inside_after(text, False) else "\n"
                found = list(csv.reader(io.StringIO(text.decode("utf-8") + end)))
                if len(found) != 1:
                    raise csv.Error("line break outside of quotes")
                rows.append(record - 1)
                cells.append([c if c != "" else None for c in found[0]])
            except (UnicodeDecodeError, csv.Error) as exc:
                rows.append(-1)
                cells.append([f"{type(exc).__name__}: {exc}"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["path", "sheet_row", "cells"])


def read_csv_cells(spark: SparkSession, folder: str, files: DataFrame, since: str | None = None) -> DataFrame:
    """(path, sheet_row, cells) of the CSV statements under ``folder`` that ``files``
    (file_uri, file_path) names; rows with sheet_row -1 tell why a file cannot be read.
    Files that were last changed up to ``since`` are not opened."""
    # lines are numbered straight from the reader: a join before could change their order
    reader = spark.read.option("modifiedAfter", since) if since else spark.read
    text = (reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").option("lineSep", "\n").text(folder)
            .select(F.col("_metadata.file_path").alias("file_uri"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")))
    lines = text.mapInArrow(_scan, _LINES).join(files.select("file_uri", "file_path"), "file_uri").drop("file_uri")
    lines = stage(lines, "lines")
    # a row per range: staged, its size lets the lines be joined where they lie
    known = lines.join(stage(_block_starts(lines), "starts"), ["file_path", "block"])

    def either(name: str):
        return F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}"))

    known = known.select("file_path", "block", "line_no", "line", either("open").alias("open"), either("closed").alias("closed"),
                         (F.col("before") + either("record")).alias("record"))
    whole = known.filter(~F.col("open") & F.col("closed")).select("file_path", "record", "line")
    parts = known.filter(F.col("open") | ~F.col("closed"))
    sizes = parts.groupBy("file_path", "record").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    endless = sizes.filter(F.col("size") > MAX_RECORD)
    joined = (parts.join(endless, ["file_path", "record"], "left_anti").groupBy("file_path", "record")
              .agg(F.sort_array(F.collect_list(F.struct("block", "line_no", "line"))).alias("l"))
              .select("file_path", "record", F.expr("array_join(transform(l, x -> decode(x.line, 'ISO-8859-1')), '\n')").alias("text"))
              .select("file_path", "record", F.encode("text", "ISO-8859-1").alias("line")))
    cells = whole.unionByName(joined).mapInArrow(_parse, "path string, sheet_row long, cells array<string>")
    return cells.unionByName(endless.select(F.col("file_path").alias("path"), F.lit(-1).cast("long").alias("sheet_row"),
                                            F.array(F.lit("Error: a quoted field is never closed")).alias("cells")))
