"""Statement files: discovery (S1), path guard (S9), file info (S8), and
readers that turn workbooks/CSV files into ``(path, sheet_row, cells)``
(S2, S10).

A CSV file is read in byte ranges by many tasks (``csv_split``).  A workbook is a
zip archive and cannot be split, so each is parsed by one task (``binaryFile`` +
``mapInPandas``), as a stream of rows; everything after that - header detection,
cleaning, dedup - is distributed DataFrame work.  openpyxl is not
available, so ``.xlsx`` sheets are read with ``zipfile`` + ``xml.etree``;
legacy ``.xls`` (BIFF) is not decoded and such files go to the bad-files
output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import as_col
from ..session import stage
from .csv_split import read_csv_cells

# ---- fixed values ----------------------------------------------------------
# File extensions per configured file type; unknown types accept all three.
EXTENSIONS = {"excel": ["xls", "xlsx"], "csv": ["csv"], "pdf": ["pdf"]}
DEFAULT_EXTENSIONS = ["xls", "xlsx", "csv"]
# Path guard: rejected fragments, and system prefixes rejected unless the
# path is under a temp folder.
BLOCKED_FRAGMENTS = ["..", "~", "%2e%2e"]
TEMP_MARKERS = ["/tmp/", "/var/tmp/", "/var/folders/", "/private/var/folders/"]
SYSTEM_PREFIXES = ["/etc/", "/var/log/", "/var/lib/", "/usr/", "/bin/", "/sbin/"]
# ---------------------------------------------------------------------------

CELLS_SCHEMA = "path string, sheet_row long, cells array<string>"
BAD_SCHEMA = "path string, error string"


def is_safe_path(c) -> Column:
    """No traversal fragments; no system folder unless under a temp one."""
    p = as_col(c)
    low = F.lower(p)
    bad = F.lit(False)
    for frag in BLOCKED_FRAGMENTS:
        bad = bad | low.contains(frag)
    in_temp = F.lit(False)
    for m in TEMP_MARKERS:
        in_temp = in_temp | p.contains(m)
    system = F.lit(False)
    for pre in SYSTEM_PREFIXES:
        system = system | p.startswith(pre)
    return F.coalesce((F.length(p) > 0) & ~bad & (in_temp | ~system), F.lit(False))


def _local_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:", "")


def discover_files(spark: SparkSession, root: str, file_type: str | None = None,
                   processed: DataFrame | None = None) -> DataFrame:
    """S1 + S8 + S9: statement files under ``root`` with name, size and
    modification time, newest first; only the metadata columns are read
    (content pruned).  Files already in ``processed`` (file_path) are
    dropped, so a run takes every new file, not just one."""
    exts = EXTENSIONS.get(file_type or "", DEFAULT_EXTENSIONS)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(_local_path(F.col("path")).alias("file_path"), F.col("length").alias("file_size"),
                     F.col("modificationTime").alias("modified_at"), F.col("_metadata.file_path").alias("file_uri"),
                     F.lit(root).alias("folder")))
    files = files.filter(F.lower("file_path").rlike(r"\.(" + "|".join(exts) + r")$"))
    files = files.filter(is_safe_path(F.col("file_path")))
    files = files.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    if processed is not None:
        files = files.join(processed.select("file_path"), "file_path", "left_anti")
    return files.orderBy(F.desc("modified_at"), "file_path")


#: Rows of one frame handed back to Spark.
FRAME_ROWS = 20_000


def _first_sheet(z) -> str:
    """The part of the first sheet in the workbook's own order, found through
    its relationships; without these the lowest sheet number."""
    import posixpath
    import re
    import xml.etree.ElementTree as ET

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(main + "sheet"):
            target = targets.get(sheet.get(rel), "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if part in names:
                return part
    numbered = [(int(m[1]), n) for n in names if (m := re.match(r"xl/worksheets/sheet(\d+)\.xml$", n))]
    if not numbered:
        raise ValueError("workbook has no sheet")
    return min(numbered)[1]


class _SharedStrings:
    """A workbook's shared strings as one buffer of bytes and offsets."""

    def __init__(self, stream):
        import array
        import xml.etree.ElementTree as ET

        self.text, self.at, root = bytearray(), array.array("Q", [0]), None
        for event, el in ET.iterparse(stream, ("start", "end")):
            root = el if root is None else root
            if event == "end" and el.tag == _MAIN + "si":
                self.text += "".join(t.text or "" for t in el.iter(_MAIN + "t")).encode()
                self.at.append(len(self.text))
                root.clear()  # what has been read goes

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.at) - 1:
            raise IndexError("no such shared string")
        return self.text[self.at[i]: self.at[i + 1]].decode()


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _xlsx_rows(data: bytes):
    """(row index, cells) of the first sheet, one row in memory at a time."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = None
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = _SharedStrings(f)
        sheet, seen = None, 0
        with z.open(_first_sheet(z)) as f:
            for event, el in ET.iterparse(f, ("start", "end")):
                if event == "start" and el.tag == _MAIN + "sheetData":
                    sheet = el
                elif event == "end" and el.tag == _MAIN + "row":
                    yield int(el.get("r", seen + 1)) - 1, _xlsx_cells(el, shared)
                    seen += 1
                    if sheet is not None:
                        sheet.clear()


def _xlsx_cells(row, shared) -> list:
    cells: dict[int, str | None] = {}
    for c in row.findall(_MAIN + "c"):
        col = 0
        for ch in c.get("r", ""):
            if not "A" <= ch <= "Z":
                break
            col = col * 26 + (ord(ch) - 64)
        t = c.get("t")
        v = c.find(_MAIN + "v")
        if t == "s" and v is not None:
            val = shared[int(v.text)]
        elif t == "inlineStr":
            val = "".join(x.text or "" for x in c.iter(_MAIN + "t"))
        elif v is not None and v.text is not None:
            txt = v.text
            if t in ("str", "b", "e"):
                val = txt
            else:
                num = float(txt)
                val = str(int(num)) if num.is_integer() and "." not in txt and "E" not in txt.upper() else repr(num)
        else:
            val = None
        cells[col - 1 if col else len(cells)] = val
    return [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]


def _parse_files(batches):
    """Cells of workbooks in frames of bounded size; a file that cannot be read to its
    end has a row -1 with the error (its other rows are left out by the caller)."""
    import pandas as pd

    def frame(path, rows):
        return pd.DataFrame({"path": path, "sheet_row": [r for r, _ in rows], "cells": [c for _, c in rows]})

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows: list[tuple] = []
            try:
                if not path.lower().endswith(".xlsx"):
                    raise ValueError("unsupported statement format")
                for row in _xlsx_rows(bytes(content)):
                    rows.append(row)
                    if len(rows) == FRAME_ROWS:
                        yield frame(path, rows)
                        rows = []
            except Exception as exc:  # noqa: BLE001 - bad file becomes a row
                rows = [(-1, [f"{type(exc).__name__}: {exc}"])]
            if rows:
                yield frame(path, rows)


def read_statement_cells(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 + S10: ``(cells, bad_files)`` for files found by ``discover_files``.

    ``cells`` rows are ``(path, sheet_row, cells)``, with the first sheet
    row as a header candidate (D1).  A file that cannot be parsed becomes a
    row of ``bad_files`` instead of failing the job (D13).  The folder is read as a
    whole and joined with the list of files: no path goes through the driver."""
    known = stage(files.select("file_uri", "file_path", "folder", "modified_at"), "listed")
    # one row; files older than the oldest of these are passed over by the readers
    first = known.agg(F.min("folder").alias("folder"), F.date_format(F.min("modified_at") - F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss").alias("since")).first()
    if first["folder"] is None:
        return spark.createDataFrame([], CELLS_SCHEMA), spark.createDataFrame([], BAD_SCHEMA)
    is_csv = F.lower("file_path").endswith(".csv")
    found = []
    if not known.filter(is_csv).isEmpty():
        found.append(read_csv_cells(spark, first["folder"], known.filter(is_csv), first["since"]))
    if not known.filter(~is_csv).isEmpty():
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS]*")
               .option("modifiedAfter", first["since"]).load(first["folder"])
               .withColumn("path", _local_path(F.col("path"))))
        raw = raw.join(known.filter(~is_csv).select(F.col("file_path").alias("path")), "path", "left_semi").select("path", "content")
        found.append(raw.mapInPandas(_parse_files, CELLS_SCHEMA))
    # Parse every file once: the cells feed header detection, the data rows and the
    # bad-file list, so they are staged (shared checkpoint folder) instead of
    # re-parsed by each consumer.
    parsed = stage(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "cells")
    # a row per unreadable file, staged: its size lets the cells stay where they are
    bad = stage(parsed.filter(F.col("sheet_row") < 0).groupBy("path").agg(F.min(F.col("cells")[0]).alias("error")), "bad")
    good = parsed.filter(F.col("sheet_row") >= 0).join(bad, "path", "left_anti")
    return good, bad
