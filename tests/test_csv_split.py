"""CSV statements cut into byte ranges against csv.reader over whole files."""

import csv
import io
import os
import random

import pytest

from tallyframe.sources import csv_split
from tallyframe.sources import statements as ST

PIECES = ["a", "bc", ",", ",", '"', '"', '""', "\n", "\r\n", " ", "é", "x,y", '"q, r"', '"two\nlines"', "\n\n", '5" pipe']


def want(text):
    return [(i, [c if c != "" else None for c in row]) for i, row in enumerate(csv.reader(io.StringIO(text)))]


def test_state_after_a_line():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice([p for p in PIECES if "\n" not in p]) for _ in range(rng.randrange(9)))
        for inside in (False, True):
            # csv.reader goes on to the next line exactly while a field is open
            rows = list(csv.reader(io.StringIO(('"z\n' if inside else "") + line + "\nEND\n")))
            assert csv_split.inside_after(line.encode(), inside) == (rows[-1] != ["END"]), (line, inside)


@pytest.mark.parametrize("block", [40, 100_000])
def test_ranges_equal_whole_files(spark, scratch, block):
    rng = random.Random(block)
    texts = {}
    for i in range(12):
        text = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 3, 40, 200])))
        inside = False
        for line in text.split("\n"):
            inside = csv_split.inside_after(line.encode(), inside)
        try:
            rows = want(text.removesuffix("\n") if inside else text)
        except csv.Error:
            rows = None
        if text.count('"') % 2 == 0:
            texts[f"f {i}.csv"] = (text.encode(), rows)
    texts["bom.CSV"] = (b"\xef\xbb\xbf" + b'a,"b\nc"\n1,2\n', [(0, ["a", "b\nc"]), (1, ["1", "2"])])
    texts["bytes.csv"] = (b"a,b\n\xff\xfe,c\n", None)
    texts["long.csv"] = (b"x,y\n" + b'1,"' + b"line\n" * 500 + b'"\nlast,row\n', want("x,y\n" + '1,"' + "line\n" * 500 + '"\nlast,row\n'))
    for name, (data, _) in texts.items():
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        cells, bad = ST.read_statement_cells(spark, ST.discover_files(spark, scratch, "csv"))
        got, wrong = {}, {os.path.basename(r["path"]) for r in bad.collect()}
        for r in cells.collect():
            got.setdefault(os.path.basename(r["path"]), []).append((r["sheet_row"], r["cells"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert wrong == {n for n, (_, rows) in texts.items() if rows is None}
    assert {n: sorted(rows) for n, rows in got.items()} == {n: rows for n, (_, rows) in texts.items() if rows}


def test_a_quote_that_is_never_closed(spark, scratch, monkeypatch):
    monkeypatch.setattr(csv_split, "MAX_RECORD", 1000)
    with open(os.path.join(scratch, "a.csv"), "w") as f:
        f.write('x,"' + "line\n" * 400)
    cells, bad = ST.read_statement_cells(spark, ST.discover_files(spark, scratch, "csv"))
    assert cells.count() == 0 and bad.count() == 1


def big_workbook(n):
    import zipfile
    data = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>s{i}</t></r><r><t>é</t></r></si>" for i in range(50)) + "</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for i in range(n):
                f.write(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="C{i + 1}" t="s"><v>{i % 50}</v></c><c r="AB{i + 1}" t="inlineStr"><is><t>x{i}</t></is></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return data.getvalue()


def test_a_workbook_is_read_row_by_row():
    import tracemalloc
    peaks = []
    for n in (4_000, 40_000):
        data = big_workbook(n)
        tracemalloc.start()
        last, count = None, 0
        for last in ST._xlsx_rows(data):
            count += 1
        peaks.append(tracemalloc.get_traced_memory()[1] - len(data))
        tracemalloc.stop()
        assert count == n and last == (n - 1, [str(n - 1), None, f"s{(n - 1) % 50}é", *[None] * 24, f"x{n - 1}"])
    assert peaks[1] < 2 * peaks[0] + 500_000  # ten times the rows, about the same memory


def test_a_workbook_that_breaks_off(spark, scratch):
    good = big_workbook(30)
    with open(os.path.join(scratch, "good.xlsx"), "wb") as f:
        f.write(good)
    with open(os.path.join(scratch, "cut.xlsx"), "wb") as f:
        f.write(good[: len(good) // 2])
    cells, bad = ST.read_statement_cells(spark, ST.discover_files(spark, scratch, "excel"))
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["cut.xlsx"]
    assert cells.filter("path like '%good.xlsx'").count() == 30


def test_cells_are_not_shuffled_by_file(spark, scratch):
    """Range starts and unreadable files are small frames of known size: neither lines
    nor cells move to one task per file."""
    from tallyframe.sources.statements import discover_files, read_statement_cells

    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("x,\"two\nlines\",z\nplain,1,2\n")
    with open(os.path.join(folder, "b.csv"), "wb") as f:
        f.write(b"\xff\xfe\x00,bad\n")
    cells, bad = read_statement_cells(spark, discover_files(spark, folder, "csv"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [(r["sheet_row"], r["cells"]) for r in cells.orderBy("sheet_row").collect()] == [(0, ["x", "two\nlines", "z"]), (1, ["plain", "1", "2"])]
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["b.csv"]
