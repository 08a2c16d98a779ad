"""First sheet of XLSX workbooks, one task per file.

A sheet holds at most 1,048,576 rows, so a file is a bounded unit of work; many
files are read side by side, each once, one at a time in a worker. Cells whose
style is a date become dates.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.values import quote, text_literal
from gritstone.runtime import batch_rows, materialize, share_package

# Names of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_PER_BATCH = 10_000
# Tasks that files are dealt out to, for each core.
TASKS_PER_CORE = 2
# Built-in number formats that show a date or a time of day, and the first days of the two calendars.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 47, 50, 57}
FIRST_DAY, FIRST_DAY_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
# What a format code holds besides its date parts: quoted and escaped text, padding, and brackets.
_NO_DATE_PARTS = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    wanted = sheets[0].get(RELATION)
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("The workbook names no sheet.")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def shows_date(code: str) -> bool:
    """Whether a number format code has parts of a date or time."""
    return bool(re.search("[dmyhs]", _NO_DATE_PARTS.sub("", code), re.IGNORECASE))


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): shows_date(f.get("formatCode", "")) for f in styles.iter(f"{MAIN}numFmt")}
    formats = styles.find(f"{MAIN}cellXfs")
    found = set()
    for i, style in enumerate(formats if formats is not None else ()):
        number = style.get("numFmtId", "0")
        if own.get(number, int(number) in DATE_FORMATS):
            found.add(str(i))
    return found


def _moment(serial: float, first_day: datetime) -> str:
    """A date-time, or a time of day below the first day, to the millisecond."""
    days = int(serial)
    rest = timedelta(milliseconds=round((serial - days) * 86_400_000))
    if 0 <= serial < 1:
        return str((datetime.min + rest).time())
    # The calendar from 1900 counts a day that never was.
    skipped = 1 if first_day == FIRST_DAY and days < 60 else 0
    return str(first_day + timedelta(days=days + skipped) + rest)


def _text(cell, shared: list[str], dates: set[str], first_day: datetime) -> tuple[str | None, bool]:
    """A cell as text, and whether it is a date."""
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), False
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None:
        return None, False
    if kind == "s":
        return shared[int(value.text)], False
    if kind == "d":
        return value.text.replace("T", " "), True
    if kind in (None, "n") and cell.get("s") in dates:
        serial = float(value.text)
        return _moment(serial, first_day), not 0 <= serial < 1
    return ("FALSE", "TRUE")[int(value.text)] if kind == "b" else value.text, False


def sheet_rows(content: bytes) -> Iterator[tuple[list[str | None], list[int]]]:
    """Rows of the first sheet as texts, each with the places of its dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared_texts(book), _date_styles(book)
        settings = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        first_day = FIRST_DAY_1904 if late else FIRST_DAY
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, tuple[str | None, bool]] = {}
                for i, cell in enumerate(row.iter(f"{MAIN}c")):
                    place = _column(cell.get("r")) if cell.get("r") else i
                    cells[place] = _text(cell, shared, dates, first_day)
                row.clear()
                yield [cells.get(i, (None, False))[0] for i in range(max(cells, default=-1) + 1)], [i for i, c in cells.items() if c[1]]


def header_names(cells: list[str | None]) -> list[str]:
    """Column names of a header row; empty cells are numbered and repeated names get .1, .2 and so on."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        base = name = cell or f"Unnamed: {i}"
        count = 0
        while name in names:
            count += 1
            name = f"{base}.{count}"
        names.append(name)
    return names


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All rows below the header of each file's first sheet; see ``workbook_rows``."""
    return workbook_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def _stream(files: DataFrame) -> DataFrame:
    """``path, place, names, cells, dates`` of every row, the header at place 0, from one pass over each file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names: list[str] = []
                block: list[tuple] = []
                for place, (cells, dates) in enumerate(sheet_rows(content)):
                    # A cell to the right of the header gets a numbered column.
                    if len(cells) > len(names):
                        names = header_names(cells) if place == 0 else header_names([*names, *[None] * (len(cells) - len(names))])
                    block.append((file, place, names, cells, dates))
                    if len(block) == ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], COLUMNS)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds, strict=True)], COLUMNS)

    # Small files come many to a task; dealt out, they keep all cores busy.
    dealt = files.select("path", "content").repartition(TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism)
    # A worker holds one file at a time.
    with batch_rows(files.sparkSession, 1):
        return materialize(dealt.mapInArrow(rows, "path string, place long, names array<string>, cells array<string>, dates array<int>"))


COLUMNS = ["path", "place", "names", "cells", "dates"]


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of the workbooks in ``path, content``: texts, and timestamps where all cells of a column are dates.

    Each file is read by its own header: columns are matched by name, a column that
    a file lacks is null there, and all files' columns appear, in the order in which
    the files, sorted by path, bring them. Rows may be shorter than their header; a
    cell to the right of it gets a numbered column.
    """
    spark = files.sparkSession
    share_package(spark)
    rows = _stream(files)
    # One row for each different header.
    headers = rows.groupBy("names").agg(F.min("path").alias("path")).collect()
    lists = [r["names"] for r in sorted(headers, key=lambda r: (r.path, len(r["names"])))]
    names = list(dict.fromkeys(n for header in lists for n in header))
    if not names:
        return spark.createDataFrame([], "value string").drop("value")
    same = all(header == names[: len(header)] for header in lists)
    filled = rows.where("place > 0")

    def cell(i: int) -> str:
        return f"get(cells, {i if same else f'cast(array_position(names, {text_literal(names[i])}) as int) - 1'})"

    dated = filled.select(F.explode(F.expr("transform(dates, d -> names[d])")).alias("name")).groupBy("name").count()
    counts = {r["name"]: r["count"] for r in dated.collect()}
    present = {}
    if counts:
        listed = [i for i, n in enumerate(names) if n in counts]
        found = filled.selectExpr(*[f"count({cell(i)}) as c{i}" for i in listed]).first()
        present = {names[i]: found[f"c{i}"] for i in listed}
    return filled.selectExpr(
        *[f"{f'cast({cell(i)} as timestamp_ntz)' if n in counts and counts[n] == present[n] else cell(i)} as {quote(n)}" for i, n in enumerate(names)]
    )
