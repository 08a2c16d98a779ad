"""Workbooks: dates by style, one pass over each file, one file at a time."""

import io
import zipfile
from datetime import datetime

from gritstone.sources import workbook as book
from gritstone.sources.reader import read_dataset
from suite.source_cases import workbook


def restyled(content: bytes, name: str, change) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for entry in old.namelist():
            data = old.read(entry)
            new.writestr(entry, change(data.decode()).encode() if entry == name else data)
    return out.getvalue()


def test_formats():
    dates = ["yyyy-mm-dd", "d/m/yy h:mm", "[$-409]mmm d", "h:mm AM/PM", "[Red]dd.mm.", 'm"x"']
    others = ["General", "0.00", '"days" 0', "#,##0;[Red]-#,##0", "0.00E+00", "\\d0", "_d0", "[h]"]
    assert [book.shows_date(c) for c in dates] == [True] * len(dates)
    assert [book.shows_date(c) for c in others] == [False] * len(others)


def test_moments():
    first = book.FIRST_DAY
    assert book._moment(1.0, first) == "1900-01-01 00:00:00" and book._moment(61.0, first) == "1900-03-01 00:00:00"
    assert book._moment(45292.75, first) == "2024-01-01 18:00:00" and book._moment(0.5, first) == "12:00:00"
    assert book._moment(45292.5 + 1 / 86400000, first) == "2024-01-01 12:00:00.001000"
    assert book._moment(1.0, book.FIRST_DAY_1904) == "1904-01-02 00:00:00"


def test_dates_by_file(spark, tmp_path):
    day, noon = datetime(2024, 5, 17), datetime(2024, 5, 18, 12, 30)
    one = workbook(["when", "mixed", "n"], [[day, day, 1], [noon, "text", 2], ["", 5, 3]])
    one = restyled(one, "xl/worksheets/sheet1.xml", lambda t: t.replace('<c t="inlineStr"><is><t xml:space="preserve"></t></is></c>', "<c/>"))
    (tmp_path / "a.xlsx").write_bytes(one)
    (tmp_path / "b.xlsx").write_bytes(workbook(["n", "extra", "when"], [[4, "x", noon]]))
    found = read_dataset(spark, str(tmp_path), "xlsx")
    assert found.columns == ["when", "mixed", "n", "extra"]
    assert dict(found.dtypes)["when"] == "timestamp_ntz" and dict(found.dtypes)["mixed"] == "string"
    rows = {r.n: r for r in found.collect()}
    assert [rows[i].when for i in (1, 2, 3, 4)] == [day, noon, None, noon]
    assert [rows[i].mixed for i in (1, 2, 3, 4)] == ["2024-05-17 00:00:00", "text", "5", None] and rows[4].extra == "x"


def test_days_from_1904_and_headers_alone(spark, tmp_path):
    content = workbook(["when"], [[datetime(2024, 1, 1)]])
    late = restyled(content, "xl/workbook.xml", lambda t: t.replace("<sheets>", '<workbookPr date1904="1"/><sheets>'))
    (tmp_path / "late.xlsx").write_bytes(late)
    assert read_dataset(spark, str(tmp_path / "late.xlsx")).first()["when"] == datetime(2028, 1, 2)
    (tmp_path / "none.xlsx").write_bytes(workbook(["a", "b"], []))
    empty = read_dataset(spark, str(tmp_path / "none.xlsx"))
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_each_file_is_read_once(spark, tmp_path):
    """Rows come from a written table: reading again does not unzip the files again."""
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(workbook(["id"], [[i]]))
    found = book.read_workbook(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in found.collect()) == ["0", "1", "2"]


def test_files_of_one_partition_are_dealt_out(spark):
    files = spark.createDataFrame([(f"{i}", workbook(["id"], [[i]])) for i in range(12)], "path string, content binary").coalesce(1)
    rows = book._stream(files)
    assert len(rows.inputFiles()) > 4
    assert sorted(r.cells[0] for r in rows.where("place = 1").collect()) == sorted(map(str, range(12)))
