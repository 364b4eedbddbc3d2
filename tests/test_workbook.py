"""Workbooks: hand-made files, round trips, defined results of odd cells."""

import os
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import DataSourceArrowWriter

from ledgerloom.sources import schemas, tables
from ledgerloom.sources.workbook import (
    MAIN,
    PACKAGE,
    RELATED,
    WorkbookReader,
    WorkbookWriter,
    read_workbooks,
    write_workbooks,
)

SHEET = "xl/worksheets/sheet{}.xml"


def handmade(path, sheets, strings=(), workbook_properties="", missing_list=False):
    """A workbook with shared strings, worksheets given as XML rows by name, and a chart sheet first."""
    kinds = [("chartsheet", "chartsheets/c.xml")] + [
        ("worksheet", f"worksheets/sheet{i}.xml") for i in range(len(sheets))
    ]
    links = "".join(
        f'<Relationship Id="r{i}" Type="{RELATED}/{kind}" Target="{target}"/>'
        for i, (kind, target) in enumerate(kinds + [("sharedStrings", "/xl/sharedStrings.xml")])
    )
    entries = "".join(
        f'<sheet name="{name}" sheetId="{i + 1}" r:id="r{i}"/>' for i, name in enumerate(["Chart", *sheets])
    )
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{RELATED}">{workbook_properties}<sheets>{entries}</sheets></workbook>',
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>'
        )
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(strings)}</sst>')
        for i, rows in enumerate(sheets.values()):
            archive.writestr(
                SHEET.format(i), f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>'
            )


STRINGS = [
    "<si><t>code</t></si>",
    "<si><t>when</t></si>",
    "<si><r><t>WHITE </t></r><r><t>HEART</t></r><rPh sb='0' eb='1'><t>hint</t></rPh></si>",
]
HEADER = '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c></row>'


def test_shared_strings_blanks_gaps_and_dates(spark, tmp_path):
    rows = (
        '<row r="1"/>'
        + HEADER
        + '<row r="4"><c r="B4" t="s"><v>2</v></c><c r="D4" s="5"><v>40513.351388888892</v></c></row>'
        + '<row r="5"><c r="A5"/><c r="B5" t="e"><v>#N/A</v></c></row>'
        + '<row r="6"><c r="B6"><v>85123</v></c><c r="C6"><v>1</v></c></row>'
        + '<row r="7"><c r="B7" t="b"><v>1</v></c><c r="D7"><v>59</v></c></row>'
        + '<row><c t="inlineStr"><is><t>x</t></is></c><c><v>2.5499999999999998</v></c></row>'
    )
    handmade(tmp_path / "a.xlsx", {"Data": rows}, STRINGS)
    got = read_workbooks(spark, str(tmp_path / "a.xlsx"), "code string, when timestamp_ntz").collect()
    assert [tuple(row) for row in got] == [
        ("WHITE HEART", datetime(2010, 12, 1, 8, 26)),
        ("85123", None),
        ("TRUE", datetime(1900, 2, 28)),
        ("2.55", None),
    ]


def test_sheets_by_number_name_and_all(spark, tmp_path):
    sheets = {
        name: HEADER + f'<row r="4"><c r="B4" t="str"><v>{name}</v></c></row>' for name in ("First", "Second")
    }
    for file in ("a.xlsx", "b.XLSX", "~a.xlsx", "notes.txt"):
        handmade(tmp_path / file, sheets, STRINGS)

    def codes(**options):
        frame = read_workbooks(spark, str(tmp_path), "code string", **options)
        return frame.rdd.getNumPartitions(), sorted(row.code for row in frame.collect())

    assert codes() == (2, ["First"] * 2)
    assert codes(sheet="Second") == (2, ["Second"] * 2)
    assert codes(sheet="*") == (4, ["First"] * 2 + ["Second"] * 2)
    with pytest.raises(PySparkException, match="no worksheet"):
        codes(sheet="Third")
    with pytest.raises(PySparkException, match="no column nothing"):
        read_workbooks(spark, str(tmp_path), "nothing string").collect()


def test_days_from_1904_and_unfit_values(spark, tmp_path):
    rows = HEADER + '<row r="4"><c r="B4"><v>1.5</v></c><c r="D4"><v>1</v></c></row>'
    handmade(tmp_path / "a.xlsx", {"Data": rows}, STRINGS, '<workbookPr date1904="1"/>')
    path = str(tmp_path)
    assert tuple(read_workbooks(spark, path, "when date, code int").first()) == (date(1904, 1, 2), None)
    assert read_workbooks(spark, path, "code decimal(4,0)").first().code == Decimal(2)
    assert read_workbooks(spark, path, "code decimal(1,1)").first().code is None
    with pytest.raises(PySparkException, match="does not fit"):
        read_workbooks(spark, path, "code int", mode="FAILFAST").collect()
    with pytest.raises(PySparkException, match="hold no values"):
        read_workbooks(spark, path, "code array<int>").collect()


def test_round_trip_over_several_workbooks(spark, tmp_path):
    schema = (
        "text string, small int, big bigint, money decimal(18,4), real double, yes boolean, "
        "day date, moment timestamp_ntz"
    )
    rows = [
        (None,) * 8,
        ("", 0, 0, Decimal("0.0000"), 0.0, False, date(1900, 2, 28), datetime(1900, 3, 1)),
        (" a <b> & \x00\x1f _x0041_ \r\n\t é😀", -7, 2**62, Decimal("-99999999999999.9999"), 0.1, True,
         date(2011, 12, 9), datetime(2011, 12, 9, 12, 50, 59, 123000)),
    ]
    rows += [(str(i), i, i, Decimal(i), i / 7, None, None, None) for i in range(50)]
    path = str(tmp_path / "books")
    write_workbooks(spark.createDataFrame(rows, schema).repartition(3), path, sheetRows="11")
    files = sorted(os.listdir(path))
    assert len([file for file in files if file.endswith(".xlsx")]) >= 6
    got = [tuple(row) for row in read_workbooks(spark, path, schema).collect()]
    # A row without any value is a blank line, which readers skip.
    assert sorted(got, key=str) == sorted(map(tuple, rows[1:]), key=str)
    write_workbooks(spark.createDataFrame(rows[1:2], schema), f"file://{path}", mode="overwrite")
    assert read_workbooks(spark, f"file:{path}", schema).count() == 1


def test_empty_tables_and_folders(spark, tmp_path):
    path = str(tmp_path / "none")
    write_workbooks(spark.createDataFrame([], "a int"), path)
    assert read_workbooks(spark, path, "a int").count() == 0
    handmade(tmp_path / "blank.xlsx", {"Data": ""})
    with pytest.raises(PySparkException, match="no column a"):
        read_workbooks(spark, str(tmp_path / "blank.xlsx"), "a int").collect()


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "failed")
    broken = spark.range(20).selectExpr("id", "CASE WHEN id = 13 THEN raise_error('stop') ELSE id END AS b")
    with pytest.raises(PySparkException):
        write_workbooks(broken.selectExpr("id", "CAST(b AS bigint) AS b"), path)
    assert [name for _, _, names in os.walk(path) for name in names] == []


def test_transactions_from_a_workbook(spark, tmp_path):
    row = ("536365", "85123A", None, 6, datetime(2010, 12, 1, 8, 26), Decimal("2.5500"), "17850", "United Kingdom")
    path = str(tmp_path / "sales")
    write_workbooks(spark.createDataFrame([row], schemas.TRANSACTIONS), path)
    assert tuple(tables.load_transactions(spark, path, "workbook").first()) == row


def test_pieces_become_arrow_columns_and_odd_markup_is_parsed(spark, tmp_path):
    """Common cells never pass through Python rows; a piece or worksheet with other markup gives the same."""
    schema = spark.createDataFrame([], "code string, when decimal(10,2)").schema
    plain = "".join(f'<row r="{i}"><c r="B{i}" t="s"><v>2</v></c><c r="D{i}"><v>{i}.5</v></c></row>' for i in range(4, 30))
    odd = {
        "plain": plain,
        "repeated cell, lines and entities": plain
        + '<row r="30"><c r="B30"><v>1</v></c><c r="B30" t="str"><f>A1&gt;2</f><v>a&amp;&#233;\r\n_x0041_</v></c></row>',
        "order of attributes": plain + '<row r="30"><c t="s" r="B30"><v>2</v></c><c r="D30"><v>1e1</v></c></row>',
        "runs": plain + '<row r="30"><c r="B30" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row>',
        "comment": plain + '<!-- </row> --><row r="30"><c r="B30" t="inlineStr"><is><t><![CDATA[</row>]]></t></is></c></row>',
    }
    last = [(), (("a&é\nA", None),), (("WHITE HEART", Decimal("10.00")),), (("xy", None),), (("</row>", None),)]
    for rows, more in zip(odd.values(), last):
        handmade(tmp_path / "a.xlsx", {"Data": HEADER + rows}, STRINGS)
        reader = WorkbookReader(schema, {"path": str(tmp_path / "a.xlsx")})
        batches = list(reader.read(reader.partitions()[0]))
        assert all(isinstance(batch, pa.RecordBatch) for batch in batches)
        got = [tuple(row.values()) for batch in batches for row in batch.to_pylist()]
        assert got == [("WHITE HEART", Decimal(f"{i}.50")) for i in range(4, 30)] + list(more)
    assert issubclass(WorkbookWriter, DataSourceArrowWriter)


def test_texts_over_many_pieces(spark, tmp_path):
    """Rows are cut into pieces between rows, wherever a block of bytes ends."""
    rows = "".join(f'<row r="{i}"><c r="B{i}" t="str"><v>{"é" * (i % 97)}</v></c></row>\n' for i in range(4, 30_000))
    handmade(tmp_path / "a.xlsx", {"Data": HEADER + rows}, STRINGS)
    got = [row.code for row in read_workbooks(spark, str(tmp_path / "a.xlsx"), "code string").collect()]
    assert got == ["é" * (i % 97) for i in range(4, 30_000)]
