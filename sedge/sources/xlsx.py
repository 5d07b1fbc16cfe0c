"""Spreadsheets as a Python data source: sheets read as rows of (sheet, row_no, cells), one partition per file; and export.

Reading takes `path` options as a JSON list of files (planned by Spark's own listing), and `sheet` as a name or a number
from 0. The first row of a sheet names its columns; empty cells are left out of the map.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "file string, sheet string, row_no int, cells map<string,string>"


def open_file(path: str) -> bytes:
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    with system.open_input_file(inside) as f:
        return f.read()


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def column_letters(n: int) -> str:
    out, n = "", n + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def sheets(data: bytes) -> Iterator[tuple[str, Iterator[list[str | None]]]]:
    """Name and rows of the sheets, in workbook order."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", NS)]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def cell_text(c) -> str | None:
        kind, value = c.get("t"), c.find("m:v", NS)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
        if value is None or value.text is None:
            return None
        return shared[int(value.text)] if kind == "s" else value.text

    def rows(part: str) -> Iterator[list[str | None]]:
        for row in ET.fromstring(book.read(part)).iter(f"{{{NS['m']}}}row"):
            out: list[str | None] = []
            for k, c in enumerate(row.findall("m:c", NS)):
                at = column_number(c.get("r")) if c.get("r") else k
                out += [None] * (at - len(out)) + [cell_text(c)]
            yield out

    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{NS['m']}}}sheet"):
        target = targets[s.get(REL)].lstrip("/")
        yield s.get("name"), rows(target if target.startswith("xl/") else f"xl/{target}")


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.sheet = json.loads(options["files"]), options.get("sheet")

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        for k, (name, rows) in enumerate(sheets(open_file(partition.value))):
            if self.sheet not in (None, name, str(k)):
                continue
            header = next(rows, [])
            for n, row in enumerate(rows, 1):
                cells = {str(h): v for h, v in zip(header, row, strict=False) if h is not None and v not in (None, "")}
                if cells:
                    yield (partition.value, name, n, cells)


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return XlsxReader(self.options)


def read_xlsx(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """Rows of all spreadsheets that a path or pattern lists."""
    spark.dataSource.register(XlsxSource)
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator()]
    reader = spark.read.format("xlsx").option("files", json.dumps(files))
    return (reader if sheet is None else reader.option("sheet", str(sheet))).load()


def sheet_frame(rows: DataFrame, sheet: str) -> DataFrame:
    """One sheet with its columns, whose names come from the rows."""
    own = rows.where(F.col("sheet") == sheet)
    names = [r["k"] for r in own.select(F.explode(F.map_keys("cells")).alias("k")).distinct().orderBy("k").collect()]
    return own.select("row_no", *[F.col("cells")[n].alias(n) for n in names])


def workbook(tables: list[tuple[str, list[str], list[list]]]) -> bytes:
    """A workbook of (sheet name, header, rows); numbers stay numbers."""

    def cell(r: int, c: int, value) -> str:
        at = f"{column_letters(c)}{r}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    out = io.BytesIO()
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(tables) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{main}.worksheet+xml"/>' for k in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(t[0], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, t in zip(n, tables, strict=True)) + "</sheets></workbook>")
        for k, (_, header, rows) in zip(n, tables, strict=True):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([header, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_xlsx(tables: DataFrame, path: str) -> None:
    """One workbook per row of (book string, sheets array<struct<name, header array, values array>>), written by the tasks."""

    def save(rows) -> None:
        from pyarrow import fs

        for row in rows:
            system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            system.create_dir(inside, recursive=True)
            with system.open_output_stream(f"{inside}/{row['book']}.xlsx", compression=None) as out:
                out.write(workbook([(s["name"], s["header"], [s["values"]]) for s in row["sheets"]]))

    tables.foreachPartition(save)
