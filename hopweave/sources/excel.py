"""Excel workbooks (.xlsx) as tables of texts, read on the executors.

A workbook is a ZIP of XML files. Spark reads the files, whatever file system they are
on; a task takes one workbook at a time and goes through its first sheet row by row, so
what it holds is the packed file and the sheet's shared strings.
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

from hopweave.sources.shared import written

#: Rows of an Arrow batch.
ROWS = 2000
# ---- fixed values: names and numbers of the format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATES = frozenset([*range(14, 23), *range(45, 48)])


def _texts(node) -> str:
    """The text of a string item, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The name of the first sheet's file, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = root.find(f"{MAIN}sheets/{MAIN}sheet")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    props = root.find(f"{MAIN}workbookPr")
    target = links[sheet.get(f"{RELS}id")]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", props is not None and props.get("date1904") in ("1", "true")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
    dated = DATES | {i for i, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE)}
    cells = root.find(f"{MAIN}cellXfs")
    return {n for n, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dated}


def _column(ref: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for letter in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _number(text: str, dated: bool, since_1904: bool) -> str:
    x = float(text)
    if dated:
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        return (start + timedelta(seconds=round(x * 86400))).isoformat(" ")
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as lists of texts, the headers first; rows without any cell give empty lists."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name, since_1904 = _first_sheet(book)
        dated, strings = _date_styles(book), []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        strings.append(_texts(node))
                        node.clear()
        expected = 1
        with book.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                number = int(node.get("r", expected))
                while expected < number:  # rows without cells may be left out of the file
                    yield []
                    expected += 1
                expected += 1
                row: list[str | None] = []
                for cell in node.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
                    if kind == "inlineStr":
                        inline = cell.find(f"{MAIN}is")
                        row[at] = _texts(inline) if inline is not None else None
                    elif value is None:
                        continue
                    elif kind == "s":
                        row[at] = strings[int(value)]
                    elif kind == "b":
                        row[at] = "True" if value == "1" else "False"
                    else:
                        row[at] = value if kind != "n" else _number(value, int(cell.get("s", 0)) in dated, since_1904)
                node.clear()
                yield row


def _names(header: list[str | None]) -> list[str]:
    """Names of columns: those without one by their number, repeated ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(header):
        name = c if c not in (None, "") else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_excel(spark: SparkSession, path: str | list[str], position: bool = False) -> DataFrame:
    """The first sheets of workbooks, united by the names of their columns, as texts; a cell that is empty or missing is null.

    path: a file, a folder, a pattern, or a list of these. With position, `file` and
    `row` (from 0) say where a row stood. Rows without any value are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]

        def some(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "row", "names", "cells"])

        for batch in batches:
            for file, content in zip(*(batch.column(c) for c in (0, 1)), strict=True):
                rows, names = sheet_rows(content.as_py()), None
                held = []
                for n, row in enumerate(rows, -1):
                    if names is None:
                        names = _names(row)
                        held.append((file.as_py(), -1, names, []))
                    elif any(v not in (None, "") for v in row):
                        wide = [*names, *(f"Unnamed: {i}" for i in range(len(names), len(row)))]
                        held.append((file.as_py(), n, wide[: len(row)], [None if v == "" else v for v in row]))
                    if len(held) == ROWS:
                        yield some(held)
                        held = []
                if held:
                    yield some(held)

    # one workbook a task at a time, as many tasks as Spark has files and cores for
    parsed = written(files.mapInArrow(run, "file string, row bigint, names array<string>, cells array<string>"), "excel")
    first = F.min(F.struct("file", "pos"))
    columns = [r["name"] for r in parsed.select("file", F.posexplode("names").alias("pos", "name")).groupBy("name").agg(first.alias("first")).orderBy("first", "name").collect()]
    cell = F.map_from_arrays("names", "cells")
    rows = parsed.where("row >= 0").select("file", "row", cell.alias("m"))
    where = ["file", "row"] if position else []
    return rows.select(*where, *(F.col("m")[c].alias(c) for c in columns))
