"""Workbooks (.xlsx) as rows and as texts for retrieval. A workbook is a zip archive of XML parts."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.watch import _files

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Built-in number formats that show dates and times; fixed values of the file format.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
ROW = "path string, sheet_no int, sheet string, row int, cells array<string>, error string"


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node) -> str:
    """The text of a string item: its own and that of its runs, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def _dated(archive: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    plain = lambda code: "".join(part for i, part in enumerate(code.split('"')) if i % 2 == 0).lower()
    date = lambda i: i in DATE_FORMATS or i in own and any(c in plain(own[i]).replace("[red]", "") for c in "ymdh")
    return [date(int(x.get("numFmtId", 0))) for styles in root.findall(f"{MAIN}cellXfs") for x in styles]


def _number(text: str, dated: bool, base: datetime) -> str:
    value = float(text)
    if dated:
        return str(base + timedelta(microseconds=round(value * 86_400_000_000)))
    return str(int(text)) if text.lstrip("-").isdigit() else str(value)


def sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """(sheet number, title, row number, cells) of every row that a sheet lists, read part by part.

    Empty cells are null; a row has as many cells as its last one says, a listed row may have
    none. Rows keep their place, those that are not listed are left out. Formulas give their
    stored value.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for _, node in ElementTree.iterparse(archive.open("xl/sharedStrings.xml")):
                if node.tag == f"{MAIN}si":
                    shared.append(_text(node))
                    node.clear()
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        props = book.find(f"{MAIN}workbookPr")
        # serial days count from here; day 60 of the first calendar never was
        base = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        dated = _dated(archive)
        for number, sheet in enumerate(book.iter(f"{MAIN}sheet")):
            target = targets[sheet.get(f"{REL}id")]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if part not in names:
                continue
            place = 0
            for _, node in ElementTree.iterparse(archive.open(part)):
                if node.tag != f"{MAIN}row":
                    continue
                place = int(node.get("r", place + 1))
                cells: list[str | None] = []
                for c in node.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        inline = c.find(f"{MAIN}is")
                        cells[at] = None if inline is None else _text(inline)
                    elif value is not None and value.text is not None:
                        style = int(c.get("s", 0))
                        cells[at] = (
                            shared[int(value.text)] if kind == "s" else ("True" if value.text == "1" else "False") if kind == "b" else value.text if kind in ("str", "e", "d")
                            else _number(value.text, style < len(dated) and dated[style], base)
                        )
                yield number, sheet.get("name"), place, cells
                node.clear()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows: list = []
            try:
                for row in sheets(content.as_py()):
                    rows.append((path, *row, None))
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
            except Exception as e:  # whatever a broken file does to the reader
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield batch(rows)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_no, sheet, row, cells, error: a row for each row of each sheet of the workbooks under ``path``.

    A workbook is read in one task, a sheet at a time. A file that cannot be read gives one
    row with its error, beside the rows that came before it broke.
    """
    files = _files(spark, path)
    if files is None:
        return spark.createDataFrame([], ROW)
    return files.where(F.lower("path").rlike(r"\.xlsx?$")).select("path", "content").mapInArrow(_parsed, ROW)


def workbook_texts(spark: SparkSession, path: str, batch: int = 20) -> DataFrame:
    """path, sheet_no, batch, text: a sheet's rows as ``h: v | h: v`` under its title and headers, ``batch`` rows a text.

    The first row of a sheet has the headers; cells past it stand alone, and empty cells say
    None, as the wording is fixed. A sheet with headers alone gives no text, a workbook
    without a text says that it is empty, one that cannot be read says so.
    """
    # read once: the joins and groups below must see the same rows
    from weftline.operators.graph import durable

    rows = durable(workbook_rows(spark, path))
    first = rows.where("error is null").groupBy("path", "sheet_no").agg(F.min("row").alias("row"))
    heads = rows.join(first, ["path", "sheet_no", "row"]).select("path", "sheet_no", F.col("row").alias("top"), F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("headers"))
    data = rows.where("error is null").join(heads, ["path", "sheet_no"]).where("row > top")
    width = F.greatest(F.size("cells"), F.size("headers"))
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit("None"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i < F.size("headers"), F.concat(F.get("headers", i), F.lit(": "), cell(i))).otherwise(cell(i))), " | ")
    # a sheet's rows have their numbers already; those that are not listed do not fill a text
    from pyspark.sql import Window as W

    numbered = data.withColumn("line", F.when(width > 0, line).otherwise("")).withColumn("n", F.row_number().over(W.partitionBy("path", "sheet_no").orderBy("row")))
    texts = numbered.groupBy("path", "sheet_no", "sheet", "headers", F.floor((F.col("n") - 1) / batch).alias("batch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    out = texts.select("path", "sheet_no", "batch", F.concat(F.lit("Worksheet: "), "sheet", F.lit("\nHeaders: "), F.array_join("headers", " | "), F.lit("\n"), "body").alias("text"))
    broken = rows.where("error is not null").select("path").distinct()
    paths = _files(spark, path)
    every = spark.createDataFrame([], "path string") if paths is None else paths.where(F.lower("path").rlike(r"\.xlsx?$")).select("path")
    note = lambda df, t: df.select("path", F.lit(0).alias("sheet_no"), F.lit(0).cast("long").alias("batch"), t.alias("text"))
    failed = note(broken, F.concat(F.lit("[Excel parsing failed] "), "path"))
    empty = note(every.join(out.select("path").distinct(), "path", "left_anti").join(broken, "path", "left_anti"), F.lit("[Empty Excel]"))
    return out.join(broken, "path", "left_anti").unionByName(failed).unionByName(empty)


def _cell(value, at: int, row: int) -> str:
    name, n = "", at
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    from xml.sax.saxutils import escape

    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{name}{row}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{name}{row}"><v>{value}</v></c>'
    return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(sheets_of: dict[str, list[list]]) -> bytes:
    """The bytes of a workbook with these sheets (title -> rows of values): a small one for a report or a test."""
    from xml.sax.saxutils import quoteattr

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel, package = MAIN.strip("{}"), REL.strip("{}"), PACKAGE.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets_of) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(sheets_of, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_of) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">{targets}</Relationships>')
        for i, rows in enumerate(sheets_of.values(), 1):
            body = "".join(f'<row r="{n}">{"".join(_cell(v, j, n) for j, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
