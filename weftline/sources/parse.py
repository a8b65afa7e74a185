"""Files of all kinds to texts and chunks: each file is read by the reader of its type, and a file that cannot be read says so."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.chunk import chunk_pages
from weftline.operators.graph import durable
from weftline.sources import workbooks
from weftline.sources.watch import _files

Reader = Callable[[bytes], list[str]]
PARSED = "path string, doc_id string, doc_type string, part int, text string, error string"


def csv_texts(content: bytes, batch: int = 20) -> list[str]:
    """Rows as ``h: v | h: v`` under a ``Headers:`` line, ``batch`` rows a text. The wording is a fixed value.

    Values past the header are left out, missing ones say None, as those of a short row do.
    """
    rows = csv.DictReader(io.StringIO(content.decode("utf-8"), newline=""))
    heads = list(rows.fieldnames or [])
    lines = [" | ".join(f"{h}: {r.get(h, '')}" for h in heads) for r in rows]
    return [f"Headers: {' | '.join(heads)}\n" + "\n".join(lines[i : i + batch]) for i in range(0, len(lines), batch)] or ["[Empty CSV]"]


def sheet_texts(content: bytes, batch: int = 20) -> list[str]:
    """The same of every sheet of a workbook, under its title; a sheet's first row has its headers."""
    out, held = [], {}
    for number, title, _, cells in workbooks.sheets(content):
        held.setdefault((number, title), []).append(cells)
    for (_, title), (first, *rows) in held.items():
        heads = [c or "" for c in first]
        width = max(map(len, (first, *rows)))
        lines = []
        for r in rows:
            shown = ["None" if c is None else c for c in [*r, *[None] * (max(len(heads), len(r)) - len(r))]]
            lines.append(" | ".join(f"{heads[j]}: {c}" if j < len(heads) else c for j, c in enumerate(shown[:width])))
        out += [f"Worksheet: {title}\nHeaders: {' | '.join(heads)}\n" + "\n".join(lines[i : i + batch]) for i in range(0, len(lines), batch)]
    return out or ["[Empty Excel]"]


def _table(path: str, content: bytes) -> list[str]:
    return csv_texts(content) if path.lower().endswith(".csv") else sheet_texts(content)


def parse_files(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, most: int = 10 << 20) -> DataFrame:
    """path, doc_id, doc_type, part, text, error: the texts of every file below ``path``, in order.

    Text and markdown files are one text, tables are texts of twenty rows, and files of other
    types go to the reader that ``readers`` (type -> bytes to texts) brings for their type.
    A file without a reader, of a broken format, over ``most`` bytes or that makes its
    reader raise is one row with the text ``[... parsing failed] path`` and the error; all
    other files are parsed. A file is read in one task, as its size is limited.
    """
    readers = dict(readers or {})
    files = _files(spark, path)
    if files is None:
        return spark.createDataFrame([], PARSED)
    small = files.where(F.col("length") <= most).select("path", T.doc_type(F.col("path")).alias("doc_type"), "content")
    names = {"table": "Table", "pdf": "PDF", "image": "Image"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, kind, content in zip(b.column("path").to_pylist(), b.column("doc_type").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                try:
                    if kind in readers:
                        got, error = list(readers[kind](data)), None
                    elif kind == "table":
                        got, error = _table(where, data), None
                    elif kind in ("pdf", "image"):
                        raise LookupError(f"no reader for files of type {kind}")
                    else:
                        got, error = [data.decode("utf-8", "replace")], None
                except Exception as e:  # whatever a file does to its reader
                    got, error = [f"[{names.get(kind, 'File')} parsing failed] {where}"], f"{type(e).__name__}: {e}"
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([where] * n), pa.array([kind] * n), pa.array(range(n), pa.int32()), pa.array(got, pa.string()), pa.array([error] * n, pa.string())], ["path", "doc_type", "part", "text", "error"])

    texts = small.mapInArrow(run, "path string, doc_type string, part int, text string, error string")
    large = _files(spark, path).where(F.col("length") > most).select("path", T.doc_type(F.col("path")).alias("doc_type"), F.lit(0).alias("part"), F.concat(F.lit("[File parsing failed] "), "path").alias("text"), F.concat(F.lit("too large: "), F.col("length").cast("string")).alias("error"))
    return texts.unionByName(large).select("path", T.doc_id(F.col("path")).alias("doc_id"), "doc_type", "part", "text", "error")


def parse_documents(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, budget: int = 256, overlap: int = 1) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures): doc_id, path, doc_type, chunk_index, content, page, char_start, char_end; and path, doc_type, error.

    Failed files have no chunk. The index of chunks runs on over a file's texts.
    """
    parsed = durable(parse_files(spark, path, readers))
    good = parsed.where("error is null")
    about = good.groupBy("path").agg(F.first("doc_id").alias("doc_id"), F.first("doc_type").alias("doc_type"))
    pages = good.select(F.col("path"), F.col("part").cast("long").alias("page"), "text")
    ids = durable(about.select("path", "doc_id", "doc_type", F.xxhash64("path").alias("key")))
    chunks = chunk_pages(pages.join(ids.select("path", F.col("key").alias("doc_id")), "path").select("doc_id", "page", "text"), budget, overlap)
    out = chunks.withColumnRenamed("doc_id", "key").join(ids, "key").select("doc_id", "path", "doc_type", "chunk_index", "content", "page", "char_start", "char_end")
    return out, parsed.where("error is not null").select("path", "doc_type", "error")
