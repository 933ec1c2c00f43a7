"""Spreadsheets, with the standard library alone, from any storage that Spark reads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .container import StoredFile

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(c) - 64
    return n - 1


def _member(zf: zipfile.ZipFile, sheet: str | None) -> str:
    book = ElementTree.fromstring(zf.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(zf.read("xl/_rels/workbook.xml.rels"))}
    for s in book.iter(f"{_MAIN}sheet"):
        if sheet is None or s.get("name") == sheet:
            target = targets[s.get(f"{_REL}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"there is no sheet named {sheet}")


def sheet_rows(file, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cached values of a sheet, row by row, as text; empty rows are left out. ``file`` is open for reading and seeking."""
    with zipfile.ZipFile(file) as zf:
        shared = [_text(si) for si in ElementTree.fromstring(zf.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in zf.namelist() else []
        with zf.open(_member(zf, sheet)) as f:
            table = None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    table = node if node.tag == f"{_MAIN}sheetData" else table
                    continue
                if node.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for c in node.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        row[at] = _text(c)
                    elif value is not None and value.text is not None:
                        row[at] = shared[int(value.text)] if kind == "s" else ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else value.text
                if any(v is not None for v in row):
                    yield row
                table.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet by the names in its first row, with ``file_ord``. One task parses a workbook, of which it holds the compressed bytes, shared texts and a row."""
    with io.BufferedReader(StoredFile(spark, path), 1 << 16) as f:
        header = next(sheet_rows(f, sheet), [])
    names = [(h or f"column {k + 1}").strip() for k, h in enumerate(header)]
    width = len(names)
    schema = StructType([StructField("file_ord", LongType()), StructField("cells", ArrayType(StringType()))])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = sheet_rows(pa.BufferReader(content.as_buffer()), sheet)
                next(rows, None)
                held: list[tuple[int, list]] = []
                for k, row in enumerate(rows):
                    row = (row + [None] * width)[:width]
                    if any(v is not None for v in row):
                        held.append((k, row))
                    if len(held) == 4096:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    return cells.select("file_ord", *(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))


def _batch(rows: list[tuple[int, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.list_(pa.string()))], names=["file_ord", "cells"])
