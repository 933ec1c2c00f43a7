"""Delimited text. A byte order mark, quoted line breaks and doubled quotes are read as written."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fieldmap import FieldMap
from .quoted import SPLITTABLE, read_quoted


def detect_format(path: str) -> str:
    """``xlsx`` or ``csv`` by the file name."""
    return "xlsx" if Path(path).suffix.lower() in (".xlsx", ".xlsm") else "csv"


def by_column(rows: DataFrame, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The quoted reader's records by column. Of columns with one name the last counts; missing and empty cells are null, surplus ones are dropped (Q21)."""
    first = None if columns is not None else rows.where(F.col("file_ord") < 1 << 33).orderBy("file_ord").first()
    if first is not None:
        rows = rows.where(F.col("file_ord") != first["file_ord"]) if header else rows
        columns = first["cells"] if header else [f"_c{k}" for k in range(len(first["cells"]))]
    places = {name: k for k, name in enumerate(columns or [])}
    return rows.select(*(F.nullif(F.get("cells", F.lit(k)), F.lit("")).alias(name) for name, k in places.items()), "file_ord")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", header: bool = True, quote: str = '"', columns: list[str] | None = None, skip: int = 0) -> DataFrame:
    """All columns as text, with ``file_ord``. With ``columns``, the file has no header of its own but ``skip`` leading lines.

    Text is read in splits, by Spark's reader where there are no quotes and else by one that follows quoted cells over line breaks (``quoted``). Only
    encodings whose line breaks cannot be told from other bytes, and folders of quoted files with headers, are read by one task a file.
    """
    encoding = encoding.lower().removesuffix("-sig")
    several = False
    if quote:
        lines = spark.read.option("lineSep", "\n").text(path)
        splittable = encoding in SPLITTABLE and len(delimiter) == len(quote) == 1
        several = not splittable or not lines.where(F.contains("value", F.lit(quote))).isEmpty()
        if several and splittable and (columns is not None or len(lines.inputFiles()) == 1):
            df = by_column(read_quoted(spark, path, delimiter, encoding, quote), header, columns)
            return df.where(F.col("file_ord") >= skip) if skip else df
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("multiLine", several).option("quote", quote).option("escape", quote or "\\").option("mode", "PERMISSIVE")
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if columns is not None:
        df = reader.option("header", False).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    else:
        df = reader.option("header", header).option("inferSchema", False).csv(path)
    df = df.withColumn("file_ord", F.monotonically_increasing_id())
    return df.where(F.col("file_ord") >= skip) if skip else df


def read_mapped(spark: SparkSession, path: str, fmap: FieldMap) -> DataFrame:
    """A mapped text or spreadsheet file as source rows."""
    from .xlsx import read_sheet

    if detect_format(path) == "xlsx":
        df = read_sheet(spark, path, fmap.sheet)
    else:
        df = read_delimited(spark, path, fmap.delimiter, fmap.encoding)
    return fmap.source_rows(df)
