"""Quoted text in splits, though cells may hold line breaks.

Whether a line begins inside a quoted cell depends on all lines before it. Seen from a split alone there are two cases, so each split says where
either would end; a scan over the splits' answers, one row each, tells how each truly begins, and then each is parsed from there. A record
that goes on in other splits is put together from its parts afterwards.

Quoting is read as the standard library's reader does: a quote opens a cell only at its beginning, two in a quoted cell are
one, and what follows a closing quote is kept (``"x"y`` is ``xy``).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import cut

#: Encodings in which no byte of another character equals a line break.
SPLITTABLE = ("utf-8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "latin1", "cp1252", "windows-1252", "big5", "gbk", "gb18030", "shift_jis", "euc-jp", "euc-kr")

_ENDS = pa.schema({"file": pa.string(), "block": pa.int64(), "from_out": pa.bool_(), "from_in": pa.bool_()})
_PARTS = pa.schema({"number": pa.int64(), "at": pa.int64(), "cells": pa.list_(pa.string()), "open": pa.string(), "kind": pa.int32()})
_RECORD, _HEAD, _TAIL, _MIDDLE = range(4)


def ends_inside(line: str, inside: bool, delimiter: str, quote: str) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one."""
    if not quote or quote not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line.startswith(quote, at):
                inside, at = True, at + 1
            elif (to := line.find(delimiter, at)) < 0:
                return False
            else:
                at = to + 1
        elif (to := line.find(quote, at)) < 0:
            return True
        elif line.startswith(quote, to + 1):
            at = to + 2
        elif (to := line.find(delimiter, to + 1)) < 0:
            return False
        else:
            inside, at = False, to + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, raw): lines as bytes, in the order of the file within each split."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("raw"))


def _decoded(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, split), physical line with its end); single carriage returns end lines too. A row may hold several lines."""
    for batch in batches:
        for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "raw"))):
            for one in raw.split(b"\n"):
                line = one.decode(encoding, "replace") + "\n"
                for part in io.StringIO(line, newline="") if "\r" in line[:-2] else (line,):
                    yield (file, block), part


def ranges(lines: DataFrame, encoding: str, delimiter: str, quote: str) -> DataFrame:
    """(file, block, number, inside): the splits in order, and whether each begins inside a quoted cell."""

    def run(batches):
        key, state = None, None
        for here, line in _decoded(batches, encoding):
            if here != key:
                if key is not None:
                    yield _row(_ENDS, *key, *state)
                key, state = here, [False, True]
            state = [ends_inside(line, s, delimiter, quote) for s in state] if state[0] != state[1] else [ends_inside(line, state[0], delimiter, quote)] * 2
        if key is not None:
            yield _row(_ENDS, *key, *state)

    found = cut(lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A split either says how it ends whatever it began with, or turns both cases round, or leaves them as they are.
    same, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    one = found.withColumns({"sure": F.when(same, F.col("from_out")), "turns": F.when(turns, 1).otherwise(0)}).withColumn("total", F.sum("turns").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("sure").isNotNull(), F.struct("sure", "total")), True).over(before)
    total = F.coalesce(F.sum("turns").over(before), F.lit(0))
    odd = (total - F.coalesce(last["total"], F.lit(0))) % 2 == 1
    one = one.withColumn("inside", F.coalesce(last["sure"], F.lit(False)) != odd)
    return one.select("file", "block", "inside")


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def parsed(lines: list[str], delimiter: str, quote: str) -> Iterator[list[str]]:
    """Records of whole lines; blank lines are none."""
    csv.field_size_limit(2**31 - 1)
    how = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    return (r for r in csv.reader(iter(lines), delimiter=delimiter, **how) if r)


def _parse(lines: DataFrame, states: dict[tuple[str, int], tuple[int, bool]], encoding: str, delimiter: str, quote: str) -> DataFrame:
    """(number, at, cells, open, kind): records of each split, and the text of those that begin or end elsewhere."""
    held = lines.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        for number, begun_inside, split in _splits(_decoded(batches, encoding), held.value):
            at, pending, inside, first = 0, [], begun_inside, begun_inside
            ready: list[str] = []
            for line in split:
                if number == 0 and at == 0 and not pending and not ready:
                    line = line.removeprefix("﻿")
                pending.append(line)
                inside = ends_inside(line, inside, delimiter, quote)
                if inside:
                    continue
                if first:  # the record that another split began
                    yield _batch([(number, -1, None, "".join(pending), _TAIL)])
                    first = False
                else:
                    ready += pending
                pending = []
                if len(ready) >= 4096:
                    rows = [(number, at + k, r, None, _RECORD) for k, r in enumerate(parsed(ready, delimiter, quote))]
                    at, ready = at + len(rows), []
                    yield _batch(rows)
            rows = [(number, at + k, r, None, _RECORD) for k, r in enumerate(parsed(ready, delimiter, quote))]
            at += len(rows)
            if pending:
                rows.append((number, at if not first else -1, None, "".join(pending), _MIDDLE if first else _HEAD))
            yield _batch(rows)

    return lines.mapInArrow(run, "number long, at long, cells array<string>, open string, kind int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)


def _splits(lines: Iterator[tuple[tuple[str, int], str]], states: dict) -> Iterator[tuple[int, bool, Iterator[str]]]:
    from itertools import groupby

    for key, group in groupby(lines, key=lambda x: x[0]):
        yield *states[key], (line for _, line in group)


def read_quoted(spark: SparkSession, path: str, delimiter: str, encoding: str, quote: str) -> DataFrame:
    """(file_ord, cells): all records of delimited text, a header among them. Places rise in the order of the file; they leave gaps."""
    return read_lines(_lines(spark, path), delimiter, encoding, quote)


def read_lines(lines: DataFrame, delimiter: str, encoding: str, quote: str) -> DataFrame:
    """As ``read_quoted``, from lines (file, block, raw) as they lie in their splits. Without a ``quote`` quotes are text.

    The driver sees one row for each split.
    """
    order = ranges(lines, encoding, delimiter, quote).orderBy("file", "block").collect()
    parts = cut(_parse(lines, {(r["file"], r["block"]): (k, r["inside"]) for k, r in enumerate(order)}, encoding, delimiter, quote))
    whole = parts.where(F.col("kind") == _RECORD).select("number", "at", "cells")
    broken = parts.where(F.col("kind") != _RECORD)
    # Parts belong to the last record that was begun before them, or where they are.
    begun = F.last(F.when(F.col("kind") == _HEAD, F.struct("number", "at")), True).over(Window.orderBy("number", "at").rowsBetween(Window.unboundedPreceding, 0))
    joined = broken.withColumn("of", begun).groupBy("of").agg(F.array_sort(F.collect_list(F.struct("number", "at", "open"))).alias("texts"))
    joined = joined.select(F.col("of.number").alias("number"), F.col("of.at").alias("at"), F.array_join(F.col("texts.open"), "").alias("text"))

    def run(batches):
        for batch in batches:
            for number, at, text in zip(*(batch.column(c).to_pylist() for c in ("number", "at", "text"))):
                yield _batch([(number, at, r, None, _RECORD) for r in parsed(list(io.StringIO(text, newline="")), delimiter, quote)])

    mended = joined.mapInArrow(run, "number long, at long, cells array<string>, open string, kind int").select("number", "at", "cells")
    return whole.unionByName(mended).select((F.shiftleft("number", 33) + F.col("at")).alias("file_ord"), "cells")
