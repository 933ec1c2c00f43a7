"""Quoted text read in splits equals the standard library's reader over the whole file."""

import csv
import random

import pytest

from chronotaxa.sources.delimited import read_delimited
from chronotaxa.sources.quoted import ends_inside, read_quoted


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for k, v in zip(keys, ("97", "1", "1")):
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def wild(seed, n, delimiter=","):
    rng = random.Random(seed)
    parts = ["a", "é", "日本", '"', '""', delimiter, "\n", "\r\n", " ", '"x"y', f'"a{delimiter}b"', '"two\nlines"', '"q""q"', "Smith", '"\n\n"', "O'Hara", "'", '"long ' + "line\n" * 40 + '"']
    return "".join(rng.choice(parts) for _ in range(n))


def sequential(path, delimiter=",", encoding="utf-8-sig"):
    with open(path, encoding=encoding, newline="") as f:
        return [r for r in csv.reader(f, delimiter=delimiter) if r]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_records_equal_the_sequential_reader(spark, tmp_path, small_splits, seed, delimiter):
    path = tmp_path / "a.csv"
    path.write_bytes(("﻿" + wild(seed, 700, delimiter)).encode())
    df = read_quoted(spark, str(path), delimiter, "utf-8", '"')
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 10
    assert [r.cells for r in df.orderBy("file_ord").collect()] == sequential(path, delimiter)


def test_a_cell_over_many_splits_and_an_open_end(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text('h,i\n1,"' + "x\n" * 500 + '"\n2,"tail, "\n3,"never closed\n' + "y\n" * 300)
    got = [r.cells for r in read_quoted(spark, str(path), ",", "utf-8", '"').orderBy("file_ord").collect()]
    assert got == sequential(path) and len(got) == 4


def test_lines_as_functions():
    rng = random.Random(3)
    for _ in range(400):
        text = wild(rng.randrange(10**6), 12).replace("\r\n", "\n")
        inside = False
        for line in text.splitlines(keepends=True):
            inside = ends_inside(line, inside, ",", '"')
        closed = list(csv.reader((text + "\n").splitlines(keepends=True) + ["MARK\n"]))
        assert inside == (closed[-1] != ["MARK"]), text


def test_read_delimited_with_broken_cells(spark, tmp_path, small_splits):
    rows = [("name", "author", "note", "name"), ("Aus bus", '"L." Smith', "two\nlines", "z"), ("Aus cus", "", 'a "b" c', "y"), ("Aus dus",), ("Aus eus", "x", "y", "z", "surplus")]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)
        f.write('Aus fus,"Jones"y,n,v\n')
    df = read_delimited(spark, str(path))
    assert df.columns == ["name", "author", "note", "file_ord"]
    got = [(r.name, r.author, r.note) for r in df.orderBy("file_ord").collect()]
    assert got == [("z", '"L." Smith', "two\nlines"), ("y", None, 'a "b" c'), (None, None, None), ("z", "x", "y"), ("v", "Jonesy", "n")]
    named = read_delimited(spark, str(path), columns=["a", "b"], skip=1).orderBy("file_ord").collect()
    assert [(r.a, r.b) for r in named][:2] == [("Aus bus", '"L." Smith'), ("Aus cus", None)] and len(named) == 5


@pytest.mark.parametrize("encoding", ["latin-1", "big5", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    text = 'a,b\n"é\nx",1\n' if encoding != "big5" else 'a,b\n"許功蓋\n|x",1\n'
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    rows = read_delimited(spark, str(path), encoding=encoding).collect()
    assert [(r.a, r.b) for r in rows] == [(text.split('"')[1], "1")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "a.csv"), ",", "utf-8", '"').count() == 0
