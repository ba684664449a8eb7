"""Delimited text by splits: equal to a reader that goes through the file character by character, wherever splits fall."""

import random

import pytest

from caseflow.sources import delimited, io


def plain(text: str, sep: str) -> list[list[str]]:
    rows, row, cell, quoted, raw, i = [], [], "", False, False, 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = raw = True
        elif c == sep:
            row, cell = [*row, cell], ""
        elif c == "\n":
            if row or cell or raw:
                rows.append([*row, cell])
            row, cell, raw = [], "", False
        else:
            cell += c
        i += 1
    if row or cell or raw:
        rows.append([*row, cell])
    return rows


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        cells = []
        for _ in range(r.randint(1, 4)):
            body = "".join(r.choice(["a", "bc", " x", "é", ",", "\n", '"', "5"]) for _ in range(r.randint(0, 6)))
            if r.random() < 0.6:
                body = '"' + body.replace('"', '""') + '"'
            else:
                body = "p" + body.replace(",", "").replace("\n", "")  # a quote within is text
            cells.append(body)
        out.append(",".join(cells))
        if r.random() < 0.1:
            out.append("")
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed,split", [(1, 97), (2, 211), (3, 10_000_000)])
def test_equal_to_a_plain_reader_at_any_split(spark, tmp_path, seed, split):
    text = text_of(seed, 150)
    (tmp_path / "x.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        if split < 1000:
            assert spark.read.text(f"file://{tmp_path}/x.csv").rdd.getNumPartitions() > 3
        got = [r.cells for r in io.read_delimited(spark, f"file://{tmp_path}/x.csv").orderBy("row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = plain(text, ",")
    wide = max(map(len, want))
    assert got == [r + [""] * (wide - len(r)) for r in want]


def test_a_record_over_several_splits(spark, tmp_path):
    long = "\n".join(f"line {i}, of one cell" for i in range(200))
    (tmp_path / "x.csv").write_text(f'﻿"a",b\n1,"{long}"\n2,c\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = delimited.records(spark, f"file://{tmp_path}/x.csv", ",").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in rows] == [(1, '"a",b'), (2, f'1,"{long}"'), (202, "2,c")]


def test_empty_unclosed_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert io.read_delimited(spark, f"file://{tmp_path}/a.csv").count() == 0
    (tmp_path / "b.csv").write_text('x,"open\nrest,y\n')
    (tmp_path / "c.csv").write_text("1,2\n")
    rows = io.read_delimited(spark, f"file://{tmp_path}").orderBy("row").collect()
    assert [r.cells[0] for r in rows] == ["x", "1"]  # an open quote ends with its file
    assert rows[1].cells[1] == "2"
