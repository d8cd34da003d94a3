"""Layouts of many files, odd paths, and quoted line breaks that fall on block edges."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerops.sources import files as io

ROWS = [("1", 'a "quoted" word', "x\ny"), ("2", "plain", ""), ("3", "line one\r\nline two\n\nline four", "z"), ("4", ",;|", '"'), ("5", "\n", "end")]


def write(path, rows, header=("id", "memo", "note"), sep=",", eol="\r\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.writer(f, delimiter=sep, lineterminator=eol, quoting=csv.QUOTE_ALL)
        out.writerows(([header] if header else []) + list(rows))
    return path


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("folder", ["a b", "pct%41", "hash#1", "glob[1]{x}", "plus+ü", "q?*"])
def test_any_path(spark, tmp_dir, folder):
    base = os.path.join(tmp_dir, folder)
    write(os.path.join(base, "one file.csv"), ROWS)
    write(os.path.join(base, "two%20.csv"), [("9", "flat", "n")])
    given = io._literal([base])[0]  # a folder that is given is a glob, as in Spark's readers
    assert values(io.read_csv(spark, given)) == sorted([*ROWS, ("9", "flat", "n")])
    assert io.sniff_delimiter(spark, given + "/one file.csv") == ","
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    io.write_csv(df, os.path.join(base, "out %23"))
    assert values(io.read_csv(spark, given + "/out %23")) == [("1", "x")]


@pytest.mark.parametrize("block", [16, 33, 64, 1000])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_quoted_breaks_at_block_edges(spark, tmp_dir, block, eol):
    pick = random.Random(block)
    bits = ["a", '"', "\n", "\r\n", ",", " ", "\n\n", "long words here", '""', ""]
    rows = [(str(i), "".join(pick.choice(bits) for _ in range(pick.randint(0, 9))), pick.choice(["", "x", "\n"])) for i in range(60)]
    path = write(os.path.join(tmp_dir, "t", "a.csv"), rows, eol=eol)
    write(os.path.join(tmp_dir, "t", "b.csv"), [("x", "no\nheader", "1")], header=("note", "id", "memo"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = io.read_csv(spark, os.path.dirname(path))
        blocks = io._lines(spark, [path]).select("block").distinct().count()
        got = values(df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([*rows, ("no\nheader", "1", "x")])
    assert blocks > 1


def test_many_files_in_a_fixed_number_of_jobs(spark, tmp_dir):
    def jobs(n):
        base = os.path.join(tmp_dir, f"many{n}")
        for i in range(n):
            if i % 3:
                write(f"{base}/{i:04d}.csv", [(str(i), f"m{i}", "t")], sep=",;|"[i % 3])
            else:  # no header: every first record is another one
                write(f"{base}/{i:04d}.csv", [(str(i), f"m{i}", "t")], header=None)
        group = f"layouts-{n}"
        spark.sparkContext.setJobGroup(group, group)
        found = io.csv_layouts(spark, [base])
        spark.sparkContext.setJobGroup("", "")
        assert len(found) == n and {x.header for x in found.values()} == {True, False}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(9), jobs(500)
    assert many <= few + 2 and many < 12


def test_first_record_of_any_length(spark, tmp_dir):
    text = "\n".join(f"line {i}" for i in range(500))
    path = write(os.path.join(tmp_dir, "f", "a.csv"), [("1", text, "n"), ("2", "b", "c")], header=None)
    df = io.read_csv(spark, path)
    assert df.columns == ["column0", "column1", "column2"] and values(df) == [("1", text, "n"), ("2", "b", "c")]
    head = write(os.path.join(tmp_dir, "g", "a.csv"), [("1", "2", "3")], header=("id", "memo\nof two lines", "note"))
    assert io.read_csv(spark, head).columns == ["id", "memo\nof two lines", "note"]
    with open(os.path.join(tmp_dir, "bad.csv"), "w") as f:
        f.write('a,"never closed\n1,2\n')
    with pytest.raises(ValueError, match="bad.csv: the quote opened in the first record is not closed"):
        io.read_csv(spark, os.path.join(tmp_dir, "bad.csv"))


def test_blank_files_marks_and_rejected_records(spark, tmp_dir):
    base = os.path.join(tmp_dir, "h")
    os.makedirs(base)
    for name, body in {"a.csv": "", "b.csv": "\n \n", "c.csv": '﻿id,memo\r\n1,"x\r\ny"\r\n\r\n2,z\r\n3\r\n4,5,6\r\n'}.items():
        with open(os.path.join(base, name), "w", newline="", encoding="utf-8") as f:
            f.write(body)
    kept = io.read_csv(spark, base, keep_rejected=True)
    assert kept.columns == ["id", "memo", io.REJECTED]
    good = kept.where(F.col(io.REJECTED).isNull()).select("id", "memo")
    assert values(good) == [("1", "x\r\ny"), ("2", "z")]
    assert sorted(r[0] for r in kept.where(F.col(io.REJECTED).isNotNull()).select(io.REJECTED).collect()) == ["3", "4,5,6"]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        io.read_csv(spark, base).collect()
    typed = io.read_csv(spark, [os.path.join(write(os.path.join(tmp_dir, "k", "a.csv"), [("7", "1.5\n", "d")]))], schema="id int, memo string, note string")
    assert typed.dtypes == [("id", "int"), ("memo", "string"), ("note", "string")] and typed.first()["id"] == 7
