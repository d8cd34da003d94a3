"""Column types found from all values of all files together."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerops.sources import files as io
from ledgerops.sources import types


def table(spark, **columns):
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in columns))


@pytest.mark.parametrize("values, wanted", [
    (["1", "-20", "+3", " 007 "], "whole"),
    (["1", "2.5"], "number"),
    (["1e3", ".5", "5."], "number"),
    (["1", "NaN", "-inf"], "number"),
    (["9223372036854775807"], "whole"),
    (["9223372036854775808", "1"], "number"),
    (["true", "FALSE", " True "], "boolean"),
    (["true", "1"], "text"),
    (["2024-01-31", "2024-2-3"], "date"),
    (["2024-01-31", "2024-02-30"], "text"),
    (["2024-01-31", "2024-01-31 10:20:30.5"], "timestamp"),
    (["01/02/2024", "31/12/2023"], "date, day first"),
    (["01/02/2024", "12/31/2023"], "date, month first"),
    (["01/02/2024", "3-4-2024"], "date, day first"),
    (["31/12/2023", "12/31/2023"], "text"),
    (["31/02/2024"], "text"),
    (["1/2-2024"], "text"),
    (["01/02/2024", "2024-02-01"], "text"),
    (["12", "n/a"], "text"),
    (["", None, "  "], "text"),
    (["", None, "4"], "whole"),
    (["1,5"], "text"),
])
def test_type_of_a_column(spark, values, wanted):
    assert types.column_types(table(spark, c=values)) == {"c": wanted}
    assert types.column_types(table(spark, c=values[::-1]).repartition(3)) == {"c": wanted}


def test_no_rows_and_no_columns(spark):
    empty = table(spark, a=["1"], b=["x"]).limit(0)
    assert types.infer_types(empty).dtypes == [("a", "string"), ("b", "string")]
    assert types.column_types(empty, []) == {}


def test_odd_names_and_kept_columns(spark):
    df = spark.createDataFrame([("1", None, "3"), ("x", "2", "4")], "`a.b` string, `a b` string, `c0` string")
    typed = types.infer_types(df, rejected="a b")
    assert typed.dtypes == [("a.b", "bigint"), ("a b", "string"), ("c0", "bigint")]
    assert [tuple(r) for r in typed.collect()] == [(1, None, 3), (None, "2", 4)]
    assert types.infer_types(df).dtypes[1] == ("a b", "bigint")


def files(tmp_dir, *texts):
    paths = []
    for i, text in enumerate(texts):
        paths.append(os.path.join(tmp_dir, f"typed-{i}.csv"))
        with open(paths[-1], "w", newline="") as f:
            f.write(text)
    return paths


def test_one_schema_for_unlike_files(spark, tmp_dir):
    paths = files(tmp_dir, "id,paid,amount,memo,ok\n1,01/02/2024,10,5,true\n2,03/04/2024,,\"\",false\n",
                  "memo;amount;paid;id;ok\nx;2.5;25/12/2023;3;\n", 'id,paid,amount,memo,ok\n4,,7,"two\nlines",TRUE\n')
    df = io.load_files(spark, paths, fmt="csv", infer_schema=True)
    assert df.dtypes == [("id", "bigint"), ("paid", "date"), ("amount", "double"), ("memo", "string"), ("ok", "boolean")]
    assert sorted(map(tuple, df.collect())) == [
        (1, dt.date(2024, 2, 1), 10.0, "5", True), (2, dt.date(2024, 4, 3), None, "", False),
        (3, dt.date(2023, 12, 25), 2.5, "x", None), (4, None, 7.0, "two\nlines", True)]


def test_by_position_and_rejected_records(spark, tmp_dir):
    paths = files(tmp_dir, "a,b\n1,2\n", "a,b\n3,4.5\n")
    assert io.load_files(spark, paths, fmt="csv", by="position", infer_schema=True).dtypes == [("a", "bigint"), ("b", "double")]
    broken = files(tmp_dir, "a,b\n1,true\n3,4,5\n")
    df = io.read_csv(spark, broken, infer_schema=True, keep_rejected=True)
    assert df.dtypes == [("a", "bigint"), ("b", "boolean"), ("_rejected", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, True, None), (3, None, "3,4,5")]


def test_one_job_finds_the_types_of_all_columns(spark):
    df = table(spark, **{f"c{i}": [str(i), None] for i in range(40)})
    tracker, group = spark.sparkContext.statusTracker(), "types-of-forty-columns"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert set(types.column_types(df).values()) == {"whole"}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 2  # with adaptive execution a stage of its own is a job


ODD_TEXTS = ["0", "007", "+3", "-20", "+", "-", ".", "+-5", "9" * 18, "9" * 19, "9" * 20, "12\n", "1.5", ".5", "5.", "1e3", "123e-5", "12.34567",
             "1.2.2024", "12.11.2024", "13.12.2024", "12/13/2024", "13/13/2024", "31/12/2024", "31/2/2024", "29-2-2023", "29-2-2024", "30/2/2024",
             "0/1/2024", "1/0/2024", "00/01/2024", "1/2-2024", "01/02/0000", "5-6-2024\n", "1/2/24", "2024-1-2", "2024-02-30", "2024-2-29", "2024-01-02\n",
             "2024-1-2 3:04", "2024-01-02T03:04:05.123456", "2024-01-02 25:00", "2024-13-01 01:00", "NaN", "-inf", "+Infinity", "infinite", "true",
             "FALSE", "t", "x", "\u0661\u0662", "1\u00a0", "\t5", "5\t", "", "  ", None]


def possible_by_rule(c):
    """The types of a text from its whole pattern and its value, one after the other."""
    b = types.BIT
    day_first, month_first = (F.when(types._value(c, k).isNotNull(), b[k]).otherwise(0) for k in ("date, day first", "date, month first"))
    whole = c.rlike(r"^[+-]?[0-9]+\z") & c.try_cast("bigint").isNotNull()
    return (F.when(c.isNull(), None).when(c.startswith("\t"), 0)
            .when(c.rlike(types.NUMBER_TEXT) | c.rlike(types.SPECIAL_NUMBER_TEXT), b["number"] + F.when(whole, b["whole"]).otherwise(0))
            .when(c.rlike(types.SLASH_DATE_TEXT), day_first + month_first)
            .when(c.rlike(types.ISO_DATE_TEXT), F.when(c.try_cast("date").isNotNull(), b["date"] + b["timestamp"]).otherwise(0))
            .when(c.rlike(types.TIMESTAMP_TEXT), F.when(c.try_cast("timestamp_ntz").isNotNull(), b["timestamp"]).otherwise(0))
            .when(F.lower(c).isin("true", "false"), b["boolean"]).otherwise(0))


def test_types_of_odd_texts_and_of_every_day_and_month(spark):
    days = [f"{d}{sep}{m:02d}{sep}2023" for d in range(33) for m in range(14) for sep in "/-."]
    df = table(spark, c=ODD_TEXTS + days).select(types._trimmed(F.col("c")).alias("c"))
    unlike = df.select("c", types._possible(F.col("c")).alias("is"), possible_by_rule(F.col("c")).cast("long").alias("wanted"))
    assert unlike.where(~F.col("is").eqNullSafe(F.col("wanted"))).collect() == []


def test_each_text_is_tested_once(spark):
    """The aggregate names its argument three times; the patterns must stand in a projection below it."""
    plan = types._column_bits(table(spark, a=["1", "x"], b=["1/2/2024", None]), ["a", "b"])._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    assert any("RLIKE" in line for line in lines)
    assert [line for line in lines if "Aggregate" in line and "RLIKE" in line] == []


def test_first_records_sort_no_lines(spark, tmp_dir):
    paths = files(tmp_dir, "\ufeff\r\n \t\nid,a\n1,2\n", 'id,a\n1,"x\ny"\n', "\n\n")
    heads = io._heads(spark, paths)
    assert "SortAggregate" not in heads._jdf.queryExecution().executedPlan().toString()
    assert sorted((os.path.basename(r["file"]), r["head"]["value"], r["broken"]) for r in heads.collect()) == [
        ("typed-0.csv", "id,a", False), ("typed-1.csv", "id,a", True)]
