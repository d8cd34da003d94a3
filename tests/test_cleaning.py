"""Literal-row tests for the column cleaners (values from FIXTURES.md §3)."""

import math

import pytest

from ledgerops.functions import cleaning as fc

AMOUNTS = [
    ("$1,234.56", 1234.56), ("n/a", None), ("(100.00)", -100.0), ("50%", 50.0),
    ("($1,234.56)", -1234.56), ("R100.00", 100.0), ("(-100)", 100.0), ("-€5", -5.0),
    ("1e5", 15.0), ("100-", None), ("1.234,56", 1.23456), (" (7.5) ", -7.5),
    ("1 234,56", 123456.0), ("1.2.3", None), ("$ (100)", 100.0), ("2024-01-05", None),
    ("(100) CR", 100.0), ("()", None), ("", None),
]

DATES = [  # raw, cleaned, formatted DD-MMM-YYYY (the values the ledger SQL gives)
    ("2024-01-15", "2024-01-15", "15-Jan-2024"),
    ("13/02/2024", "2024-02-13", "13-Feb-2024"),
    ("02/13/2024", "2024-02-13", "13-Feb-2024"),
    ("01/02/2024", "2024-02-01", "01-Feb-2024"),
    ("1/2/24", "24-02-01", "01-Feb-0024"),
    ("13/25/2024", "2024-25-13", None),
    ("2024/01/15", "15-01-20", "20-Jan-0015"),
    ("Jan 5, 2024", "Jan 5, 2024", None),
    ("a/b/c", "c-0b-0a", None),
    ("2024-01-15 10:00:00", "2024-01-15 10:00:00", "15-Jan-2024"),
    ("15/01/2024 10:30", "2024 10:30-01-15", None),
    ("31/02/2024", "2024-02-31", None),
    ("12.7/3/2024", "2024-03-12", "12-Mar-2024"),
    ("", "", None),
    ("abcd-ef-gh", "abcd-ef-gh", None),
]


def _one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_clean_amount_literals(spark):
    df = _one_col(spark, [a for a, _ in AMOUNTS])
    got = [r[0] for r in df.select(fc.clean_amount("v")).collect()]
    for (raw, want), value in zip(AMOUNTS, got):
        if want is None:
            assert value is None, raw
        else:
            assert math.isclose(value, want, rel_tol=0, abs_tol=1e-12), (raw, value)


def test_clean_amount_keeps_numbers(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "v double")
    expr = fc.clean_amount("v", df.schema["v"].dataType)
    assert [r[0] for r in df.select(expr).collect()] == [1.5, None]


def test_clean_amount_is_idempotent(spark):
    df = _one_col(spark, [a for a, _ in AMOUNTS])
    once = df.select(fc.clean_amount("v").alias("v"))
    twice = once.select(fc.clean_amount("v", once.schema["v"].dataType).alias("v"))
    assert once.collect() == twice.collect()


def test_clean_date_literals(spark):
    df = _one_col(spark, [d for d, _, _ in DATES])
    rows = df.select(fc.clean_date("v").alias("c")).select(
        "c", fc.format_date("c", "DD-MMM-YYYY").alias("f")).collect()
    for (raw, clean, formatted), row in zip(DATES, rows):
        assert row["c"] == clean, raw
        assert row["f"] == formatted, raw


def test_clean_date_on_date_column(spark):
    df = spark.sql("SELECT DATE'2024-03-05' AS d")
    assert df.select(fc.clean_date("d")).first()[0] == "2024-03-05"


def test_format_date_all_formats(spark):
    df = spark.sql("SELECT '2024-03-05' AS d")
    got = df.select(*[fc.format_date("d", f).alias(f) for f in fc.DATE_FORMATS] +
                    [fc.format_date("d", "nonsense").alias("x")]).first()
    assert list(got) == ["2024-03-05", "05/03/2024", "03/05/2024", "05-Mar-2024", "2024-03-05"]


def test_clean_boolean(spark):
    trues = ["true", "Yes", "Y", "1", "t", " YES "]
    falses = ["false", "No", "N", "0", "f"]
    nulls = ["maybe", "", None, "2"]
    df = _one_col(spark, trues + falses + nulls)
    got = [r[0] for r in df.select(fc.clean_boolean("v")).collect()]
    assert got == [True] * len(trues) + [False] * len(falses) + [None] * len(nulls)


@pytest.mark.parametrize("fmt,want", [("0.00", 1234.57), ("0", 1235.0), ("0.000", 1234.568),
                                      ("0.0000", 1234.5678)])
def test_format_number(spark, fmt, want):
    df = spark.createDataFrame([(1234.5678,)], "v double")
    assert df.select(fc.format_number("v", fc.precision_of(fmt))).first()[0] == want


def test_to_text_plain_doubles(spark):
    df = spark.createDataFrame([(12345678901.5,), (12345678901.0,), (1863.84,), (None,)], "v double")
    got = [r[0] for r in df.select(fc.to_text("v", df.schema["v"].dataType)).collect()]
    assert got == ["12345678901.5", "12345678901.0", "1863.84", None]


@pytest.mark.parametrize("value,digits,want", [(1.005, 2, 1.0), (2.675, 2, 2.68), (0.125, 2, 0.13),
                                               (-2.5, 0, -3.0), (1.5, 0, 2.0), (1234.5678, 3, 1234.568)])
def test_format_number_rounds_the_binary_value(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(fc.format_number("v", digits)).first()[0] == want


DATE_TEXTS = ["24-02-01", "15-01-20", "2024-1-5", "024-02-01", "2024-02-01 10:00:00", "2024-02-01T10:00",
              "2024-02-01abc", "  2024-02-01", "2024-02-01  ", "2024-13-01", "2024-02-30", "1-2-3",
              "2024/02/01", "20240201", "2024-02-01 x", "+2024-01-01", "2024-02-1", "2024 02 01",
              "2024.02.01", "2024-02/01", "2024-02-01 10:00", "2024-02-01 10", "2024-02-01T10:00:00.123",
              "2024-02-01 10:00:00+01", "2024-02-01 25:00:00", "2024-02-01 10:00:00.5",
              "2024-02-01  10:00", "2024-02-01T", "2024-02-01 BC", "2024-02-01 10:61:00", "\t2024-02-01",
              "2024-02-01\n", "Jan 5, 2024", "", "1998-10-03 00:00:00", "0024-02-29", "2023-02-29",
              "2024-01-01 00:00:07.179575", "2024-01-01 23:59:59.", "2024-01-01 23:59:60", "2024-01-01 24:00:00",
              "2024-01-01 12:60:00", "2024-02-30 10:00:00", "2024-01-01 10:00:00x", "2024-01-01 10:00:00.1.2",
              "2024-01-01 10:00:00 ", "2024-01-01 1a:00:00", "2024-01-01 10:00:00+05:30", "2024-01-01 09:05:03.000100",
              "2024-01-01 24:00:01", "2024-01-01 24:00", "2024-01-01 12:5", "2024-01-01 12:05:7", "2024-01-01 12:00:00Z",
              "2024-01-01 12:00:00+0530", "2024-01-01 12:00:00-08", "2024-01-01 12:00:00+5", "2024-01-01 24:00:00.1",
              "2024-01-01 12:00:00 UTC", "2024-01-01 12:00:00 America/New_York", "2024-01-01 12:00:00 Foo Bar",
              "2024-01-01 12:00:00 Foo!", "2024-01-01 12:00:00  UTC", "2024-01-01 12:00:00\tUTC",
              "2024-01-01 12:00:00+00 UTC", "2024-01-01 12:00:00.5 UTC", "2024-01-01 12:00 UTC", "2024-01-01 UTC",
              "2024-01-01T12:00:00 UTC", "2024-01-01 12:00:00 (UTC)", "2024-01-01 12:00:00 UTC+1"]


def test_format_date_matches_duckdb(spark):
    import duckdb
    con = duckdb.connect()
    want = [con.execute("SELECT strftime(TRY_CAST(? AS DATE), '%d-%b-%Y')", [t]).fetchone()[0] for t in DATE_TEXTS]
    df = _one_col(spark, DATE_TEXTS)
    got = [r[0] for r in df.select(fc.format_date("v", "DD-MMM-YYYY")).collect()]
    assert got == want


SLASH_TEXTS = ["12.7/13/2024", "12.4/13/2024", "13.0/1/2024", " 13/1/2024", "1e1/13/2024", "+13/02/2024",
               "-13/02/2024", "99999999999/13/2024", "a/b/c", "1/2/24", "13/25/2024", "02/13/2024",
               "2024/01/15", "15/01/2024 10:30", "12.5/3/2024", "1/2/3/4", "//", "5/ 13/2024"]


def test_clean_date_matches_duckdb(spark):
    import duckdb
    from ledgerops.plans.oracle_sql import date_sql
    con = duckdb.connect()
    want = [con.execute(f"SELECT {date_sql('t')} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in SLASH_TEXTS]
    got = [r[0] for r in _one_col(spark, SLASH_TEXTS).select(fc.clean_date("v")).collect()]
    assert got == want
