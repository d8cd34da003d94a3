"""Predicates, combine modes and the analyze tool (FIXTURES.md §6)."""

import pytest

from ledgerops.operators import analysis as an
from ledgerops.operators import filters as fl

ROWS = [
    (150.0, "2024-01-10", "refund for order"),
    (600.0, "2024-02-01", "Refund big"),
    (None, None, None),
    (300.0, "2024-05-01", "50%_off sale"),
    (50.0, "2024-03-31", "path a\\b"),
    (100.0, "2023-12-31", "500 off sale"),
]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "amount double, date string, description string") \
        .selectExpr("amount", "CAST(date AS DATE) AS date", "description")


def _descr(frame):
    return sorted(r["description"] for r in frame.collect())


def test_between_inclusive_and_nulls(df):
    out = fl.filter_rows(df, [fl.FilterRange("amount", "amount", "100", "300")])
    assert sorted(r["amount"] for r in out.collect()) == [100.0, 150.0, 300.0]


def test_date_range_with_text_bounds(df):
    out = fl.filter_rows(df, [fl.FilterRange("date", "date", "2024-01-01", "2024-03-31")])
    assert _descr(out) == ["Refund big", "path a\\b", "refund for order"]


def test_contains_is_case_sensitive(df):
    out = fl.filter_rows(df, [fl.FilterRange("text", "description", "refund")])
    assert _descr(out) == ["refund for order"]


def test_contains_keeps_wildcards(df):
    out = fl.filter_rows(df, [{"column": "description", "operator": "contains", "value": "50%_off"}])
    assert _descr(out) == ["50%_off sale", "500 off sale"]


def test_contains_backslash_is_literal(df):
    out = fl.filter_rows(df, [{"column": "description", "operator": "contains", "value": "a\\b"}])
    assert _descr(out) == ["path a\\b"]


def test_comparisons(df):
    def n(op, v):
        return fl.filter_rows(df, [{"column": "amount", "operator": op, "value": v}]).count()
    assert (n("gt", 150.0), n("gte", 150.0), n("lt", 150.0), n("lte", 150.0), n("equals", 150.0)) == (2, 3, 2, 3, 1)
    assert fl.filter_rows(df, [{"column": "amount", "value": 600.0}]).count() == 1


def test_and_subset_of_or(df):
    conds = [fl.FilterRange("amount", "amount", "100", "600"), fl.FilterRange("text", "description", "sale")]
    and_rows = set(fl.filter_rows(df, conds, "AND").collect())
    or_rows = set(fl.filter_rows(df, conds, "OR").collect())
    assert and_rows <= or_rows
    assert len(and_rows) == 2 and len(or_rows) == 4


def test_no_filters_keeps_all(df):
    assert fl.filter_rows(df, []).count() == len(ROWS)


def test_unknown_operator_raises(df):
    with pytest.raises(ValueError):
        fl.filter_rows(df, [{"column": "amount", "operator": "near", "value": 1}])


def test_type_checks(df):
    with pytest.raises(TypeError):
        fl.filter_rows(df, [{"column": "amount", "operator": "contains", "value": "1"}])
    with pytest.raises(TypeError):
        fl.filter_rows(df, [{"column": "description", "operator": "between", "value": [1.0, 2.0]}])


def test_stats_over_empty_result(df):
    res = an.analyze(df, [fl.FilterRange("amount", "amount", "1e9", "2e9")], "amount")
    row = res.stats.first()
    assert row["count"] == 0 and row["total"] is None and row["average"] is None
    assert row["minimum"] is None and row["maximum"] is None


def test_stats_values(df):
    row = an.column_stats(df, "amount").first()
    assert row["count"] == 6  # COUNT(*), NULL row included
    assert row["total"] == 1200.0 and row["minimum"] == 50.0 and row["maximum"] == 600.0
    assert row["average"] == 240.0


def test_stats_need_numbers(df):
    with pytest.raises(TypeError):
        an.column_stats(df, "description")
    assert an.analyze(df, [], "description").stats is None


def test_safe_total(spark):
    df = spark.createDataFrame([("1.5", "x"), ("abc", "2"), (None, "3.5")], "a string, b string")
    row = an.safe_total(df, ["a", "b"]).first()
    assert row["a_total"] == 1.5 and row["b_total"] == 5.5
