"""Clean pipeline on the mixed table (FIXTURES.md §4) and column profiles."""

import pytest

from ledgerops.operators import clean as cl
from ledgerops.operators import profile as pr

ROWS = [(1, "12/25/2024", "$1,234.56", "Yes", "a"),
        (2, "25/12/2024", "(100.00)", "N", "b"),
        (3, "2024-12-25", "n/a", "maybe", None)]
SCHEMA = "id long, trans_date string, amount string, active string, memo string"
SPECS = [
    cl.ColumnSpec("id", True, "Text"),
    cl.ColumnSpec("trans_date", True, "Date", "YYYY-MM-DD"),
    cl.ColumnSpec("amount", True, "Number", "0.00"),
    cl.ColumnSpec("active", True, "Boolean"),
    cl.ColumnSpec("memo", False, "Text"),
]


@pytest.fixture()
def mixed(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_pipeline_rows(mixed):
    out = cl.clean_table(mixed, SPECS)
    assert out.columns == ["id", "trans_date", "amount", "active"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "2024-12-25", 1234.56, True), (2, "2024-12-25", -100.0, False), (3, "2024-12-25", None, None)]


def test_pipeline_is_one_narrow_stage(mixed):
    plan = cl.clean_table(mixed, SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_no_included_column(mixed):
    with pytest.raises(ValueError):
        cl.clean_table(mixed, [cl.ColumnSpec("id", False)])


def test_failure_policy(mixed):
    bad = [cl.ColumnSpec("id", True, "Text"), cl.ColumnSpec("memo", True, "Currency")]
    with pytest.raises(ValueError):
        cl.clean_table(mixed, bad, on_error="raise")
    out = cl.clean_table(mixed, bad, on_error="skip")
    assert out.columns == ["id", "memo"]


def test_transform_column_and_select(mixed):
    out = cl.transform_column(mixed, "amount", "number")
    assert dict(out.dtypes)["amount"] == "double"
    assert cl.transform_column(mixed, "amount", "unknown").collect() == mixed.collect()
    assert dict(cl.transform_column(mixed, "id", "text").dtypes)["id"] == "string"
    assert cl.select_columns(mixed, ["memo", "id"]).columns == ["memo", "id"]


def test_role_detection(mixed):
    roles = pr.detect_roles(mixed.columns, pr.ROLE_PATTERNS)
    assert roles == {"date": "trans_date", "amount": "amount", "description": "memo"}
    assert pr.detect_roles(["x", "y"]) == {"date": "x", "amount": "y", "description": None}


def test_column_profile(mixed):
    rows = {r["column"]: r for r in pr.column_profile(mixed).collect()}
    assert rows["amount"]["number_share"] == pytest.approx(2 / 3)
    assert rows["trans_date"]["date_share"] == 1.0
    assert rows["active"]["bool_share"] == pytest.approx(2 / 3)
    assert rows["memo"]["non_null"] == 2 and rows["memo"]["rows"] == 3
    assert rows["trans_date"]["guessed_type"] == "Date" and rows["id"]["guessed_type"] == "Number"
    assert rows["id"]["type"] == "BIGINT"


def test_key_candidates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "y")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k long, s string")
    rows = {r["column"]: r for r in pr.key_candidates(a, b).collect()}
    assert (rows["k"]["a_nulls"], rows["k"]["a_distinct"], rows["k"]["a_keys_in_b"]) == (1, 2, 1)
    assert rows["k"]["a_key_share"] == 0.5 and rows["s"]["b_distinct"] == 2
