"""Reconcile: NULL and duplicate rows, layouts, invariants, plan shape (FIXTURES.md §2)."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerops.operators import reconciliation as rc
from ledgerops.plans import inputs as I

D = dt.date(2024, 1, 1)
A_ROWS = [(1, D, 10.0), (2, None, 10.0), (3, D, None), (4, None, 10.0), (None, D, 10.0), (5, D, 1.0), (5, D, 2.0)]
B_ROWS = [(1, D, 10.0), (2, D, 10.0), (3, D, 10.0), (4, D, 20.0), (None, D, 10.0), (5, D, 1.0), (5, D, 2.0)]
CFG = rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01)


@pytest.fixture()
def recon(spark):
    schema = "k long, d date, amt double"
    return rc.reconcile(spark.createDataFrame(A_ROWS, schema), spark.createDataFrame(B_ROWS, schema), CFG)


def test_null_and_duplicate_rows(recon):
    s = recon.summary().first().asDict()
    assert s["exact_matches"] == 3
    assert s["matches_with_date_note"] == 0
    assert s["amount_variances"] == 3
    assert s["missing_in_b"] == 1
    assert s["missing_in_a"] == 1
    assert s["unclassified"] == 2
    assert s["total_matched"] == 3 and s["total_unmatched"] == 5
    assert s["rows_a"] == 7 and s["rows_b"] == 7


def test_summary_equals_result_sets(recon):
    s = recon.summary().first()
    assert recon.exact_matches.count() == s["exact_matches"]
    assert recon.matches_with_date_note.count() == s["matches_with_date_note"]
    assert recon.amount_variances.count() == s["amount_variances"]
    assert recon.missing_in_b.count() == s["missing_in_b"]
    assert recon.missing_in_a.count() == s["missing_in_a"]
    assert recon.unclassified.count() == s["unclassified"]


def test_layouts(recon):
    assert recon.exact_matches.columns == list(rc.PAIR_COLUMNS)
    assert recon.matches_with_date_note.columns == [*rc.PAIR_COLUMNS, "note"]
    assert recon.amount_variances.columns == ["match_key", "date_a", "date_b", "amount_a", "amount_b",
                                              "variance", "description_a", "description_b"]
    assert recon.missing_in_b.columns == ["k", "d", "amt"]
    assert recon.missing_in_a.columns == ["k", "d", "amt"]
    row = recon.missing_in_b.first()
    assert row["k"] is None


def test_date_note_and_description(spark):
    a = spark.createDataFrame([(1, "2024-01-01", 5.0, "x")], "id long, when string, amount double, memo string")
    b = spark.createDataFrame([(1, "2024-01-02", 5.004, "y")], "id long, when string, amount double, memo string")
    cfg = rc.ReconConfig("id", rc.Roles("when", "amount", "memo"), rc.Roles("when", "amount"), 0.01)
    r = rc.reconcile(a, b, cfg)
    row = r.matches_with_date_note.first()
    assert row["note"] == "Date mismatch" and row["description_a"] == "x" and row["description_b"] is None


def test_text_amounts_are_refused_until_cleaned(spark):
    a = spark.createDataFrame([(1, "2024-01-01", "$5.00")], "k long, d string, amt string")
    with pytest.raises(TypeError):
        rc.reconcile(a, a, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.0))
    r = rc.reconcile_sources(a, a, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.0))
    assert r.summary().first()["exact_matches"] == 1


@pytest.mark.parametrize("kind, keys", [
    ("double", [1.0, 2.5, 3.0]), ("string", ["01", " 3.5", "3.0"]), ("decimal(10,1)", [1, 2.5, 3]), ("string", ["1", "x", "+3"])])
def test_unlike_key_types_meet(spark, kind, keys):
    a = spark.createDataFrame([(k, "d", 1.0) for k in (1, 2, 3)], "k long, d string, amt double")
    b = spark.createDataFrame([(str(k), "d", 1.0) for k in keys], "k string, d string, amt double").withColumn(
        "k", F.col("k").cast(kind))
    r = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt")))
    s = r.summary().first()
    assert (s["exact_matches"], s["missing_in_b"], s["missing_in_a"]) == (2, 1, 1)
    assert sorted(x["match_key"] for x in r.exact_matches.collect()) == [1, 3]
    back = rc.reconcile(b, a, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt")))
    assert back.summary().first()["exact_matches"] == 2 and back.exact_matches.schema["match_key"].dataType == b.schema["k"].dataType


NUMBER_TEXTS = ["1.5", " 2.5", "2.5", "-1.5", "0.49999999999999999", "1e3", "1.5e0", "+3", "2.4999", "1234.5e-1", "3.0", ".5", "-0.5",
                "9223372036854775807.4", "1.96", "123.45", "007"]


@pytest.mark.parametrize("kind", ["BIGINT", "INTEGER", "DECIMAL(10,1)", "DECIMAL(38,0)", "DOUBLE"])
def test_text_keys_against_numbers_as_the_ledger_sql_compares_them(spark, kind):
    """Every text against every value that any of them could round to, beside DuckDB's own comparison."""
    numbers = ["2", "3", "-2", "0", "1000", "1", "-1", "123", "7", "1.5", "2.5", "-1.5", "2.0", "1.9", "123.5", "123.45", "9223372036854775807"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS x", [NUMBER_TEXTS])
    con.execute(f"CREATE TABLE n AS SELECT DISTINCT v FROM (SELECT TRY_CAST(unnest(?::VARCHAR[]) AS {kind}) AS v) WHERE v IS NOT NULL", [numbers])
    want = con.execute(f"SELECT x, CAST(v AS VARCHAR) FROM t, n WHERE TRY_CAST(x AS {kind}) = v").fetchall()
    spark_kind = kind.lower()
    texts = spark.createDataFrame([(x, "d", 1.0) for x in NUMBER_TEXTS], "k string, d string, amt double")
    values = [r[0] for r in con.execute("SELECT CAST(v AS VARCHAR) FROM n").fetchall()]
    typed = spark.createDataFrame([(v, "d", 1.0, v) for v in values], "k string, d string, amt double, shown string").withColumn(
        "k", F.col("k").cast(spark_kind))
    cfg = rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt", "shown"))
    got = [(r["match_key"], r["description_b"]) for r in rc.reconcile(texts, typed, cfg).exact_matches.collect()]
    assert sorted(got) == sorted(want)


def test_decimal_keys_of_any_size(spark):
    big = Decimal("1234567890123456789012345678901")
    a = spark.createDataFrame([(big, "d", 1.0), (Decimal(5), "d", 1.0), (None, "d", 1.0)], "k decimal(38,0), d string, amt double")
    cfg = rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"))
    for kind, keys in (("long", [5, 6]), ("decimal(38,10)", [Decimal("5"), Decimal("5.5")]), ("decimal(5,2)", [Decimal("5"), Decimal("5.01")])):
        b = spark.createDataFrame([(k, "d", 1.0) for k in keys], f"k {kind}, d string, amt double")
        s = rc.reconcile(a, b, cfg).summary().first()
        assert (s["exact_matches"], s["missing_in_b"], s["missing_in_a"]) == (1, 2, 1), kind
        assert rc.reconcile(a, b, cfg).missing_in_b.count() == 2 and rc.reconcile(b, a, cfg).missing_in_b.count() == 1


def test_column_names_in_another_case(spark, recon):
    cfg = rc.ReconConfig("K", rc.Roles("D", "Amt"), rc.Roles("d", "AMT"), 0.01)
    assert rc.reconcile(recon.a, recon.b, cfg).summary().first() == recon.summary().first()


def test_summary_of_odd_amounts_equals_the_sets(spark):
    nan, inf = float("nan"), float("inf")
    odd = [0.0, -0.0, 0.01, 0.010000001, 1e300, 1e300, inf, -inf, nan, None, 1e18, 1e18 + 128, 5.0, 5.009999]
    a = spark.createDataFrame([(1, "x" if i % 2 else None, v) for i, v in enumerate(odd)], "k long, d string, amt double")
    b = spark.createDataFrame([(1, "x", v) for v in reversed(odd)], "k long, d string, amt double")
    for tol in (0.0, 0.01, 100.0, 1e-300, -1.0):
        r = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), tol))
        s = r.summary().first()
        assert (s["exact_matches"], s["matches_with_date_note"], s["amount_variances"], s["unclassified"]) == tuple(
            x.count() for x in (r.exact_matches, r.matches_with_date_note, r.amount_variances, r.unclassified)), tol


def test_invariants_on_ledgers(spark):
    sf = "/root/testdata/sf0.001"
    r = rc.reconcile(I.ledger_a(spark, sf), I.ledger_b(spark, sf), I.LEDGER_CONFIG)
    s = r.summary().first()
    # unique, non-NULL keys: every A row is in exactly one category
    assert (s["exact_matches"] + s["matches_with_date_note"] + s["amount_variances"]
            + s["unclassified"] + s["missing_in_b"]) == s["rows_a"]
    assert (s["exact_matches"] + s["matches_with_date_note"] + s["amount_variances"]
            + s["unclassified"] + s["missing_in_a"]) == s["rows_b"]
    assert (s["exact_matches"], s["matches_with_date_note"], s["amount_variances"],
            s["missing_in_b"], s["missing_in_a"]) == (1099, 110, 202, 89, 79)


def test_copies_are_counted_without_pairs(spark):
    """Many identical rows of one key: counted exactly as the product."""
    a = spark.range(300).select(F.lit(7).cast("long").alias("k"), F.lit("x").alias("d"), F.lit(1.0).alias("amt"))
    b = spark.range(200).select(F.lit(7).cast("long").alias("k"), F.lit("x").alias("d"), F.lit(1.0).alias("amt"))
    s = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.0)).summary().first()
    assert s["exact_matches"] == 300 * 200


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_join_for_matched_sets(recon):
    plan = recon.pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
    assert "BatchEvalPython" not in _plan(recon.summary())


def test_source_totals_raw_and_cleaned(spark):
    a = spark.createDataFrame([(1, "d", "10.5"), (2, "d", "$4.00"), (3, "d", None)], "k long, d string, amt string")
    b = spark.createDataFrame([(1, "d", "(2.5)")], "k long, d string, amt string")
    cfg = rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.0)
    raw = rc.source_totals(a, b, cfg).first()
    assert (raw["total_a"], raw["total_b"]) == (10.5, None)
    ca, cb = rc.clean_sources(a, b, cfg)
    cleaned = rc.reconcile(ca, cb, cfg).source_totals().first()
    assert (cleaned["total_a"], cleaned["total_b"]) == (14.5, -2.5)
