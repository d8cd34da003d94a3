"""Plan shapes that the scale design depends on."""

from conftest import SF_SMALL

import __spark_entry__ as E
from ledgerops.operators import aggregation as agg
from ledgerops.plans import inputs as I


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_reduces_each_side_once(spark):
    """Each side is scanned and reduced in one place of the plan: either read once, or its exchange is reused."""
    plan = _executed(E.queries()["recon_summary"](spark, SF_SMALL))
    final = plan.split("== Initial Plan ==")[0]
    both = E.queries()["recon_exact"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert final.count("Scan parquet") - final.count("ReusedExchange") <= both.count("Scan parquet")
    assert "Join" not in final  # near pairs are counted, not joined


def test_no_plan_deals_rows_out_at_random(spark):
    """No round-robin shuffle in front of narrow work, whatever the number of input splits."""
    for name in ("recon_text_sources", "clean_amount", "clean_date", "format_date", "clean_pipeline", "column_profile"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in plan, name


def test_base_table_is_scanned_once(spark):
    path = f"{SF_SMALL}/lineitem.parquet"
    for name in ("union_all", "load_files", "aggregate_by_total", "aggregate_by_count", "aggregate_by_group"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert path not in plan, name  # only the parts are read; the table itself was read once to write them


def test_missing_rows_anti_join_distinct_keys(spark):
    df = E.queries()["recon_missing_in_b"](spark, SF_SMALL)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in optimized
    # the right side is the distinct key set of B, not B itself
    right = optimized.split("LeftAnti", 1)[1]
    assert "Aggregate [_other_key" in right


def test_top_k_does_not_sort_everything(spark):
    plan = E.queries()["top_groups"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_aggregation_is_partial_before_shuffle(spark):
    grouped = agg.aggregate(I.table(spark, SF_SMALL, "lineitem"), ["l_returnflag"], "l_quantity", sort_by=None)
    plan = _executed(grouped)
    assert "partial_sum" in plan and "partial_count" in plan


def test_date_range_filter_is_pushed(spark):
    plan = E.queries()["filter_date_range"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan


def test_key_candidates_scan_each_side_once(spark):
    plan = _executed(E.queries()["key_candidates"](spark, SF_SMALL))
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2
    assert final.count("FileScan") == 3  # A once, B (a union of two reads of orders) once
