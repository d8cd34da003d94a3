"""Stacking, grouping, sorting and totals (FIXTURES.md §5)."""

import pytest

from ledgerops.operators import aggregation as agg


def _month(spark, rows):
    return spark.createDataFrame(rows, "category string, amount double")


@pytest.fixture()
def months(spark):
    # Electronics 45 / 12500.00, Clothing 32 / 8750.50, Food 89 / 3200.00 over three files.
    jan = [("Electronics", 250.0)] * 20 + [("Clothing", 250.0)] * 10 + [("Food", 35.0)] * 30
    feb = [("Electronics", 250.0)] * 24 + [("Clothing", 250.0)] * 21 + [("Food", 35.0)] * 58
    mar = [("Electronics", 1500.0), ("Clothing", 1000.5), ("Food", 120.0)]
    return [_month(spark, jan), _month(spark, feb), _month(spark, mar)]


def test_aggregate_tool_sample(months):
    res = agg.aggregate_tables(months, "category", "amount")
    rows = [(r["category"], r["record_count"], r["total_amount"]) for r in res.groups.collect()]
    assert rows == [("Electronics", 45, 12500.0), ("Clothing", 32, 8750.5), ("Food", 89, 3200.0)]
    t = res.totals.first()
    assert (t["row_count"], t["total_records"], t["grand_total"]) == (3, 166, 24450.5)


def test_aggregate_tool_materialized(months):
    res = agg.aggregate_tables(months, "category", "amount", materialize=True)
    assert [r["category"] for r in res.groups.collect()] == ["Electronics", "Clothing", "Food"]
    assert res.totals.first()["grand_total"] == 24450.5
    assert "Union" not in res.totals._jdf.queryExecution().optimizedPlan().toString()


def test_sort_choices(months):
    combined = agg.union_all(months)
    by_count = [r[0] for r in agg.aggregate(combined, ["category"], "amount", agg.SORT_BY_COUNT).collect()]
    by_group = [r[0] for r in agg.aggregate(combined, ["category"], "amount", agg.SORT_BY_GROUP).collect()]
    assert by_count == ["Food", "Electronics", "Clothing"]
    assert by_group == ["Clothing", "Electronics", "Food"]


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([("1", "x")], "n string, s string")
    b = spark.createDataFrame([("y", "2")], "s string, n string")
    assert [tuple(r) for r in agg.union_all([a, b]).collect()] == [("1", "x"), ("2", "y")]
    assert [tuple(r) for r in agg.union_all([a, b], by="position").collect()] == [("1", "x"), ("y", "2")]


def test_union_schema_errors(spark):
    a = spark.createDataFrame([("1", "x")], "n string, s string")
    missing = spark.createDataFrame([("1",)], "n string")
    extra = spark.createDataFrame([("1", "x", 1)], "n string, s string, z int")
    with pytest.raises(ValueError, match="missing=\\['s'\\]"):
        agg.union_all([a, missing])
    with pytest.raises(ValueError, match="extra=\\['z'\\]"):
        agg.union_all([a, extra])
    with pytest.raises(ValueError):
        agg.union_all([])


def test_null_group_is_last_ascending(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 2.0), ("a", 3.0), (None, 4.0)], "g string, v double")
    rows = agg.aggregate(df, ["g"], "v", agg.SORT_BY_GROUP).collect()
    assert [r["g"] for r in rows] == ["a", "b", None]
    assert rows[-1]["record_count"] == 2 and rows[-1]["total_amount"] == 6.0


def test_group_columns_dedupe():
    assert agg.group_columns("a", ["b", "a", "c", "b"]) == ["a", "b", "c"]


def test_sum_needs_numbers(spark):
    df = spark.createDataFrame([("a", "1")], "g string, v string")
    with pytest.raises(TypeError):
        agg.aggregate(df, ["g"], "v")


def test_top_groups_tie_break(spark):
    df = spark.createDataFrame([("c", 5.0), ("a", 5.0), ("b", 5.0), ("d", 1.0)], "g string, v double")
    grouped = agg.aggregate(df, ["g"], "v", sort_by=None)
    assert [r["g"] for r in agg.top_groups(grouped, 2).collect()] == ["a", "b"]


def test_caller_order_and_empty_totals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "y", 2.0)], "g string, h string, v double")
    rows = agg.aggregate(df, ["h", "g"], "v", [("h", "desc"), ("total_amount", "asc")]).collect()
    assert [r["g"] for r in rows] == ["c", "a", "b"]
    empty = agg.grand_total(agg.aggregate(df.where("v > 10"), ["g"], "v", sort_by=None)).first()
    assert (empty["row_count"], empty["total_records"], empty["grand_total"]) == (0, 0, None)


def test_places_without_one_task(spark):
    """Every row's place over many range partitions, ties in the order of the sort, no single-partition exchange."""
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 7919 % 613 as total_amount")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the partitions of the sort
    try:
        placed = agg.with_place(rows.orderBy("total_amount", "id"))
        plan = placed._jdf.queryExecution().executedPlan().toString()
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    want = sorted((i * 7919 % 613, i) for i in range(5000))
    assert [(r["total_amount"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 5001))
    assert "SinglePartition" not in plan and "Window" not in plan
    assert placed.columns == ["id", "total_amount", "place"]


def test_places_of_no_rows(spark):
    assert agg.with_place(spark.createDataFrame([], "a long").orderBy("a")).collect() == []
