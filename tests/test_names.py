"""Column names with spaces and dots work in every tool."""

import os

from ledgerops.operators import aggregation as agg
from ledgerops.operators import analysis as an
from ledgerops.operators import clean as cl
from ledgerops.operators import filters as fl
from ledgerops.operators import profile as pr
from ledgerops.operators import reconciliation as rc
from ledgerops.sources import files as io
from ledgerops.sources import inspect as ins

SCHEMA = "`ref no` long, `trans.date` string, `amount usd` string, `memo.txt` string"
A = [(1, "01/02/2024", "$10.00", "x"), (2, "01/02/2024", "(5.00)", "y"), (3, "01/02/2024", "1", "y")]
B = [(1, "2024-02-01", "$10.00", "x"), (2, "2024-02-02", "-5", "y")]


def test_reconcile_with_odd_names(spark):
    a, b = spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)
    cfg = rc.ReconConfig("ref no", rc.Roles("trans.date", "amount usd", "memo.txt"), rc.Roles("trans.date", "amount usd", "memo.txt"), 0.01)
    s = rc.reconcile_sources(a, b, cfg).summary().first()
    assert (s["exact_matches"], s["matches_with_date_note"], s["missing_in_b"]) == (1, 1, 1)
    assert rc.reconcile_sources(a, b, cfg).missing_in_b.columns == ["ref no", "trans.date", "amount usd", "memo.txt"]


def test_other_tools_with_odd_names(spark, tmp_dir):
    df = spark.createDataFrame(A, SCHEMA)
    specs = [cl.ColumnSpec("ref no"), cl.ColumnSpec("trans.date", True, "Date", "DD-MMM-YYYY"),
             cl.ColumnSpec("amount usd", True, "Number", "0.00"), cl.ColumnSpec("memo.txt", True, "Text")]
    clean = cl.clean_table(df, specs)
    assert [r["amount usd"] for r in clean.orderBy("`ref no`").collect()] == [10.0, -5.0, 1.0]
    groups = agg.aggregate(clean, ["memo.txt"], "amount usd", agg.SORT_BY_GROUP).collect()
    assert [(r["memo.txt"], r["total_amount"]) for r in groups] == [("x", 10.0), ("y", -4.0)]
    kept = fl.filter_rows(clean, [fl.FilterRange("text", "memo.txt", "y"), fl.FilterRange("amount", "amount usd", 0, 5)], "AND")
    assert kept.count() == 1
    assert an.column_stats(clean, "amount usd").first()["total"] == 6.0
    assert an.safe_total(df, ["amount usd"]).first()["amount usd_total"] == 1.0
    assert len(pr.column_profile(df).collect()) == 4
    assert ins.preview(df, 1, ["memo.txt"], order_by=["`ref no`"]).first()[0] == "x"
    io.write_csv(clean, os.path.join(tmp_dir, "odd"))
    assert io.read_csv(spark, os.path.join(tmp_dir, "odd")).columns == clean.columns
    stacked = agg.union_all([df, df.select(*reversed([f"`{c}`" for c in df.columns]))])
    assert stacked.count() == 6
