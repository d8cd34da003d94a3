"""Streaming: cleaned running totals over CSV files that arrive over time."""

import os

from ledgerops import streaming as st
from ledgerops.operators.clean import ColumnSpec
from ledgerops.sources import files as io

SCHEMA = "category string, amount string"
SPECS = [ColumnSpec("category", True, "Text"), ColumnSpec("amount", True, "Number")]


def _drop_file(spark, folder, name, rows):
    tmp = os.path.join(folder + "-staging", name)
    io.write_csv(spark.createDataFrame(rows, SCHEMA), tmp, single_file=True)
    part = [f for f in os.listdir(tmp) if f.startswith("part-")][0]
    os.makedirs(folder, exist_ok=True)
    os.replace(os.path.join(tmp, part), os.path.join(folder, f"{name}.csv"))


def test_running_totals_resume(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    out = os.path.join(tmp_dir, "totals")
    ckpt = os.path.join(tmp_dir, "ckpt")
    _drop_file(spark, inbox, "jan", [("Food", "$1,000.00"), ("Rent", "(50.00)")])
    _drop_file(spark, inbox, "feb", [("Food", "$25.50"), ("Food", "n/a")])

    def run():
        stream = st.clean_stream(st.file_stream(spark, inbox, SCHEMA, fmt="csv"), SPECS)
        totals = st.running_totals(stream, ["category"], "amount")
        st.run_available(totals, out, output_mode="complete", checkpoint_location=ckpt)
        return {r["category"]: (r["record_count"], r["total_amount"]) for r in spark.read.parquet(out).collect()}

    assert run() == {"Food": (3, 1025.5), "Rent": (1, -50.0)}
    _drop_file(spark, inbox, "mar", [("Rent", "$10.00")])
    assert run() == {"Food": (3, 1025.5), "Rent": (2, -40.0)}


def test_filter_stream_appends(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    out = os.path.join(tmp_dir, "kept")
    _drop_file(spark, inbox, "a", [("refund x", "1"), ("sale", "2")])
    kept = st.filter_stream(st.file_stream(spark, inbox, SCHEMA), [
        {"column": "category", "operator": "contains", "value": "refund"}])
    st.run_available(kept, out)
    assert [r["category"] for r in spark.read.parquet(out).collect()] == ["refund x"]
