"""The README flow: two CSV exports with different delimiters -> clean -> reconcile -> export."""

import os

from ledgerops import ReconConfig, Roles, reconcile_sources
from ledgerops.sources import export_results, read_csv


def test_csv_exports_reconcile_end_to_end(spark, tmp_dir):
    bank, ledger = os.path.join(tmp_dir, "bank"), os.path.join(tmp_dir, "ledger")
    os.makedirs(bank)
    os.makedirs(ledger)
    with open(os.path.join(bank, "jan.csv"), "w") as fh:
        fh.write('ref,date,amount,memo\n1,01/02/2024,"$1,000.00",rent\n2,05/02/2024,(50.00),fee\n3,07/02/2024,$20.00,x\n')
    with open(os.path.join(ledger, "jan.csv"), "w") as fh:
        fh.write("ref;posted;value\n1;2024-02-01;1000\n2;2024-02-06;-50\n4;2024-02-09;5\n")
    a, b = read_csv(spark, os.path.join(bank, "*.csv")), read_csv(spark, os.path.join(ledger, "*.csv"))
    cfg = ReconConfig("ref", a=Roles("date", "amount", "memo"), b=Roles("posted", "value"), amount_tolerance=0.01)
    recon = reconcile_sources(a, b, cfg)
    s = recon.summary().first()
    assert (s["exact_matches"], s["matches_with_date_note"], s["amount_variances"],
            s["missing_in_b"], s["missing_in_a"]) == (1, 1, 0, 1, 1)
    note = recon.matches_with_date_note.first()
    assert (note["match_key"], note["date_a"], note["date_b"], note["amount_a"]) == ("2", "2024-02-05", "2024-02-06", -50.0)
    written = export_results(recon, os.path.join(tmp_dir, "out"))
    assert len(written) == 5
    assert read_csv(spark, written["missing_in_a"][0], header=True).collect()[0]["ref"] == "4"
