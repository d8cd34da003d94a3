"""CSV round trip, export of the five result sets, inspection helpers."""

import glob
import os

from pyspark.sql import functions as F

from ledgerops.operators import reconciliation as rc
from ledgerops.sources import files as io
from ledgerops.sources import inspect as ins


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a,b", 12345678901.5, None), (2, 'q"x', 2.0, "")],
                               "id long, name string, amt double, note string")
    path = os.path.join(tmp_dir, "t")
    io.write_csv(df, path)
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(path, "part-*.csv"))))
    assert "12345678901.5" in text and '"q""x"' in text
    back = io.read_csv(spark, path)
    assert back.dtypes == [("id", "string"), ("name", "string"), ("amt", "string"), ("note", "string")]
    rows = sorted(tuple(r) for r in back.collect())
    assert rows[0][:3] == ("1", "a,b", "12345678901.5") and rows[0][3] is None
    assert rows[1][1] == 'q"x'


def test_load_files_reports_schema_mismatch(spark, tmp_dir):
    a = spark.createDataFrame([(1, "x")], "n long, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n long")
    c = spark.createDataFrame([(3,)], "n long")
    pa, pb, pc = (os.path.join(tmp_dir, x) for x in "abc")
    io.write_csv(a, pa)
    io.write_csv(b, pb)
    io.write_csv(c, pc)
    pa2 = os.path.join(tmp_dir, "a2")
    io.write_csv(a, pa2)
    stacked = io.load_files(spark, [pa, pb, pa2], fmt="csv")
    assert sorted(tuple(r) for r in stacked.collect()) == [("1", "x"), ("1", "x"), ("2", "y")]
    # files with the same header are read together: two scans for three files
    assert stacked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    try:
        io.load_files(spark, [pa, pc], fmt="csv")
        raise AssertionError("expected a schema error")
    except ValueError as exc:
        assert pc in str(exc) and "missing=['s']" in str(exc)


def test_export_results(spark, tmp_dir):
    schema = "k long, d string, amt double"
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, "x", 9.0), (4, "x", 1.0)], schema)
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (3, "x", 1.0), (5, "x", 1.0)], schema)
    r = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01))
    written = io.export_results(r, tmp_dir)
    assert sorted(os.path.basename(p) for p, _ in written.values()) == sorted(rc.RESULT_FILE_NAMES.values())
    for name, (path, rows) in written.items():
        back = io.read_csv(spark, path, header=True)
        assert back.count() == rows == 1, name
    assert io.result_path(tmp_dir, "other").endswith("/other.csv")


def test_schema_info_and_preview(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, s string")
    info = [tuple(r) for r in ins.schema_info(spark, df).collect()]
    assert info == [(0, "id", "BIGINT", True), (1, "s", "VARCHAR", True)]
    assert [r["id"] for r in ins.preview(df, 2, ["id"], order_by=["id"]).collect()] == [1, 2]
    assert ins.preview(df, 2).count() == 2
    assert ins.row_count(df) == 3 and ins.columns(df) == ["id", "s"]


def test_delimiter_is_detected(spark, tmp_dir):
    for sep, name in ((";", "semi"), ("\t", "tab"), ("|", "pipe"), (",", "comma")):
        path = os.path.join(tmp_dir, name + ".csv")
        with open(path, "w") as fh:
            fh.write(sep.join(['"a,b"', "amount", "date"]) + "\n" + sep.join(['"x,y"', '"1,5"', "2024-01-01"]) + "\n")
        df = io.read_csv(spark, path)
        assert df.columns == ["a,b", "amount", "date"], name
        assert df.first()["amount"] == "1,5"


def test_csv_text_of_dates_and_timestamps(spark, tmp_dir):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.1' AS ts, timestamp_ntz'2024-01-01 00:00:07' AS ts0, "
                   "DATE'2024-01-02' AS d, true AS b")
    path = os.path.join(tmp_dir, "ts")
    io.write_csv(df, path, single_file=True)
    text = "".join(open(f).read() for f in glob.glob(os.path.join(path, "part-*.csv")))
    assert text.splitlines() == ["ts,ts0,d,b", "2024-01-01 00:00:07.1,2024-01-01 00:00:07,2024-01-02,true"]


def test_scratch_paths_live_in_the_configured_checkpoint_folder(spark):
    from ledgerops.session import checkpoint_dir, scratch_path
    configured = spark.sparkContext.getCheckpointDir()
    assert configured and checkpoint_dir(spark) == configured
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(configured.rstrip("/") + "/x-") and first != second


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as fh:
        fh.write(text)
    return path


def test_line_breaks_padding_and_empty_texts_survive(spark, tmp_dir):
    rows = [(1, "line1\nline2", "  padded "), (2, "", None), (3, 'a "q", b\r\n;', "\t"), (4, None, "")]
    path = os.path.join(tmp_dir, "t")
    assert io.write_csv(spark.createDataFrame(rows, "id long, a string, b string"), path) == 4
    back = io.read_csv(spark, path)
    assert sorted((int(r["id"]), r["a"], r["b"]) for r in back.collect()) == rows


def test_ragged_rows_stop_the_read_or_stay_visible(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "r", "ragged.csv"), "ref,amount\n1,10\n2,20,EXTRA\n3\n")
    try:
        io.read_csv(spark, path).select("ref").collect()
        raise AssertionError("expected an error")
    except Exception as exc:  # noqa: BLE001 - Spark's own error class differs by version
        assert "MALFORMED" in str(exc).upper()
    rows = {r["ref"]: r for r in io.read_csv(spark, path, keep_rejected=True).collect()}
    assert rows["1"]["_rejected"] is None and rows["2"]["_rejected"] == "2,20,EXTRA" and rows["3"]["_rejected"] == "3"


def test_each_file_has_its_own_layout(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    _write(os.path.join(d, "a.csv"), "ref,amount\n1,10\n")
    _write(os.path.join(d, "b.csv"), "ref;amount\n3;30\n")
    _write(os.path.join(d, "c.csv"), "amount,ref\n20,2\n")
    _write(os.path.join(d, "d.csv"), "amount|ref\n'x'|\"4\n4\"\n")
    for df in (io.read_csv(spark, os.path.join(d, "*.csv")), io.read_csv(spark, d),
               io.load_files(spark, [os.path.join(d, f"{x}.csv") for x in "abcd"])):
        assert df.columns == ["ref", "amount"]
        assert sorted(map(tuple, df.collect())) == [("1", "10"), ("2", "20"), ("3", "30"), ("4\n4", "'x'")]


def test_a_file_without_a_header_keeps_its_first_row(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "h", "none.csv"), "1,2024-01-01,rent\n2,2024-01-02,fee\n")
    df = io.read_csv(spark, path)
    assert df.columns == ["column0", "column1", "column2"] and df.count() == 2
    assert io.read_csv(spark, path, header=True).count() == 1


def test_a_failed_set_is_an_error_that_names_it(spark, tmp_dir):
    schema = "k long, d string, amt double"
    a = spark.createDataFrame([(1, "x", 1.0), (4, "x", 1.0)], schema)
    r = rc.reconcile(a.withColumn("bad", F.array("k")), a,
                     rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt")))
    try:  # CSV cannot hold an array column, and that set has all of A's columns
        io.export_results(r, tmp_dir)
        raise AssertionError("expected an error")
    except io.ExportError as exc:
        assert set(exc.failed) == {"missing_in_b"} and len(exc.written) == 4 and "missing_in_b" in str(exc)


def test_blank_lines_before_the_header_and_empty_files(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "b", "blank.csv"), "\n\nref,amount\n\n1,10\n")
    _write(os.path.join(tmp_dir, "b", "empty.csv"), "")
    df = io.read_csv(spark, os.path.dirname(path))
    assert df.columns == ["ref", "amount"] and [tuple(r) for r in df.collect()] == [("1", "10")]
    none = io.read_csv(spark, os.path.join(tmp_dir, "b", "empty.csv"), schema="a string, b string")
    assert none.columns == ["a", "b"] and none.count() == 0
