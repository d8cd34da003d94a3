"""License scan on texts whose canonical form is known."""

from ledgerops.llm.licenses import KNOWN_LICENSES, canonical_lines, known_digests, known_licenses, scan_licenses
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

MIT = next(t for i, t in KNOWN_LICENSES if i == "MIT" and t.startswith("MIT License"))


def scan(spark, texts, licenses=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in scan_licenses(df, licenses or known_licenses(spark)).collect()}


def test_whole_texts_match_after_normalising(spark):
    changed = MIT.replace("MIT License\n", "The  MIT LICENCE!\n\nCopyright (c) 2020 Somebody <a@b.c>\n  © 2021 Another\n(C) a third")
    got = scan(spark, [MIT, MIT.upper(), MIT.replace(",", ";").replace("\n", " \n\t"),
                       MIT.replace("MIT License\n", "MIT licence\nCopyright 2020 me\n"), MIT[:-10], "MIT License", changed])
    assert [got[i]["whole_license"] for i in range(7)] == ["MIT", "MIT", "MIT", "MIT", None, None, None]
    assert got[0]["text_digest"] == got[1]["text_digest"] == got[3]["text_digest"] != got[4]["text_digest"]


def test_notices_match_as_entire_lines_only(spark):
    got = scan(spark, ["some text\nLicensed under CC BY-NC 4.0.\nmore", "we talk of text Licensed under CC BY-NC 4.0. here",
                       "LICENCED under cc-by-nc 4.0\nReleased under the MIT licence\nReleased under the MIT License."])
    assert [(got[i]["n_notices"], got[i]["licenses"]) for i in range(3)] == [(1, "CC-BY-NC-4.0"), (0, ""), (3, "CC-BY-NC-4.0,MIT")]


def test_canonical_lines(spark):
    df = spark.createDataFrame([("The Licence -- of\tthis\n\nCopyright 1999 x\n (c) y\nWilful  FAVOUR\nthe copyright owner",)], "t string")
    assert df.select(canonical_lines(F.col("t")).alias("x")).first()["x"] == [
        "the license of this", "willful favor", "the copyright holder"]


def test_known_texts_with_nulls_and_ties(spark):
    known = spark.createDataFrame([("B", "same text"), ("A", "Same, text!"), (None, "other"), ("C", None), ("D", " .. ")],
                                  "license_id string, text string")
    assert [r["license"] for r in known_digests(known).collect()] == ["A"]
    assert scan(spark, ["other", "same TEXT", ""], known)[1]["licenses"] == "A"


def test_odd_rows_and_native_plan(spark, odd_docs, no_docs):
    out = scan_licenses(odd_docs, known_licenses(spark))
    rows = out.collect()
    assert len(rows) == 11 and {r["n_notices"] for r in rows} == {0} and {r["licenses"] for r in rows} == {""}
    assert scan_licenses(no_docs, known_licenses(spark)).collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
