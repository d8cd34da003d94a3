"""Ordinal toxicity model: held-out accuracy, gradients, odd rows."""

import numpy as np
from pyspark.sql import functions as F

import ledgerops.llm.toxicity as T
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    scored = T.score_documents(docs, T.fit(docs, labels.where(fold == 0)))
    rows = scored.join(labels.where(fold == 1), "doc_id").select("toxic", "rejected", "severity", "grade").collect()
    caught = [r["rejected"] for r in rows if r["toxic"] == 1]
    wrong = [r["rejected"] for r in rows if r["toxic"] == 0]
    assert np.mean(caught) > 0.8 and np.mean(wrong) < 0.01
    assert np.mean([r["severity"] for r in rows if r["toxic"] == 1]) > 5 * np.mean([r["severity"] for r in rows if r["toxic"] == 0])
    assert {r["grade"] for r in rows} == {0, 1, 2}


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        found = [i for i in range(4) if rng.random() < 0.4]
        eta = 2.0 * (0 in found) + 1.0 * (1 in found) - 1.5 * (2 in found)
        u = rng.logistic()
        rows.append((int(eta + u > 1.0) + int(eta + u > 2.5), found))
    w, (a, b) = T.fit_thresholds(rows, 4, ridge=0)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] - 1) < 0.3 and abs(w[2] + 1.5) < 0.3 and abs(w[3]) < 0.3
    assert abs(a - 1) < 0.3 and abs(b - 2.5) < 0.4


def test_sample_bound_and_labels_without_a_class(spark):
    docs = spark.createDataFrame([(i, "vile thing here" if i % 3 == 0 else f"a calm line {i}") for i in range(120)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (7, None, None), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels, max_rows=60)
    got = {r["doc_id"]: r["rejected"] for r in T.score_documents(docs, model).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(120))
    none = T.fit(docs, labels.where("toxic = 0 and doc_id % 3 <> 0"))
    assert T.score_documents(docs, none).where("rejected").count() == 0
    assert T.keep_accepted(docs, labels, 60).count() == 80


def test_odd_rows(spark, odd_docs, no_docs):
    model = T.ToxicityModel({"lazy": 9.0, "word": 9.0}, (4.0, 6.0))
    rows = T.score_documents(odd_docs, model).collect()
    assert len(rows) == 11 and sum(r["rejected"] for r in rows) == 5
    assert all(0 <= r["severity"] <= 2 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = T.keep_accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == 11
    assert T.score_documents(no_docs, model).collect() == []
