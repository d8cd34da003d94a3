"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of their first and last letters; those
whose document share differs clearly between toxic and other labelled documents
are kept. One weight vector serves all ordered thresholds:
P(grade > k) = logistic(w.x - theta_k). The labels say toxic or not, so the
grades are 0 (not toxic), 1 (toxic) and 2 (toxic, with more kept features than
the median toxic document). The fit uses at most ``max_rows`` labelled
documents; scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_counts, read_table

MAX_ROWS = 16_000       # labelled documents that the fit may use
MAX_FEATURES = 4096
MIN_DOCS = 3            # a feature counts from so many toxic documents on
MIN_SCORE = 5.0         # standard errors between the two shares
AFFIXES = (4, 5, 6, 7)
CACHE_WORDS = 150_000   # that a task keeps
COUNTED_FEATURES = 100_000  # that a task counts before it hands the counts on
EDGES = ".,;:!?()[]{}\"'|*-_/«»¿¡…“”„"


def word_features(token: str) -> list[str]:
    word = token.strip(EDGES)
    if not word:
        return []
    return [word, *("^" + word[:n] for n in AFFIXES if len(word) >= n), *(word[-n:] + "$" for n in AFFIXES if len(word) >= n)]


def text_features(text: str | None) -> set[str]:
    return set(chain.from_iterable(map(word_features, set((text or "").lower().split()))))


@dataclass
class ToxicityModel:
    """Kept features with their weights, and the two increasing thresholds."""
    weights: dict[str, float]
    thresholds: tuple[float, float]


def fit_thresholds(rows: list[tuple[int, list[int]]], n_features: int, rounds: int = 600, rate: float = 0.1,
                   ridge: float = 1e-4) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights and thresholds of the cumulative-logit model for (grade, features present) rows, by Adam."""
    grade = np.array([g for g, _ in rows])
    n = len(rows)
    row = np.repeat(np.arange(n), [len(f) for _, f in rows])
    col = np.array(list(chain.from_iterable(f for _, f in rows)), np.int64)
    # parameters: weights, first threshold, log of the distance to the second
    x = np.concatenate([np.zeros(n_features), [2.0, 0.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)

    def below(z):  # P(grade <= k) and its slope
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p, p * (1 - p)

    for step in range(1, rounds + 1):
        eta = np.bincount(row, x[col], minlength=n)
        gap = np.exp(x[-1])
        p1, d1 = below(x[-2] - eta)
        p2, d2 = below(x[-2] + gap - eta)
        p = np.maximum(np.choose(grade, [p1, p2 - p1, 1 - p2]), 1e-12)
        # slope of log p in each threshold
        s1 = np.choose(grade, [d1, -d1, np.zeros(n)]) / p
        s2 = np.choose(grade, [np.zeros(n), d2, -d2]) / p
        g = np.concatenate([np.bincount(col, (s1 + s2)[row], minlength=n_features) / n + ridge * x[:-2],
                            [-(s1 + s2).sum() / n, -s2.sum() * gap / n]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return x[:-2], (float(x[-2]), float(x[-2] + np.exp(x[-1])))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Model from the labelled rows of ``docs``.

    At most ``max_rows`` labels are used (those first by a hash of the doc_id),
    which bounds the broadcast ids and what the driver receives. Labels with a
    null doc_id or a null toxic are left out; a doc_id labelled twice counts as
    toxic if one row says so. Without toxic rows the model rejects nothing."""
    chosen = (labels.where("doc_id is not null and toxic is not null")
              .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(
        F.broadcast(chosen), "_id").select("_text", "_toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = np.array(batch.column(1).to_pylist(), np.int64) > 0
            for toxic in (0, 1):
                texts = batch.column(0).take(pa.array(np.flatnonzero(grades == toxic)))
                for counts in bounded_counts((text_features(t.as_py()) for t in texts), COUNTED_FEATURES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(counts.keys(), pa.string()), pa.array([toxic] * len(counts), pa.int32()),
                         pa.array(counts.values(), pa.int64())], names=["feature", "toxic", "n"])

    size = rows.groupBy((F.col("_toxic") > 0).alias("t")).count().collect()
    n1, n0 = (sum(r["count"] for r in size if r["t"] == t) for t in (True, False))
    if not n1 or not n0:
        return ToxicityModel({}, (30.0, 31.0))
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    score = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    top = (rows.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature")
           .agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"))
           .where((F.col("a") >= MIN_DOCS) & (share < 1)).withColumn("score", score)
           .where(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "feature").limit(MAX_FEATURES).collect())
    index = {r["feature"]: i for i, r in enumerate(top)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in text_features(t) & index.keys()) for t in (x.as_py() for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             names=["toxic", "found"])

    sample = rows.mapInArrow(present, "toxic int, found array<int>").collect()
    hits = sorted(len(r["found"]) for r in sample if r["toxic"] > 0)
    median = hits[len(hits) // 2]
    graded = [(0 if r["toxic"] <= 0 else 2 if len(r["found"]) > median else 1, r["found"]) for r in sample]
    weights, thresholds = fit_thresholds(graded, len(index))
    return ToxicityModel({f: float(weights[i]) for f, i in index.items()}, thresholds)


def severity(model: ToxicityModel):
    """Arrow function text -> (p_toxic, p_severe): the chances that the grade exceeds 0 and 1. Null is empty text."""
    weights, thresholds = model.weights, model.thresholds
    kept: dict[str, tuple[str, ...]] = {}  # of the task: empty when the function is sent

    @F.arrow_udf("struct<p_toxic:double,p_severe:double>")
    def score(column: pa.Array) -> pa.Array:
        eta = np.empty(len(column))
        for i, text in enumerate(column):
            found: set[str] = set()
            for token in set((text.as_py() or "").lower().split()):
                features = kept.get(token)
                if features is None:
                    if len(kept) >= CACHE_WORDS:
                        kept.clear()
                    features = kept[token] = tuple(f for f in word_features(token) if f in weights)
                if features:
                    found.update(features)
            eta[i] = sum(weights[f] for f in sorted(found))
        p = [1 / (1 + np.exp(np.clip(t - eta, -30, 30))) for t in thresholds]
        return pa.StructArray.from_arrays([pa.array(x) for x in p], names=["p_toxic", "p_severe"])

    return score


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, p_toxic, severity, grade, rejected) of every row; a null or empty text has no features.

    severity is the expected grade, grade the most probable one; rejected: p_toxic > 0.5."""
    p = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    severity(model)(F.col("text").cast("string")).alias("p"))
    one, two = F.col("p.p_toxic"), F.col("p.p_severe")
    likely = F.greatest(1 - one, one - two, two)
    return p.select("doc_id", one.alias("p_toxic"), (one + two).alias("severity"),
                    F.when(likely == 1 - one, 0).when(likely == two, 2).otherwise(1).alias("grade"),
                    (one > 0.5).alias("rejected"))


def keep_accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model fitted on ``labels`` does not reject, with all their columns."""
    return docs.where(severity(fit(docs, labels, max_rows))(F.col("text").cast("string"))["p_toxic"] <= 0.5)


def op6_toxicity_severity(spark, sf_dir: str) -> DataFrame:
    """Severity of every document, by the model fitted on the labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
