"""Embedding near-dedup against brute force over all pairs of a label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import ledgerops.llm.embeddings as E
from ledgerops.llm.common import component_labels

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ids = np.array([r[0] for r in rows])
    x = E.unit(np.array([r[1] for r in rows], np.float32))
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    part = component_labels(len(rows), *np.nonzero(linked))
    return {i: (int(n), int(ids[label_])) for i, n, label_ in zip(ids.tolist(), linked.sum(axis=1), part)}


def groups(seed, n=700, hot=260):
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=24)
    for i in range(n):
        if i < hot:
            v = centre + rng.normal(size=24) * 0.09  # one large group of near copies
        elif i % 5 == 0:
            v = np.array(rows[rng.integers(hot, len(rows))][1]) * 2 if len(rows) > hot else rng.normal(size=24)
        elif i % 7 == 0 and len(rows) > hot:
            v = np.array(rows[rng.integers(hot, len(rows))][1]) + rng.normal(size=24) * 0.08
        else:
            v = rng.normal(size=24)
        rows.append((i, [float(np.float32(a)) for a in v], int(i % 2 if i >= hot else 1)))
    return rows + [(n + i, rows[3][1], 1) for i in range(50)]


@pytest.mark.parametrize("shard_rows, block", [(400, 1024), (60, 128)])
def test_groups_match_brute_force(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(E, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(E, "MAX_BLOCK", block)
    rows = groups(3)
    want = brute(rows)
    got = {r["vec_id"]: r for r in E.link_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    true, found = sum(n for n, _ in want.values()), sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items()) and found >= 0.97 * true > 0
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_range_search_and_prune():
    rng = np.random.default_rng(4)
    x = E.unit(np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(100, 16))]))
    lists, begin = E.neighbour_lists(300, *E.robust_prune(x @ x.T))
    assert np.diff(begin).mean() < 2 * E.CANDIDATES  # pruned
    found = E.range_search(x, lists, begin, E.medoids(x, lists, begin), 0.98)
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    assert not (found & ~true).any() and found.sum() >= 0.97 * true.sum()


def test_audit_measures_recall(spark):
    rows = [(i, [1.0, float(i % 4) * 3], 1) for i in range(40)]
    nodes = (spark.createDataFrame(rows, SCHEMA).withColumn("dim", F.lit(2)).withColumn("copies", F.lit(1).cast("long"))
             .withColumn("label", F.col("label").cast("long")).withColumnRenamed("vec_id", "node"))
    full = spark.createDataFrame([(i, i, 9) for i in range(40)], "node long, low long, weight long")
    half = full.withColumn("weight", F.when(F.col("node") < 20, 9).otherwise(0).cast("long"))
    assert E.audit(nodes, full, 0.999) == 1.0 and abs(E.audit(nodes, half, 0.999) - 0.5) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (None, [1.0, 0.0], 1),
            (10, [1.0, 0.0], 2), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1), (14, [1e-30, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("low", F.lit(1))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in E.link_components(df).collect()))
    linked = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (14, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)]
    assert got == sorted(linked + alone + [(0, 0, None, False)], key=lambda r: (r[0], r[1]))
    assert E.link_components(spark.createDataFrame([], SCHEMA)).collect() == []
