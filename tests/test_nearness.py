"""Counting pairs within a tolerance against counting them one by one."""

import math
import os
import random
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerops.operators import nearness
from ledgerops.operators import reconciliation as rc
from ledgerops.operators.nearness import near_counts, reach_of
from ledgerops.plans import QUERIES
from ledgerops.session import SHUFFLE_CLEANUP, computed

KEYS = "k long, d string, amt {}, n_a long, n_b long"


def counted(spark, rows, tolerance, kind="double"):
    df = spark.createDataFrame(rows, KEYS.format(kind))
    found = near_counts(df, reach_of(tolerance, df.schema["amt"].dataType)).where("k is not null")
    row = found.agg(F.sum(F.expr("if(of_date, 0, near)")), F.sum(F.expr("if(of_date, 0, near_dated)")),
                    F.sum(F.expr("if(of_date, near, 0)"))).first()
    return tuple(x or 0 for x in row)


def brute(rows, tolerance, minus=lambda x, y: x - y):
    near = dated = same = 0
    for k, d, x, n, _ in rows:
        for k2, d2, y, _, m in rows:
            if k is not None and k == k2 and n * m and x is not None and y is not None:
                if abs(float(minus(x, y))) <= tolerance:
                    near += n * m
                    dated += n * m * (d is not None and d2 is not None)
                    same += n * m * (d is not None and d == d2)
    return near, dated, same


AMOUNTS = [0.0, -0.0, 0.1, 0.2, 0.30000000000000004, 0.3, -0.0999999, 1e-9, 1e-17, -1e-17, 5e-324, 0.01, -0.01, 1e15, 1e15 + 0.125,
           1e15 + 0.25, 1e300, -1e300, 1.7e308, -1.7e308, float("nan"), float("inf"), float("-inf"), None]


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.1, 0.25, 1e-17, 5e-324, 1.0, 1e300, 1.7e308, -1.0, math.nextafter(0.1, 1)])
def test_double_amounts_at_the_edges(spark, tolerance):
    pick = random.Random(int(tolerance * 1000) if abs(tolerance) < 10 else 5)
    pool = AMOUNTS + [x + s * tolerance for x in AMOUNTS[:14] for s in (-1, 1)]
    pool += [math.nextafter(x, s) for x in pool if x is not None and math.isfinite(x) for s in (-9e99, 9e99)]
    rows = {}
    for x in pool:
        for k in (1, 2, None):
            if pick.random() < 0.7:
                rows[(k, pick.choice(["d1", "d2", None]), None if x is None else repr(x + 0.0))] = x
    rows = [(k, d, None if x is None else x + 0.0, pick.randint(0, 3), pick.randint(0, 3)) for (k, d, _), x in rows.items()]
    assert counted(spark, rows, tolerance) == brute(rows, tolerance)


@pytest.mark.parametrize("kind,tolerance", [("float", 0.1), ("float", 0.01), ("float", 0.0), ("long", 2.0), ("long", 2.5), ("int", 0.0),
                                            ("long", 1e300), ("decimal(12,2)", 0.01), ("decimal(12,2)", 0.3), ("decimal(20,0)", 3.0)])
def test_other_types(spark, kind, tolerance):
    pick = random.Random(kind)
    rows = {}
    for _ in range(150):
        x = pick.randint(-40, 40)
        x = {"f": float(np.float32(x / 100)), "l": x, "i": x}.get(kind[0], Decimal(x) / (100 if "2)" in kind else 1))
        rows[(pick.choice([1, 2]), pick.choice(["d1", "d2", None]), x)] = (pick.randint(0, 2), pick.randint(0, 2))
    rows = [(*key, *n) for key, n in rows.items()]
    minus = (lambda x, y: np.float32(x) - np.float32(y)) if kind == "float" else lambda x, y: x - y
    assert counted(spark, rows, tolerance, kind) == brute(rows, tolerance, minus)


def test_a_key_that_spans_many_partitions(spark):
    pick = random.Random(4)
    rows = [(pick.choice([1, 1, 1, 2]), pick.choice(["x", "y", None]), i / 64, pick.randint(0, 2), pick.randint(0, 2)) for i in range(1500)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert counted(spark, rows, 0.5) == brute(rows, 0.5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_hot_key_within_the_tolerance(spark):
    """100,000 amounts of one key on either side, all within the tolerance: ten billion near pairs, none formed."""
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("d"),
                              (F.col("id") / 2**20).alias("amt"))
    summary = rc.reconcile(a, a, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 1.0)).summary()
    s = summary.first()
    assert (s["exact_matches"], s["matches_with_date_note"], s["amount_variances"]) == (n * n // 2, n * n // 2, 0)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "rangepartitioning" in plan


@pytest.mark.parametrize("most", [0, 30, 10**9])
@pytest.mark.parametrize("kind", ["long", "double", "decimal(38,0)"])
def test_keys_of_full_buckets_and_others_side_by_side(spark, monkeypatch, most, kind):
    """Keys counted in one task and keys cut by amount give the same counts, NULL keys are only counted."""
    monkeypatch.setattr(nearness, "MOST_ROWS", most)
    pick = random.Random(7)
    rows = {(pick.choice([1, 1, 1, *range(2, 12), None]), pick.choice(["x", "y", None]), pick.choice([i / 64, None])) for i in range(600)}
    rows = [(*key, pick.randint(0, 2), pick.randint(0, 2)) for key in sorted(rows, key=str)]
    df = spark.createDataFrame(rows, KEYS.format("double")).withColumn("k", F.col("k").cast(kind))
    found = near_counts(df, reach_of(0.5, df.schema["amt"].dataType)).where("not of_date").groupBy("k").agg(
        *[F.sum(c) for c in ("rows_a", "rows_b", "known_a", "known_b", "near", "near_dated")]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        of_key = [r for r in rows if r[0] == key]
        want[key] = (*[sum(r[i] for r in of_key) for i in (3, 4)], *[sum(r[i] for r in of_key if r[2] is not None) for i in (3, 4)],
                     *brute(of_key, 0.5)[:2])
    assert {r[0]: tuple(r)[1:] for r in found} == want


def _shuffled_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return {p: os.path.getsize(p) for p in paths if p.endswith(".data") and os.path.exists(p)}


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_a_summary_shuffles_rows_and_not_their_events(spark, kind):
    """Both sources go to disk once, and once more reduced: some 40 bytes a row, where shuffled events took several hundred."""
    n = 20_000
    a = spark.range(n).select(F.col("id").cast(kind).alias("k"), F.lit("x").alias("d"), F.rand(1).alias("amt"))
    before = _shuffled_files(spark)
    s = rc.reconcile(a, a, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01)).summary().first()
    assert (s["exact_matches"], s["rows_a"], s["rows_b"]) == (n, n, n)
    assert sum(size for p, size in _shuffled_files(spark).items() if p not in before) < 100 * n


def test_a_case_leaves_no_shuffle_files_to_the_next(spark):
    before = _shuffled_files(spark)
    assert len(QUERIES["recon_mixed_keys"](spark, SF_SMALL).collect()) == 5
    until = time.monotonic() + 20  # files are deleted in the background
    while (left := set(_shuffled_files(spark)) - set(before)) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left


def test_a_computed_result_is_the_same_and_leaves_the_settings(spark):
    df = spark.range(100).groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").cast("decimal(20,1)").alias("x"))
    for value in (None, "false"):
        spark.conf.unset(SHUFFLE_CLEANUP) if value is None else spark.conf.set(SHUFFLE_CLEANUP, value)
        found = computed(df)
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == value
        assert found.schema == df.schema and sorted(found.collect()) == sorted(df.collect())
    spark.conf.unset(SHUFFLE_CLEANUP)
