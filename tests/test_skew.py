"""A key holding a third of all rows: AQE splits it in the reconcile join;
the summary collapses copies before the shuffle."""

import contextlib

from pyspark.sql import functions as F

from ledgerops.operators import reconciliation as rc

SMALL_SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}
HOT = -7


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _side(spark, n, hot_rows_cap=None):
    r = spark.range(n)
    df = r.select(F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id")).alias("k"),
                  F.sha2(F.col("id").cast("string"), 256).alias("d"),
                  F.col("id").cast("double").alias("amt"))
    if hot_rows_cap:
        df = df.where((F.col("k") != HOT) | (F.col("amt") < hot_rows_cap))
    return df


def test_hot_key_is_split(spark):
    with conf(spark, SMALL_SKEW_CONF):
        a, b = _side(spark, 90000), _side(spark, 90000, hot_rows_cap=3000)
        pairs = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01)).exact_matches
        assert pairs.count() == 60000 + 1000
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_copies_collapse_before_the_shuffle(spark):
    """A third of A is one repeated row: the summary's reduction is partial-aggregated map-side."""
    a = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id")).alias("k"),
                                  F.lit("x").alias("d"),
                                  F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id") * 1.0).alias("amt"))
    b = spark.createDataFrame([(HOT, "x", 1.0), (HOT, "x", 1.0), (1, "x", 1.0)], "k long, d string, amt double")
    summary = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.0)).summary()
    row = summary.first()
    assert row["exact_matches"] == 10000 * 2 + 1
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_hot_key_with_many_distinct_rows_is_counted_without_pairs(spark):
    """One key with 100,000 distinct rows on either side has ten billion pairs; only near ones are formed."""
    n = 100_000
    a = spark.range(n).select(F.lit(HOT).alias("k"), F.col("id").cast("string").alias("d"), (F.col("id") * 1.0).alias("amt"))
    b = a.withColumn("amt", F.when(F.col("amt") % 2 == 0, F.col("amt")).otherwise(F.col("amt") + 0.5))
    s = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01)).summary().first()
    assert (s["exact_matches"], s["matches_with_date_note"], s["unclassified"]) == (n // 2, 0, 0)
    assert s["amount_variances"] == n * n - n // 2 and s["rows_a"] == s["rows_b"] == n


def test_null_keys_do_not_meet_in_one_partition(spark):
    a = spark.range(30000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.lit("x").alias("d"), F.lit(1.0).alias("amt"))
    b = spark.createDataFrame([(1, "x", 1.0)], "k long, d string, amt double")
    with conf(spark, SMALL_SKEW_CONF):
        missing = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"))).missing_in_b
        assert missing.count() == 29999 and missing.where("k is null").count() == 10000
        plan = missing._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("LeftAnti", 1)[1].split("Filter isnull")[0]
    assert "isnotnull(k" in joined or "NOT (id" in joined


def test_missing_rows_never_broadcast_all_keys(spark):
    """However small the keys are estimated, each task of the anti-join holds only its share of them."""
    a = spark.range(0, 5000).select(F.col("id").alias("k"), F.lit("x").alias("d"), F.lit(1.0).alias("amt"))
    b = a.where("k % 5 <> 0").unionByName(a.select((F.lit(-1) - F.col("k")).alias("k"), "d", "amt"))
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}):
        recon = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01))
        for missing, n in ((recon.missing_in_b, 1000), (recon.missing_in_a, 5000)):
            assert len(missing.collect()) == n
            assert "Broadcast" not in missing._jdf.queryExecution().executedPlan().toString()


def test_missing_rows_of_a_union_hold_the_keys_once(spark):
    """The anti-join is not pushed into the branches, where a small one would meet all keys in few tasks."""
    a = spark.range(0, 5000).select(F.col("id").alias("k"), F.lit("x").alias("d"), F.lit(1.0).alias("amt"))
    few = a.where("k % 100 = 0").select((F.lit(-1) - F.col("k")).alias("k"), "d", "amt")
    nulls = a.where("k < 3").select(F.lit(None).cast("long").alias("k"), "d", "amt")
    b = a.where("k % 5 <> 0").unionByName(few).unionByName(nulls)
    recon = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01))
    missing = recon.missing_in_a
    assert sorted(r["k"] for r in missing.where("k IS NOT NULL").collect()) == sorted(-1 - k for k in range(0, 5000, 100))
    assert missing.count() == 53
    assert missing._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1


def test_large_tables_get_more_partitions_than_the_session_has(spark):
    """A task's share of the sorted events does not grow with the table once the session's partitions are used up."""
    a = spark.range(60000).select((F.col("id") % 20000).alias("k"), (F.col("id") % 7).cast("string").alias("d"),
                                  (F.col("id") % 11 / 100).alias("amt"))
    b = a.select("k", "d", (F.col("amt") + F.lit(0.004)).alias("amt"))
    for partitions, dealt in (("2", True), ("200", False)):
        with conf(spark, {"spark.sql.shuffle.partitions": partitions}):
            recon = rc.reconcile(a, b, rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), 0.01))
            summary = recon.summary()
            assert ("REPARTITION_BY_NUM" in summary._jdf.queryExecution().executedPlan().toString()) == dealt
            row = summary.first()
            found = {r["category"]: r["n"] for r in recon.pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
            assert [row[f"{c}es"] if c == rc.EXACT_MATCH else row["matches_with_date_note"] if c == rc.MATCH_WITH_DATE_NOTE
                    else row["amount_variances"] for c in rc.CATEGORIES[:3]] == [found.get(c, 0) for c in rc.CATEGORIES[:3]]
            assert row["rows_a"] == row["rows_b"] == 60000
