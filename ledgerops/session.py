"""Spark session settings for ledger work.

The library itself never creates a session: every function takes a DataFrame or
a ``SparkSession`` from the caller. ``build_session`` is a convenience for
tests, the bench and local use; on a cluster the submitting job owns the
session and these settings are passed with ``--conf``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans at run time: it coalesces small
# shuffle partitions, converts a join to broadcast only when the measured side
# is under the threshold, and splits skewed join partitions (a hot key is cut
# into several tasks on the streamed side and the other side is replicated).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # The only broadcasts are AQE's, decided on the measured size of a side
    # after its shuffle map stage; this is that size bound. Estimated sizes
    # decide nothing.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# An Arrow batch of long texts (10,000 rows, up to 64 MB by default) stands in buffers of the executor's JVM and of
# the Python worker at once, for each running task.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
ARROW_BATCH_DEFAULT = "67108864b"


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless the caller has set a bound of their own."""
    key, most = ARROW_BATCH
    if spark.conf.get(key, ARROW_BATCH_DEFAULT) == ARROW_BATCH_DEFAULT:
        spark.conf.set(key, most)


# Spark 4.1 and later: a query deletes its shuffle files when it ends. Otherwise they stay until the driver's garbage
# collector finds them unused.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def computed(df: DataFrame) -> DataFrame:
    """A small result, computed now: for results that are brought together but need not hold their shuffle files at once."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        rows = df.select("*").collect()  # a query of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.createDataFrame(rows, df.schema).coalesce(1)


def build_session(
    master: str | None = None,
    app_name: str = "ledgerops",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or reuse) a session with the scale settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session (no RDD-level API there)."""
    try:
        return spark.sparkContext
    except NotImplementedError:
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the
    session. Only a local run (``local*`` master) may go without: a scratch
    folder is created and registered for it. On a cluster each executor would
    see its own disk there, so a missing setting is an error.
    """
    sc = _context(spark)
    configured = sc.getCheckpointDir() if sc is not None else None
    if not configured:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="ledgerops-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(configured)
            configured = sc.getCheckpointDir() or configured
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.urandom(6).hex()}"
