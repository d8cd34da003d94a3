"""Helpers shared by the training-data operators: tables, scratch tables, Arrow access, components."""

from __future__ import annotations

import sys
import types
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given Parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, row_group_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read back.

    ``row_group_bytes`` keeps the row groups of tables with large binary values
    small, since the reader takes thousands of rows of a row group at once.
    Cuts the lineage with a table every executor can read, so a lost executor
    costs a task retry and later jobs do not repeat the work."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    writer = df.write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def co_located(df: DataFrame, key: str, parts: int, name: str, row_group_bytes: int) -> DataFrame:
    """``df``, already dealt into ``parts`` by ``key``, written to the shared folder as a table bucketed by ``key``.

    Later joins on the key (``with_mail``) read it without shuffling it."""
    path = scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    (df.write.format("parquet").option("path", path).option("parquet.block.size", row_group_bytes)
     .bucketBy(parts, key).saveAsTable(table))
    return df.sparkSession.table(table)


def with_mail(table: DataFrame, key: str, mail: DataFrame, parts: int) -> DataFrame:
    """Every row of a table of ``co_located`` (in ``parts``) with the rows (kind, source, target, payload) for it as a column ``mail``."""
    sent = (mail.repartition(parts, "target").groupBy(F.col("target").alias(key))
            .agg(F.collect_list(F.struct("kind", "source", "payload")).alias("mail")))
    return table.join(sent.hint("shuffle_hash"), key, "left")


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that no later job reads."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker (tasks of one worker share it)."""
    module = sys.modules.setdefault("_ledgerops_worker_cache", types.ModuleType("_ledgerops_worker_cache"))
    return module.__dict__.setdefault(name, {})


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's rows; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def each_text(column: pa.Array) -> Iterator[bytes]:
    """``text_bytes`` one by one: an Arrow batch of long texts is not held a second time as Python objects."""
    for b in column.cast(pa.binary()):
        yield b.as_py() or b""


def bounded_counts(items: Iterator[Iterable], most: int) -> Iterator[Counter]:
    """Counts of all members of ``items``, given out whenever there are ``most`` or more different ones, so that what
    a task holds does not grow with its Arrow batches. A member may be in several of the results."""
    found: Counter = Counter()
    for members in items:
        found.update(members)
        if len(found) >= most:
            yield found
            found = Counter()
    if found:
        yield found


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected links ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_links = la != lb
        if not open_links.any():
            break
        la, lb = la[open_links], lb[open_links]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        a, b = a[open_links], b[open_links]
    return label


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); component = smallest node.

    Alternates large-star and small-star steps until the links no longer change
    (about log n rounds). Each round is joins and aggregations on the node, with
    map-side combine; the smallest neighbours are a written table of their own, so
    that both sides of a join are plain shuffles and AQE can split a hub that
    holds a large part of all links. Nothing is collected but two numbers."""
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), name)
    state = _fingerprint(current)
    while state[0]:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .where("a <> b").distinct(), f"{name}-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        current = written(small, name)
        now = _fingerprint(current)
        if now == state:
            break
        state = now
    roots = current.groupBy("a").agg(F.min("b").alias("component"))
    return (roots.select(F.col("a").alias("node"), "component")
            .unionByName(roots.select(F.col("component").alias("node"), "component").distinct()))
