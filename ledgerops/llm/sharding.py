"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number in the written key
table), so equal texts lie side by side and even a group of copies that holds a
third of all rows can be cut. The splitters are found by counting: each round
counts the exact bytes and rows below a set of candidate boundaries over all
partitions, and every splitter whose interval is still too wide gets new probes
inside the interval's real smallest and largest key. Once all splitters meet the
tolerance the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, written

KEY_BYTES = 24
TOLERANCE = 0.001     # of a shard's bytes
BIN_BYTES = 16 << 20  # a shard is exchanged in bins of about this size, each numbered by one task
MAX_BINS = 256        # per shard; larger inputs get larger bins
PROBES = 8            # new candidates per open splitter and round


def _keys(hashes: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """24-byte big-endian keys whose byte order is the order of the three signed numbers."""
    out = np.empty((len(hashes), 3), ">u8")
    for i, column in enumerate((hashes, ids, rows)):
        out[:, i] = column.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{KEY_BYTES}").ravel()


def _as_array(boundaries: list[int]) -> np.ndarray:
    return np.array([b.to_bytes(KEY_BYTES, "big") for b in boundaries], f"S{KEY_BYTES}")



def _histogram(keys: DataFrame, boundaries: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Per bin between the sorted boundaries: bytes, rows, smallest and largest key."""
    probes = _as_array(boundaries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids, rows, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            key = _keys(hashes, ids, rows)
            order = np.argsort(key, kind="stable")
            key, size = key[order], size[order]
            place = np.searchsorted(probes, key, side="right")
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(key) else np.array([], int)
            last = np.concatenate([first[1:], [len(key)]]).astype(int) - 1 if len(key) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[first].astype(np.int64)), pa.array(np.add.reduceat(size, first) if len(key) else size),
                 pa.array((last - first + 1).astype(np.int64)),
                 pa.array([k.ljust(KEY_BYTES, b"\0") for k in key[first].tolist()], pa.binary()),
                 pa.array([k.ljust(KEY_BYTES, b"\0") for k in key[last].tolist()], pa.binary())],
                names=["bin", "bytes", "n", "low", "high"])

    bins = (keys.mapInArrow(count, "bin long, bytes long, n long, low binary, high binary").groupBy("bin")
            .agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high")).collect())
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in bins}


def find_splitters(keys: DataFrame, total: int, bins: int, tolerance: float) -> list[int]:
    """``bins - 1`` boundaries; the bytes below the j-th are within ``tolerance`` of j/bins of the total, or
    as near as a boundary between two rows can be. ``keys`` has (hash, id, row, size)."""
    targets = [total * j / bins for j in range(1, bins)]
    found: list[int | None] = [None] * len(targets)
    space = 1 << (8 * KEY_BYTES)
    probes = [space * i // (2 * bins) for i in range(1, 2 * bins)]
    while None in found:
        histogram = _histogram(keys, probes)
        below, edges = 0, []  # of each bin with rows: bytes before it and its figures
        for b in sorted(histogram):
            edges.append((below, *histogram[b]))
            below += histogram[b][0]
        starts = [e[0] for e in edges]
        wanted: set[int] = set()
        for j, target in enumerate(targets):
            if found[j] is not None:
                continue
            start, size, n, low, high = edges[bisect_right(starts, target) - 1]
            before, after = abs(target - start), abs(start + size - target)
            if n == 1 or low == high or min(before, after) <= tolerance:
                found[j] = low if before <= after else high + 1
            else:
                wanted.update((low, high, *(low + (high - low) * i // (PROBES + 1) + 1 for i in range(1, PROBES + 1))))
        # probes beside an open interval's own ends keep it apart from its neighbours
        probes = sorted(wanted)
    return found


def shard_documents(docs: DataFrame, shards: int = 16, carry: list[str] | None = None,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (or its columns ``carry``) with size, text_crc32, shard and slot of every row.

    size is the text's UTF-8 bytes plus 1 (null text: 1, with crc 0). Shards get
    near-equal bytes; slot numbers a shard's rows from 0 without gaps. A null
    doc_id sorts first; repeated rows are kept apart by their row number in the
    written table. Input columns named like an output column are replaced. An
    empty table gives no rows."""
    carry = [c for c in (carry or docs.columns) if c not in ("size", "text_crc32", "shard", "slot")]
    body = F.col("text").cast("string")
    rows = written(docs.select(
        *[F.col(f"`{c}`") for c in carry],
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("_x_size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("_x_crc"),
        F.xxhash64(body).alias("_x_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_x_id"),
        F.monotonically_increasing_id().alias("_x_row")), "shard-rows")
    keys = rows.select("_x_hash", "_x_id", "_x_row", "_x_size")
    total = keys.agg(F.sum("_x_size")).first()[0] or 0
    per_shard = max(1, min(MAX_BINS, -(-total // (shards * BIN_BYTES))))
    cuts = find_splitters(keys, total, shards * per_shard, tolerance * total / shards) if total else []
    histogram = _histogram(keys, cuts) if total else {}
    base, offsets = 0, []
    for b in range(shards * per_shard):
        base = 0 if b % per_shard == 0 else base
        offsets.append((b, base))
        base += histogram[b][1] if b in histogram else 0
    probes = _as_array(cuts)

    @F.pandas_udf("long")
    def bin_of(hashes: pd.Series, ids: pd.Series, row: pd.Series) -> pd.Series:
        key = _keys(hashes.to_numpy(), ids.to_numpy(), row.to_numpy())
        return pd.Series(np.searchsorted(probes, key, side="right"), dtype="int64")

    # at most shards * MAX_BINS rows: safe to broadcast
    start = F.broadcast(docs.sparkSession.createDataFrame(offsets, "_x_bin long, _x_base long"))
    order = Window.partitionBy("_x_bin").orderBy("_x_hash", "_x_id", "_x_row")
    return (rows.withColumn("_x_bin", bin_of("_x_hash", "_x_id", "_x_row"))
            .withColumn("_x_slot", F.row_number().over(order))
            .join(start, "_x_bin")
            .select(*[F.col(f"`{c}`") for c in carry], F.col("_x_size").alias("size"), F.col("_x_crc").alias("text_crc32"),
                    F.expr(f"int(_x_bin div {per_shard})").alias("shard"),
                    (F.col("_x_base") + F.col("_x_slot") - 1).alias("slot")))


def op7_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near-equal bytes."""
    out = shard_documents(read_table(spark, sf_dir, "documents"), shards=16, carry=["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
