"""Histogram sort: balance, gapless slots, hot groups, odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

import ledgerops.llm.sharding as H
from conftest import SF_SMALL
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401


def check(rows, shards, largest):
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes) / shards
    # a boundary lies between two rows, so it misses its target by less than a row on each side
    assert max(abs(s - mean) for s in sizes) <= largest + 0.01 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_query_on_the_small_table(spark):
    rows = H.op7_histogram_sharding(spark, SF_SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in read_table(spark, SF_SMALL, "documents").collect()}
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
               and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    check(rows, 16, max(r["size"] for r in rows))


@pytest.mark.parametrize("bin_bytes", [1 << 24, 2000])
def test_a_group_of_copies_is_cut(spark, monkeypatch, bin_bytes):
    monkeypatch.setattr(H, "BIN_BYTES", bin_bytes)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = H.shard_documents(docs).collect()
    assert len(rows) == 6000 and {"doc_id", "text", "size", "text_crc32", "shard", "slot"} == set(rows[0].asDict())
    check(rows, 16, 20)


def test_rows_repeated_thousands_of_times(spark):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("one row").alias("text"))
    check(H.shard_documents(docs, 4).collect(), 4, 10)


def test_odd_rows(odd_docs, no_docs):
    out = H.shard_documents(odd_docs, 3)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "text_crc32"])
    rows = out.collect()
    assert len(rows) == 11 and {r["size"] for r in rows if r["text"] is None} == {1}
    check(rows, 3, 150_001)
    assert H.shard_documents(no_docs).collect() == []
