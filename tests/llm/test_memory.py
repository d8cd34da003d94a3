"""What a task of the pipeline holds is bounded, whatever the size of its Arrow batches."""

import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline as P
from ledgerops.llm import common as C
from ledgerops.llm import decontamination as D
from ledgerops.session import ARROW_BATCH, ARROW_BATCH_DEFAULT, small_arrow_batches


def test_bounded_counts_add_up_to_all_counts():
    items = [[f"w{i % 7}", f"w{i}"] for i in range(50)] + [[]]
    found = list(C.bounded_counts(iter(items), 10))
    assert len(found) > 1 and all(0 < len(f) < 10 + 2 for f in found)
    assert sum(found, Counter()) == Counter(w for i in items for w in i)
    assert list(C.bounded_counts(iter([]), 10)) == [] and list(C.bounded_counts(iter([[]]), 10)) == []


def test_counting_a_large_batch_does_not_hold_all_its_words():
    texts = [" ".join(f"word{j * 1000 + i}" for j in range(100)) for i in range(1000)]  # 100,000 different words
    tracemalloc.start()
    total = 0
    for found in C.bounded_counts((t.split(" ") for t in texts), 2000):
        total += sum(found.values())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 100_000 and peak < 2_000_000


def test_texts_are_searched_before_the_batch_has_been_turned_into_bytes():
    column = pa.array(["a" * 1000, None, "b" * 1000] * 4000)  # 8 MB
    tracemalloc.start()
    seen = size = 0
    for part in D._parts(C.each_text(column)):
        assert sum(map(len, part)) <= D.SHARD_BYTES
        seen, size = seen + len(part), size + sum(map(len, part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (seen, size) == (12_000, 8_000_000) and peak < 5_000_000


def test_a_large_block_is_not_searched_in_tiny_parts():
    texts = [b"x" * 400_000] * 20
    assert max(len(p) for p in D._parts(texts)) == 5
    assert max(len(p) for p in D._parts(texts, 4_000_000)) == 10


@pytest.mark.parametrize("name, stage", [s for s in P.STAGES if s[0] != "line_dedup"])
def test_python_stages_get_arrow_batches_of_bounded_bytes(spark, tmp_path, name, stage):
    spark.conf.unset(ARROW_BATCH[0])
    spark.createDataFrame([(1, True), (2, False)], "doc_id long, toxic boolean").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"{i} " + "x" * 10_000) for i in range(1, 1001)], "doc_id long, text string").coalesce(1)
    stage(spark, docs, str(tmp_path))

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        assert max(r.n for r in docs.mapInArrow(rows, "n long").collect()) < 500  # 10 MB in one batch before
    finally:
        spark.conf.unset(ARROW_BATCH[0])


def test_the_callers_own_bound_stays(spark):
    spark.conf.unset(ARROW_BATCH[0])  # an earlier pipeline in this session may have set it
    assert spark.conf.get(ARROW_BATCH[0]) == ARROW_BATCH_DEFAULT
    spark.conf.set(ARROW_BATCH[0], "1m")
    try:
        small_arrow_batches(spark)
        assert spark.conf.get(ARROW_BATCH[0]) == "1m"
    finally:
        spark.conf.unset(ARROW_BATCH[0])
