"""Substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

import ledgerops.llm.substrings as S
from conftest import SF_SMALL
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401


def brute(docs, length):
    """Per document: removed flags, by sets of all windows in order."""
    seen, out = {}, []
    for number, text in enumerate(docs):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen[w] = (number, s)
        out.append((b, gone))
    return out


def runs_of(gone):
    return sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))


def check(spark, docs, length=100):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.remove_repeats(df, length).collect()}
    for i, (b, gone) in enumerate(brute(docs, length)):
        assert got[i]["kept"] == bytes(c for c, g in zip(b, gone) if not g)
        assert got[i]["n_bytes"] == len(b) and len(got[i]["spans"]) == runs_of(gone)


def mixed_docs(n=60, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(5)]
    docs = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 40):], " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        docs.append(" ".join(parts))
    return docs + docs[:5] + ["ab" * 200, "a" * 350, "", "x" * 99, "x" * 100, "x" * 101]


def test_mixed_texts_match_brute_force(spark):
    check(spark, mixed_docs())


def test_hot_anchors_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_STRINGS", 2)
    monkeypatch.setattr(S, "HELD_ROWS", 50)
    check(spark, mixed_docs(40, 6))


def test_small_segments_and_batches_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 333)
    monkeypatch.setattr(S, "BATCH_BYTES", 1500)
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    check(spark, mixed_docs(40, 7))


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(3)
    for letters, n in ((2, 400), (4, 800), (200, 500)):
        text = np.concatenate([rng.integers(1, 1 + letters, n).astype(np.uint8), [255], np.zeros(40, np.uint8)]).astype(np.uint8)
        wanted = np.zeros(len(text), bool)
        wanted[:n] = rng.random(n) < 0.7
        order = S.suffix_order(text, wanted, 32)
        raw = text.tobytes()
        keys = [raw[i:i + 32] for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        common = S.common_prefixes(text, order, 20)
        for a, b, c in zip(order, order[1:], common[1:]):
            same = next((k for k in range(20) if raw[a + k] != raw[b + k]), 20)
            assert c == same


def test_query_matches_brute_force_on_the_small_table(spark):
    rows = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    want = brute([r["text"] for r in rows], 100)
    got = {r["doc_id"]: r for r in S.op1_suffix_array_dedup(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r, (b, gone) in zip(rows, want):
        g = got[r["doc_id"]]
        kept = bytes(c for c, x in zip(b, gone) if not x)
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (
            len(b), sum(gone), runs_of(gone), hashlib.sha256(kept).hexdigest())


def test_odd_rows(odd_docs, no_docs):
    rows = S.remove_repeats(odd_docs, 20).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    # the null id comes first: its text stays whole, the later copies go; the repeated row is one document
    assert len(by[None][0]["kept"]) == by[None][0]["n_bytes"] > 0
    assert by[1][0]["kept"] == b"" and [len(r["kept"]) for r in by[4] if r["n_bytes"] > 40] == [0, 0]
    assert by[2][0]["n_bytes"] == 0 and by[2][0]["spans"] == []
    assert by[7][0]["kept"] == b"x"  # every window but the first repeats it, and they cover all other bytes
    assert S.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 69])
def test_sliding_least(size):
    v = np.random.default_rng(size).integers(0, 1000, 300).astype(np.uint64)
    assert S.sliding_least(v, size).tolist() == [int(v[i:i + size].min()) for i in range(300 - size + 1)]
