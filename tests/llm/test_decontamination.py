"""Decontamination against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

import ledgerops.llm.decontamination as D
from conftest import SF_SMALL
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[j:j + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j:j + n])) in windows:
                    hit[j:j + n] = [1] * n
                    found |= windows[k]
        out.append((len(w), sum(hit), found))
    return out


def check(spark, docs, items, size=10):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.match_documents(d, b, size).collect()}
    want = brute(docs, items, size)
    for i, (n, hit, found) in enumerate(want):
        r = got[i]
        assert (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) == (n, hit, found)
        w = words(docs[i])
        texts = dict((str(k), words(t)) for k, t in items)
        for m in r["matches"]:  # each match is verbatim
            assert w[m["doc_word"]:m["doc_word"] + m["n_words"]] == texts[m["item_id"]][
                m["item_word"]:m["item_word"] + m["n_words"]]
    clean = {r["doc_id"] for r in D.remove_contaminated(d, b, size).collect()}
    assert clean == {i for i, (_, hit, _) in enumerate(want) if not hit}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in ("", "x", "yz", "long-word", "Ü1")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(25)]
    docs = []
    for _ in range(50):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(items)[1].upper().replace(" ", ", \n"))
        docs.append(" ".join(parts))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_brute_force(spark, seed):
    check(spark, *corpus(seed))


def test_repetitive_texts(spark):
    check(spark, ["the " * 300, "a b " * 40, "the cat", ""], [(1, "the " * 30), (2, "a b a b a b a b a b a"), (3, "the cat"), (4, "b")])


def test_small_shards_and_blocks_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 37)
    monkeypatch.setattr(D, "SHARD_BYTES", 400)
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    check(spark, *corpus(3))


def test_long_items_in_pieces_and_long_words(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(3 * D.PIECE_WORDS))
    giant = "g" * 400_000
    items = [(1, long), (2, f"a {giant} b"), (3, " ".join(["same"] * 5000)), (4, f"{giant}x")]
    w = long.split()
    docs = [" ".join(w[D.PIECE_WORDS - 20:D.PIECE_WORDS + 20]), " ".join(w[2 * D.PIECE_WORDS - 30:2 * D.PIECE_WORDS]),
            f"see a {giant} b", giant, "same " * 40, long, " ".join(w[::-1][:50])]
    check(spark, docs, items)
    pieces = [r["body"] for r in D.benchmark_blocks(spark.createDataFrame(items, "item_id long, text string"))[0].collect()]
    assert sum(map(len, pieces)) < sum(len(t) for _, t in items) + 5000  # places, not copies


def test_blocks_are_bounded_and_keep_every_window(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    table, blocks = D.benchmark_blocks(spark.createDataFrame(items * 3, "item_id long, text string"))
    rows = table.collect()
    assert blocks > 3 and max(len(r["body"]) for r in rows) < 4 * 700
    found = {bytes(r["body"])[s:s + n] for r in rows for s, n in zip(np.frombuffer(r["start"], np.int64), np.frombuffer(r["length"], np.int64))}
    want = {" ".join(words(t)[j:j + 10]).encode() + b" " for _, t in items if words(t) for j in range(max(1, len(words(t)) - 9))}
    assert found == want


def test_odd_rows_over_several_blocks(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 8)
    test_odd_rows(spark, odd_docs, no_docs)


def test_query_matches_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    got = {r["doc_id"]: r for r in D.op2_benchmark_decontamination(spark, SF_SMALL).collect()}
    for r, (n, hit, found) in zip(docs, brute([r["text"] for r in docs], items)):
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (
            n, hit, len(found), digest, hit > 0)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "naïve café"), (3, None), (4, ""), (4, "...")],
                                  "item_id long, text string")
    got = D.match_documents(odd_docs, items, 3).collect()
    assert len(got) == 11
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in got if r["n_hit"]) == [(0, 3), (1, 3), (4, 3), (4, 3), (6, 2)]
    clean = D.remove_contaminated(odd_docs, items, 3)
    assert clean.columns == odd_docs.columns and clean.count() == 6
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.remove_contaminated(odd_docs, none).count() == 11
    assert D.match_documents(no_docs, items).collect() == []


def test_hit_words_counts_the_union():
    doc, start, size = np.array([0, 0, 2, 0]), np.array([5, 3, 0, 20]), np.array([4, 4, 2, 1])
    assert D.hit_words(doc, start, size, 3).tolist() == [7, 0, 2]
