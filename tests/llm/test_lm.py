"""Pitman-Yor model: probabilities sum to one, exact counts, held-out gain, determinism."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

import ledgerops.llm.lm as M
from conftest import SF_SMALL
from ledgerops.llm.common import read_table
from odd_rows import no_docs, odd_docs  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_counts_base_and_held_out_gain(spark):
    docs = read_table(spark, SF, "documents").collect()
    train = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 10:
            train.update(d["text"].encode().lower().split())
            train[M.END] += 1
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in M.op8_pitman_yor_scores(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, words = got[d["doc_id"]], d["text"].encode().lower().split() + [M.END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0)
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)  # both negative: a clear gain
    again = {r["doc_id"]: r["score"] for r in M.op8_pitman_yor_scores(spark, SF).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 * abs(r["score"]) for i, r in got.items())


def test_tables_follow_their_conditional_distribution():
    """Against all seatings of a cell's customers, counted one by one."""
    discount, first, growth, c = 0.6, 0.9, 0.3, 5
    weights = Counter()
    for choice in itertools.product(range(c), repeat=c):  # the table of every customer, numbered as they open
        if all(t <= max((-1, *choice[:i])) + 1 for i, t in enumerate(choice)):
            sizes = Counter(choice).values()
            ways = np.prod([np.prod(np.arange(1, n) - discount) for n in sizes])
            weights[len(sizes)] += ways * np.prod(first + growth * np.arange(len(sizes)))
    n = 40_000
    got = M.draw_tables(np.full(n, c), np.full(n, first), np.full(n, growth), M.stirling(discount), np.random.default_rng(3))
    for t in range(1, c + 1):
        assert abs((got == t).mean() - weights[t] / sum(weights.values())) < 0.01


def test_seating_one_by_one():
    rng = np.random.default_rng(5)
    customers, opening, d = np.full(4000, 200), np.full(4000, 0.7), 0.6
    got = M.seat(customers, opening, np.zeros(4000), d, rng).mean()
    one_by_one = []
    for _ in range(400):
        t = 1
        for k in range(1, 200):
            t += rng.random() < 0.7 / (0.7 + k - d * t)
        one_by_one.append(t)
    assert abs(got - np.mean(one_by_one)) < 0.1 * np.mean(one_by_one)


def brute_force(texts, discounts, sweeps, burn_in):
    """Predictive probabilities of a Gibbs sampler that seats single customers at tables, averaged over its sweeps."""
    rng = np.random.default_rng(11)
    pairs = [(([M.END] + t)[i], w) for t in texts for i, w in enumerate(t + [M.END])]
    base = 1 / (len({w for _, w in pairs}) + 1)
    tables = {}  # (restaurant, dish) -> sizes of its tables; restaurant None is the parent

    def size(r):
        own = [s for (q, _), s in tables.items() if q == r]
        return sum(map(sum, own)), sum(map(len, own))

    totals = {}

    def probability(r, w):
        d, up = (discounts[1], base) if r is None else (discounts[0], probability(None, w))
        own, (n, t) = tables.get((r, w), []), totals.get(r, (0, 0))
        return (sum(own) - d * len(own) + (M.STRENGTH + d * t) * up) / (M.STRENGTH + n)

    def change(r, customers, opened):
        n, t = totals.get(r, (0, 0))
        totals[r] = n + customers, t + opened

    def add(r, w):
        d, up = (discounts[1], base) if r is None else (discounts[0], probability(None, w))
        own = tables.setdefault((r, w), [])
        weights = np.array([s - d for s in own] + [(M.STRENGTH + d * totals.get(r, (0, 0))[1]) * up])
        at = rng.choice(len(weights), p=weights / weights.sum())
        if at == len(own):
            own.append(0)
            if r is not None:
                add(None, w)
        own[at] += 1
        change(r, 1, own[at] == 1)

    def remove(r, w):
        own = tables[r, w]
        at = rng.choice(len(own), p=np.array(own) / sum(own))
        own[at] -= 1
        change(r, -1, -(own[at] == 0))
        if own[at] == 0:
            own.pop(at)
            if r is not None:
                remove(None, w)

    mean = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep:
                remove(u, w)
            add(u, w)
        if sweep >= burn_in:
            for u, w in set(pairs):
                mean[u, w] += probability(u, w) / (sweeps - burn_in)
    assert all(size(r) == totals[r] for r in totals)
    return pairs, mean


def test_score_agrees_with_a_sampler_of_single_customers(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}".encode() for i in range(12)]
    chance = 1 / np.arange(1, 13) / (1 / np.arange(1, 13)).sum()
    ids = [i for i in range(60) if not M.is_held_out(i)][:25]
    texts = [[words[j] for j in rng.choice(12, 14, p=chance)] for _ in ids]
    docs = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in zip(ids, texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in M.score_documents(docs.coalesce(1), 10, 20).collect()}
    pairs = Counter((([M.END] + t)[i], w) for t in texts for i, w in enumerate(t + [M.END]))
    singles, twos = (sum(n == k for n in pairs.values()) for k in (1, 2))
    opened = Counter(w for _, w in pairs)  # one table per cell, as the discounts are estimated
    discounts = (M._discount(singles, twos), M._discount(*(sum(n == k for n in opened.values()) for k in (1, 2))))
    _, mean = brute_force(texts, discounts, 80, 20)
    for i, t in zip(ids, texts):
        want = sum(math.log10(mean[([M.END] + t)[k], w]) for k, w in enumerate(t + [M.END]))
        assert abs(got[i] - want) < 0.03 * abs(want), (got[i], want)


def test_pack_round_trip():
    arrays = [np.array([1, 2 ** 40], np.int64), np.array([], np.int64), np.array([0.5, -3], np.float32), np.array([-7, 2])]
    for a, b in zip(arrays, M.unpack(M.pack(*arrays))):
        assert a.tolist() == b.tolist()


def test_small_batches_many_buckets_and_contexts_that_are_cut(spark, monkeypatch):
    """Other buckets, other draws: counts are equal, scores nearly."""
    docs = read_table(spark, SF_SMALL, "documents")
    want = {r["doc_id"]: r for r in M.score_documents(docs).collect()}
    monkeypatch.setattr(M, "BATCH_BYTES", 100_000)
    monkeypatch.setattr(M, "BUCKET_BYTES", 16_000)
    monkeypatch.setattr(M, "HOME_BYTES", 100_000)
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert len(M.hot_contexts(docs, total, -(-total // M.BUCKET_BYTES))) > 0
    got = M.score_documents(docs).collect()
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w["n_tokens"], w["n_known"], w["train_tokens"])
        assert abs(r["base_score"] - w["base_score"]) < 1e-6 and abs(r["score"] / w["score"] - 1) < 0.05
    assert abs(sum(r["score"] for r in got) / sum(r["score"] for r in want.values()) - 1) < 0.005


def test_first_words_sum_to_one(spark):
    """The chances of every known first word and an unknown one: a text's score less that of its rest."""
    ids = [i for i in range(2000) if not M.is_held_out(i)][:80]
    held = [i for i in range(2000) if M.is_held_out(i)]
    words = ["red", "blue", "green", "red"]
    train = [(i, " ".join(words[(i * k) % 4] for k in range(1, 9))) for i in ids]
    known = sorted({w for _, t in train for w in t.split()})
    # "x w" and "x x w" differ by one step from x to x, "w x" and "w" by the steps w -> x -> end against w -> end
    texts = [f"{a} {b}".strip() for a in ["", *known, "unseen"] for b in ["", *known, "unseen"]]
    docs = spark.createDataFrame(train + list(zip(held, dict.fromkeys(texts))), "doc_id long, text string").coalesce(1)
    scores = {r["doc_id"]: 10 ** r["score"] for r in M.score_documents(docs).collect()}
    chance = {t: scores[i] for i, t in zip(held, dict.fromkeys(texts))}
    # p(w first) p(end | w); p(w first) p(v | w) p(end | v)
    names = [*known, "unseen"]
    first, end = {}, {}
    for w in names:  # p(w|w) = p("w w") / p("w"); the rest by the sums over what follows w
        follow = {v: chance[f"{w} {v}"] / chance[v] for v in names}  # p(w first) p(v|w) / p(v first)
        first[w], end[w] = follow, chance[w]
    # unknowns p(w first) solve: p(w first) = p(w first) p(end|w) + sum_v follow[v] p(v first)
    matrix = np.array([[first[w][v] - (w == v) for v in names] for w in names])
    right = -np.array([end[w] for w in names])
    p_first = np.linalg.solve(matrix, right)
    assert abs(p_first.sum() + chance[""] - 1) < 1e-4


def test_odd_rows(odd_docs, no_docs):
    rows = M.score_documents(odd_docs).collect()
    assert len(rows) == 11 and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 5)} == {1}
    nothing = M.score_documents(odd_docs.where("doc_id is null")).collect()
    assert nothing[0]["train_tokens"] == 0 and nothing[0]["n_known"] == 0
    assert M.score_documents(no_docs).collect() == []


def test_whole_preceding_word_is_the_context(spark):
    """Words of one ending are contexts of their own, so what follows each is learned."""
    ids = [i for i in range(400) if not M.is_held_out(i)][:200]
    rows = [(i, "nation red " * 3 + "station blue " * 3) for i in ids]
    held = [i for i in range(400) if M.is_held_out(i)][:2]
    docs = spark.createDataFrame([*rows, (held[0], "nation red station blue"), (held[1], "nation blue station red")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.score_documents(docs).collect()}
    assert abs(got[held[0]]["base_score"] - got[held[1]]["base_score"]) < 1e-9
    assert got[held[0]]["score"] > got[held[1]]["score"] + 2
